"""Questions with known decisions: parsing, boundaries, ladders, the answer's line. Questions and decisions are fixed values."""

import pytest
from pyspark.sql import functions as F

from quire.operators import engine as en
from quire.operators import messages as ms
from quire.operators import rendering as rd
from quire.operators import requests as rq
from quire.plans.purchases import sections
from quire.scratch import saved


@pytest.fixture(scope="module")
def asked(spark):
    """Decides many questions at once."""

    def run(*questions):
        rows = saved(rq.parse(spark.createDataFrame(list(enumerate(questions)), "q_id long, question string")))
        out = en.header(en.decide(rows, sections(spark)))
        out = out.withColumn("use_rules", en.use_rules(out))
        return [r for r in out.orderBy("q_id").collect()]

    return run


def test_parsed(asked):
    got = asked(
        "Do I need to bid a $150K NIH-funded purchase?",
        "We have a $25,000/year contract for five years with a vendor. Bid?",
        "Two purchase orders of $60,000 and $55,000 to the same vendor",
        "A $100,000 purchase: $60,000 from a federal grant we hold and $40,000 of state money. Total of $100,000",
        "What is the competitive bid threshold of $100,000?",
        "Should I tag a centrifuge for $4,800 and a microscope for $5,200?",
        "The cheapest sole source vendor wants $120k",
        "Does the vendor need liability insurance of $1,000,000? The contract is a $30,000 purchase.",
        "Certified small business quote, order of 25k",
        "Emergency repair services order for $12,000 on an NSF contract",
        "",
    )
    assert [r.amount for r in got] == [150_000, 125_000, 60_000, 100_000, 0, 0, 120_000, 30_000, 25_000, 12_000, 0]
    assert (got[0].award, got[0].federal_amount) == ("grant", 150_000)
    assert (got[1].years, got[1].value) == (5.0, 25_000)
    assert got[2].related == [55_000] and got[2].value == 115_000 and {f.code for f in got[2].all_flags} >= {"SPLIT_ORDER"}
    assert (got[3].federal_amount, got[3].federal_rules, got[3].mixed) == (60_000, True, True)
    assert got[4].facts == ["bid:1"] and not got[4].substantive and got[4].use_rules
    assert [(e.name, e.must_tag) for e in got[5].equipment] == [("centrifuge", False), ("microscope", True)] and "equipment" in got[5].topics
    assert (got[6].selection, got[6].justification, got[6].bid_required) == ("sole_source", "price", True)
    assert got[7].amounts[0].reference and not got[7].amounts[1].reference
    assert (got[8].selection, got[8].quotes) == ("small_business", 1)
    assert (got[9].award, got[9].selection, got[9].justification) == ("contract", "sole_source", "emergency")
    assert got[10].empty and not got[10].use_rules and got[10].header == ""


def test_scenarios(asked):
    got = asked(
        "Purchase for $50,000", "Purchase for $100,000", "Purchase order for $20,000, a federal contract pays", "Purchase for $40,000 and our NIH funds pay", "Purchase for $60,000 and our NIH funds pay",
        "Small business purchase for $200,000", "Small business purchase for $300,000", "Buy janitorial services for $150,000", "Buy security guard services for $80,000", "Buy IT consulting for a data security assessment for $200,000",
        "Small business purchase for $250,000",
    )
    assert [r.bid_required for r in got] == [False, True, False, False, False, False, True, True, False, True, True]
    assert [r.form_required for r in got] == [False, True, True, False, True, True, True, True, False, True, True]
    assert [r.sections for r in got[:3]] == [None, "I,VII,VIII", "I,II,VII,VIII"] and "FAR Flow-Down Articles" in got[2].forms
    assert (got[5].sections, got[5].quotes) == ("I,III,VII,VIII", 2)
    assert {f.code for f in got[6].all_flags} >= {"SB_LIMIT_EXCEEDED"} and {f.code for f in got[10].all_flags} >= {"SB_CEILING_CONFLICT"}
    assert (got[7].services, got[7].notice_required, got[7].parity_required) == (["janitorial"], True, True)
    assert (got[8].services, got[8].notice_required) == (["security"], False) and got[9].services == []
    assert got[1].header.startswith("Determination (rule engine): Competitive bid required: YES ($100,000; threshold $100,000). SSPR required: YES (threshold $100,000; sections I, VII, VIII).")
    assert "AFSCME notice: YES. Wage/benefit parity: YES." in got[7].header


def test_ladders(asked):
    got = asked(
        "What is the duration of the ban on UC contracts for former employees?",
        "What two pieces of information must be documented for a business meal expense?",
        "What are the two key requirements for obtaining a tax-free alcohol permit at UC?",
        "Do we need a certificate of insurance for a vendor transporting students?",
        "I'm hiring a caterer for our department event. The vendor has a general liability policy with a $500,000 per occurrence limit. Can I proceed?",
    )
    assert [[x.split(":")[0] for x in r.ladders] for r in got[:4]] == [["post_employment"], ["business_meal"], ["alcohol_permit"], ["risk_matrix"]]
    assert all(r.substantive and r.use_rules for r in got[:4]) and "business_meal" not in {x.split(":")[0] for x in got[4].ladders}


def test_prohibitions_come_first(asked):
    got = asked(
        "Can we split this $120,000 purchase into two orders from the same vendor to avoid bidding?", "Two purchase orders of $60,000 and $55,000 to the same vendor", "The cheapest sole source vendor wants $120k for a purchase",
        "What is the competitive bid threshold?", "Small business purchase for $300,000", "A former director on the evaluation committee: may we contract with them as a vendor?", "",
    )
    before = "Determination (rule engine): "
    assert got[0].header.startswith(before + "Intentionally dividing a purchase into smaller orders to avoid bidding requirements is prohibited under BUS-43.")
    assert got[1].header.startswith(before + "Potential split order: $60,000 + $55,000 = $115,000. Each order is below the $100,000 competitive bid threshold but together they meet it.")
    assert got[2].header.startswith(before + "Price is not an allowable sole source justification. Allowable justifications: One-of-a-kind/Unique, Match existing (list UC PO#). Competitive bid required: YES")
    assert got[3].header == before + ms.MESSAGES["bid:1"]
    assert got[4].header.startswith(before + "At $300,000 this is not under the $250,000 small business/DVBE limit")
    assert got[5].header == before + ms.MESSAGES["post_employment:two_years"] and got[6].header == ""


def test_fill(spark):
    rows = spark.createDataFrame([("a {x} b {y}{z}.", {"x": "{y}", "y": "2"}), ("plain", {}), ("", {"x": "1"}), (None, {"x": "1"})], "t string, p map<string,string>")
    assert [r.f for r in rows.select(rd.fill(F.col("t"), F.col("p")).alias("f")).collect()] == ["a {y} b 2.", "plain", "", None]
    assert {r.f for r in rows.select(rd.wording("a {x}-{y}", F.col("p")).alias("f")).collect()} == {"a {y}-2", "a -", "a 1-"}


def test_four_parts(spark, asked):
    rows = spark.createDataFrame(list(enumerate(("Is there a competitive bid threshold?", "A purchase for $120,000", "A purchase for $120,000"))), "q_id long, question string")
    done = rd.rendered(en.decide(saved(rq.parse(rows)), sections(spark)))
    replies = F.element_at(F.array(F.lit("ignored"), F.lit("Answer: Bid it.\nRule: mine\nConditions: Soon."), F.lit("")), (F.col("q_id") + 1).cast("int"))
    sources = F.when(F.col("q_id") == 1, F.array(F.lit('A: "b"'))).otherwise(F.array().cast("array<string>"))
    got = [r.answer for r in rd.answered(done, replies, F.lit("bidding_threshold"), sources).orderBy("q_id").collect()]
    rule = "Competitive bid required: YES ($120,000; threshold $100,000). SSPR required: YES (threshold $100,000; sections I, VII, VIII)."
    assert got[0] == f"Answer: {ms.MESSAGES['bid:1']}\nRule: {ms.MESSAGES['bid:1']}\nSource: {ms.MESSAGES['answer:no_source']}\nConditions: {ms.MESSAGES['answer:general']}"
    assert got[1] == f'Answer: Bid it.\nRule: {rule}\nSource: A: "b"\nConditions: Soon.'
    assert got[2] == f"Answer: {rule}\nRule: {rule}\nSource: {ms.MESSAGES['answer:no_source']}\nConditions: None"


def test_alcohol(spark):
    from quire.operators import questions as qs

    texts = (
        "What are the two key requirements for obtaining a tax-free alcohol permit at UC?",
        "Our lab needs 500 mL of 200-proof ethanol tax-free for $1,200. I have a DEA registration but haven't done an inventory count since last year. Can I proceed?",
        "The DEA registration is under a principal investigator who is retiring next month; we have the annual inventory scheduled for next week. Can we still use the tax-free permit for a $50 classroom order?",
        "May we buy wine?",
    )
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", qs.alcohol(F.col("t")).alias("a"))
    assert [r.a for r in rows.orderBy("i").collect()] == ["", "dea,overdue", "dea,scheduled,leaving", None]


@pytest.mark.parametrize("text,letter", [("a certificate of insurance from a contractor doing building construction?", "D"), ("transport students by shuttle; is a COI due?", "K"), ("The vendor will handle cash at the ticket booth. Is a COI required?", "J"), ("Architectural services for the new lab - COI?", "E"), ("A summer camp for minors: what does the risk matrix say?", "H")])
def test_risk(spark, text, letter):
    from quire.operators import questions as qs

    got = spark.createDataFrame([(text,)], "t string").select(qs.risk(F.col("t")).alias("r")).first().r
    assert got.startswith("high:") and letter in got
