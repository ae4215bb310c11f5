"""Queries over questions that follow from orders, replies and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import engine as en
from quire.operators import mentions as mn
from quire.operators import questions as qs
from quire.operators import requests as rq
from quire.operators import retrieval as rt
from quire.plans import corpus
from quire.plans.purchases import choose, pick, sections
from quire.plans.tables import table
from quire.scratch import dealt, saved, sized

ASKED = (
    "Do we need a competitive bid for a federal grant purchase?", "Is non-federal money exempt from the SSPR form?", "A small business quote for three years per year", "Only one vendor: sole source with mixed funding",
    "Can we split this into separate orders from the same vendor?", "Does equipment need a tag under BUS-29?", "A retired director wants a consulting contract", "A former employee helped write the spec and is now a vendor",
    "A former manager from the same department bids on the contract", "Ex-employee lobbying on behalf of a vendor for a contract award", "Lunch for guests: business meal receipts", "Catering insurance per occurrence limits",
    "Is a certificate of insurance needed for a chemical charter bus?", "Low risk vendor with P1 data: what risk level?", "Generative AI tool risk matrix", "Which form is the micro-purchase threshold in?", "Tax-free alcohol permit for 200-proof ethanol", "Contracting out covered services under AFSCME",
    "I have a DEA registration but haven't done an inventory count: is a tax-free permit fine?", "The investigator is retiring; an inventory is scheduled for next week: may we buy ethanol?",
)
CONTEXTS = ("buy it for {}.", "we total {} here", "below the threshold of {} only", "{} per year for five years", "under {} is fine", "{} in insurance coverage", "pay {} and no more")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", pick("o_orderkey", ASKED).alias("q"), "o_totalprice")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("o_orderkey", F.array_join(qs.topics(F.col("q")), ",").alias("topics"))


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return asked(spark, sf_dir).groupBy(qs.post_employment(q).alias("post_employment"), qs.business_meal(q).alias("meal"), qs.risk(q).alias("risk"), qs.alcohol(q).alias("alcohol")).agg(F.count("*").alias("n"))


#: Questions whose parse follows from their form; {a} and {b} are amounts.
PURCHASES = (
    "We want to purchase software for {a}, which our NIH grant pays.", "Buy equipment: {a} from the state and {b} from the federal grant.", "Two orders of {a} and {b} from the same vendor.",
    "The vendor charges {a} per year for 3 years.", "Is the bid limit of {a} right?", "Do we tag a microscope worth {a} and a centrifuge costing {b}?",
    "A sole source contract for {a}: the only manufacturer of this unique laser.", "An urgent janitorial service order of {a} for 45 days.",
)


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each order, parsed."""
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    a, b = F.floor("o_totalprice"), F.col("o_custkey") * 7 % 120000 + 1
    text = F.replace(F.replace(pick("o_orderkey", PURCHASES), F.lit("{a}"), money(a)), F.lit("{b}"), money(b))
    return rq.parse(o.select(F.col("o_orderkey").alias("q_id"), text.alias("question")))


def parse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_join(F.transform("items", lambda x: F.concat(x["name"], F.lit("="), x["cost"].cast("long").cast("string"))), ",")
    return purchases(spark, sf_dir).select("q_id", "amount", "federal_amount", "award", "years", F.aggregate("related", F.lit(0.0), lambda s, x: s + x).alias("related"), "selection", "justification", "split_intent", "duration_days", items.alias("items"))


def engine_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules decide on the parsed questions."""
    out = en.decide(saved(purchases(spark, sf_dir)), sections(spark))  # else the optimiser copies the parser into every rule
    tagged = F.size(F.filter("equipment", lambda x: x["must_tag"]))
    return out.select("q_id", "bid_required", "form_required", "substantive", "empty", en.use_rules(out).alias("use_rules"), F.size("facts").alias("facts"), tagged.alias("tagged"))


def rule_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asked(spark, sf_dir).withColumns({"topics": qs.topics(F.col("q")), "amount": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).otherwise(0.0), "covered": F.col("o_orderkey") % 5 == 0, "intent": pick("o_orderkey", ("bidding_threshold", "general", "sspr_form", "equipment_tagging"))})
    return qs.gates(rows).groupBy("use_rules", "template").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def amount_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in seven contexts: value, place and what the context makes of them."""
    money = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0))).otherwise(F.concat(F.lit("$"), F.expr("cast(o_orderkey % 900 + 1 as string)"), F.lit("k")))
    text = F.replace(pick("o_orderkey", CONTEXTS), F.lit("{}"), money)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(qs.amounts(text)).alias("a")).select("o_orderkey", "a.value", "a.start", "a.reference", "a.total", "a.per_year")


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = pick("o_orderkey", ("It is fine.", "", "The excerpts do not contain it", "It cannot be determined", None))
    best = (F.col("o_orderkey") % 20 - 15).cast("double")
    rows = table(spark, sf_dir, "orders").select(qs.refused(answer, best, F.col("o_orderkey") % 2 == 0).alias("refused"), F.col("o_orderpriority").alias("priority"))
    return rows.groupBy("priority", "refused").agg(F.count("*").alias("n"))


def citation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of sources, whose number is their place where they have none, and their quote or text."""
    s = table(spark, sf_dir, "supplier")
    page = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string"))
    section = F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("S"), F.col("s_nationkey").cast("string"))).otherwise("")
    return s.select("s_suppkey", qs.citation(F.col("s_name"), page, section).alias("cite"), F.coalesce(F.when(F.col("s_suppkey") % 4 == 0, F.col("s_nationkey")), F.col("s_suppkey")).cast("long").alias("ref"))


REPLIES = ("Answer: Yes,\n it is.\nRule: R1\nSource: x\nConditions: Ask first.\nSources: y", "**Answer**: No.", "It depends.\nConditions:\n\nRule: none", "Rules: only")


def reply_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select(pick("o_orderkey", REPLIES).alias("r"))
    return r.select(qs.reply_parts(F.col("r")).alias("p")).groupBy("p.answer", "p.conditions").agg(F.count("*").alias("n"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage's surroundings in the documents that hold all of it."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("m"))
    held = sized(mn.holding(texts(spark, sf_dir), b.select(F.col("item_id").alias("item"), F.col("m").alias("needle"))))
    found = texts(spark, sf_dir).join(held, "key").join(sized(b), F.col("item") == F.col("item_id"))
    cut = found.select("item_id", F.col("key").alias("doc_id"), "m", qs.excerpt(F.col("text"), F.col("m")).alias("cut"))
    return cut.select("item_id", "doc_id", F.length("cut").alias("chars"), F.contains("cut", "m").alias("holds"))


def hybrid_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 20 candidates of either list, first seen first, and the eight with the best of both scores."""
    first, second = (x.select("q_id", "doc_id", "score") for x in corpus.two_lists(spark, sf_dir, 20))
    pool = first.unionByName(second).groupBy("q_id", "doc_id").agg(F.max("score").alias("score"))
    return rt.top(pool, 8).select("q_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def modal_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent quantity of each part's lines; of equally frequent ones the one that comes first by order."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_quantity").agg(F.count("*").alias("n"), F.min(F.struct("l_orderkey", "l_linenumber")).alias("at"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "at", "l_quantity"))
    return n.groupBy("l_partkey").agg(best.alias("b")).select("l_partkey", F.col("b.l_quantity").alias("quantity"), (-F.col("b.m")).alias("n"))


def intent_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine and coarse accuracy of the nearest prototype; coarse labels are pairs of fine ones."""
    lab = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    r = corpus.intent_route(spark, sf_dir).join(lab, "vec_id")
    right = lambda a, b: F.round(F.avg(F.coalesce((a == b).cast("int"), F.lit(0))), 9)
    return r.agg(F.count("*").alias("n"), right(F.col("intent"), F.col("label")).alias("fine"), right(F.expr("intent div 2"), F.expr("label div 2")).alias("coarse"))


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of two runs by event type, their difference and a verdict."""
    e = table(spark, sf_dir, "events")
    two = e.groupBy("event_type").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("base"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("tuned"))
    change = F.col("tuned") - F.col("base")
    return two.select("event_type", F.round("base", 6).alias("base"), F.round("tuned", 6).alias("tuned"), F.round(change, 6).alias("change"), F.when(change > 0.5, "better").when(change < -0.5, "worse").otherwise("same").alias("verdict"))


def pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed, failed and skipped lines by return flag, and the share of passed among those not skipped."""
    li = table(spark, sf_dir, "lineitem")
    skipped, passed = F.col("l_linenumber") == 7, F.col("l_discount") < 0.05
    counts = li.groupBy("l_returnflag").agg(F.count_if(~skipped & passed).alias("passed"), F.count_if(~skipped & ~passed).alias("failed"), F.count_if(skipped).alias("skipped"))
    return counts.withColumn("rate", F.round(F.try_divide(F.col("passed"), F.col("passed") + F.col("failed")), 9))


def evidence_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each case the number of documents with all its fragments, the lines of a passage."""
    c = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("fragments"))
    needles = c.select("item_id", F.posexplode(F.array_distinct("fragments")).alias("n", "needle")).select((F.col("item_id") * 100_000 + F.col("n")).alias("item"), "needle")
    hits = mn.holding(texts(spark, sf_dir), needles)
    whole = hits.groupBy(F.expr("item div 100000").alias("item_id"), "key").agg(F.count("*").alias("n"))
    sizes = c.select("item_id", F.size(F.array_distinct("fragments")).alias("need"))
    ok = whole.join(sized(sizes), "item_id").where("n = need").groupBy("item_id").agg(F.count("*").alias("documents"))
    return c.join(ok, "item_id", "left").select("item_id", F.size("fragments").alias("fragments"), F.coalesce("documents", F.lit(0)).alias("documents"))


def sql() -> dict[str, str]:
    q = f"a AS (SELECT o_orderkey, {choose(ASKED)} AS q, o_totalprice FROM orders)"
    said = lambda p, t="q": f"coalesce(regexp_matches({t}, '(?i){p}'), FALSE)"
    topic = lambda: ", ".join(f"CASE WHEN {said(p, 'regexp_replace(q, ' + chr(39) + '(?i)non[- ]federal' + chr(39) + ', ' + chr(39) + chr(39) + ')') if t == 'federal' else said(p)} THEN '{t}' END" for t, p in qs.TOPICS.items())
    ts = f"list_sort(list_filter([{topic()}], lambda x: x IS NOT NULL))"
    letters = f"array_to_string(list_filter([{', '.join(f'CASE WHEN {said(p)} THEN {chr(39)}{k}{chr(39)} END' for k, p in qs.EXPOSURES.items())}], lambda x: x IS NOT NULL), '')"
    note = {k: said(p.replace("'", "''")) for k, p in qs.PERMIT_NOTES.items()}
    note["overdue"] += f" AND NOT {note['scheduled']}"
    alcohol = f"CASE WHEN {said(qs.ALCOHOL)} THEN array_to_string(list_filter([{', '.join(f'CASE WHEN {v} THEN {chr(39)}{k}{chr(39)} END' for k, v in note.items())}], lambda x: x IS NOT NULL), ',') END"
    has = lambda names: f"list_has_any(ts, [{', '.join(chr(39) + n + chr(39) for n in names)}])"
    s = corpus.sql()
    with_b = s["bm25_topk"].split(" SELECT q_id, doc_id, round(score, 6)")[0]
    with_a = s["bm25_a_topk"].split(" SELECT q_id, doc_id, round(score, 6)")[0].removeprefix("WITH ")
    top = lambda src, k: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM {src}) WHERE rank <= {k}"
    money = "CASE WHEN o_orderkey % 2 = 0 THEN '$' || format('{:,d}', CAST(floor(o_totalprice) AS BIGINT)) ELSE '$' || (o_orderkey % 900 + 1) || 'k' END"
    intent = s["intent_route"]
    ab = "p AS (SELECT o_orderkey AS q_id, o_orderkey % 8 AS k, floor(o_totalprice) AS a, (o_custkey * 7 % 120000 + 1)::DOUBLE AS b FROM orders)"
    parsed = """SELECT q_id, (CASE WHEN k IN (0, 2, 6, 7) THEN a WHEN k = 1 THEN a + b WHEN k = 3 THEN 3 * a ELSE 0 END)::DOUBLE AS amount, (CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE 0 END)::DOUBLE AS federal_amount,
      CASE WHEN k < 2 THEN 'grant' END AS award, (CASE k WHEN 3 THEN 3 ELSE 1 END)::DOUBLE AS years, (CASE k WHEN 2 THEN b ELSE 0 END)::DOUBLE AS related, CASE k WHEN 6 THEN 'sole_source' WHEN 7 THEN 'urgent' END AS selection,
      CASE k WHEN 6 THEN 'one_of_a_kind' END AS justification, k = 2 AS split_intent, CAST(CASE k WHEN 7 THEN 45 END AS INT) AS duration_days, CASE k WHEN 5 THEN 'microscope=' || a::BIGINT || ',centrifuge=' || b::BIGINT ELSE '' END AS items FROM p"""
    value = "CASE k WHEN 1 THEN a + b WHEN 2 THEN a + b ELSE a END"
    decided = f"""d AS (SELECT *, {value} AS v, k = 0 OR (k = 1 AND b >= 50000) AS fed, k IN (4, 5) AS no FROM p), e AS (SELECT *, CASE WHEN NOT no THEN v >= 100000 AND k NOT IN (6, 7) END AS bid, CASE WHEN NOT no THEN v >= CASE WHEN fed THEN 50000 ELSE 100000 END END AS form FROM d)
      SELECT q_id, bid AS bid_required, form AS form_required, coalesce(bid OR form, FALSE) OR fed OR k IN (2, 5, 7) AS substantive, FALSE AS empty, TRUE AS use_rules, CAST(CASE k WHEN 4 THEN 1 ELSE 0 END AS INT) AS facts, CAST(CASE k WHEN 5 THEN (a >= 5000)::INT + (b >= 5000)::INT ELSE 0 END AS INT) AS tagged FROM e"""
    return {
        "parse_requests": f"WITH {ab} {parsed}",
        "engine_results": f"WITH {ab}, {decided}",
        "topics": f"WITH {q} SELECT o_orderkey, array_to_string({ts}, ',') AS topics FROM a",
        "ladders": f"""WITH {q}, b AS (SELECT *, {letters} AS lt FROM a) SELECT
          CASE WHEN {said(qs.FORMER)} AND {said(qs.CONTRACTING)} THEN CASE WHEN {said(chr(92) + 'bretire')} AND NOT {said(qs.REPRESENTING)} THEN 'retiree' WHEN {said(qs.DECIDED)} THEN 'two_years' WHEN {said(qs.POLICYMAKER)} AND {said(qs.SAME_UNIT)} THEN '12_months' WHEN {said(qs.REPRESENTING)} THEN 'representing' ELSE 'check' END END AS post_employment,
          {said(qs.MEAL)} AND NOT ({said(qs.INSURANCE)} AND NOT {said('document|reimburs|receipt|expense|claim|approv')}) AS meal,
          CASE WHEN {said(qs.RISK)} OR ({said(qs.INSURANCE)} AND lt <> '') THEN CASE WHEN lt <> '' THEN 'high:' || lt WHEN {said(qs.MODERATE)} THEN 'moderate' WHEN {said(qs.LOW)} THEN 'low' ELSE 'rule' END END AS risk, {alcohol} AS alcohol, count(*) AS n FROM b GROUP BY 1, 2, 3, 4""",
        "rule_gate": f"WITH {q}, b AS (SELECT o_orderkey, {ts} AS ts, o_orderkey % 3 = 0 AS am, o_orderkey % 5 = 0 AS cv, {choose(('bidding_threshold', 'general', 'sspr_form', 'equipment_tagging'))} AS it FROM a) SELECT am OR {has(qs.RULE_TOPICS)} OR cv AS use_rules, NOT am AND it <> 'general' AND {has(qs.TEMPLATE_TOPICS)} AND NOT {has(qs.NOT_TEMPLATED)} AS template, count(*) AS n, min(o_orderkey) AS first FROM b GROUP BY 1, 2",
        "amount_context": f"WITH a AS (SELECT o_orderkey, o_orderkey % 7 AS k, {choose(CONTEXTS)} AS c, o_totalprice FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE (o_orderkey % 900 + 1) * 1000 END::DOUBLE AS value, CAST(strpos(c, '{{}}') - 1 AS INT) AS start, k IN (2, 4, 5) AS reference, k = 1 AS total, k = 3 AS per_year FROM a",
        "refusals": "SELECT o_orderpriority AS priority, (o_orderkey % 2 <> 0 AND o_orderkey % 20 - 15 < -8) OR o_orderkey % 5 <> 0 AS refused, count(*) AS n FROM orders GROUP BY 1, 2",
        "citation_lines": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name || ', p.' || s_suppkey WHEN 1 THEN s_name || ' (S' || s_nationkey || ')' ELSE s_name END AS cite, CAST(CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey ELSE s_suppkey END AS BIGINT) AS ref FROM supplier",
        "reply_split": "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Yes, it is.' WHEN 1 THEN 'No.' WHEN 2 THEN 'It depends.' ELSE '' END AS answer, CASE o_orderkey % 4 WHEN 0 THEN 'Ask first.' ELSE 'None' END AS conditions, count(*) AS n FROM orders GROUP BY 1, 2",
        "hybrid_pool": f"{with_b}, {with_a}, u AS (SELECT q_id, doc_id, score FROM ({top('(SELECT * FROM s WHERE score > 0)', 20)}) UNION ALL SELECT q_id, doc_id, score FROM ({top('sa', 20)})), pool AS (SELECT q_id, doc_id, max(score) AS score FROM u GROUP BY 1, 2) SELECT q_id, doc_id, round(score, 6) AS score, rank FROM ({top('pool', 8)})",
        "modal_quantity": "WITH n AS (SELECT l_partkey, l_quantity, count(*) AS n, min(l_orderkey * 100 + l_linenumber) AS place FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, place) AS k FROM n) SELECT l_partkey, l_quantity AS quantity, n FROM k WHERE k = 1",
        "intent_accuracy": f"WITH r AS ({intent}) SELECT count(*) AS n, round(avg(CASE WHEN intent = label THEN 1 ELSE 0 END), 9) AS fine, round(avg(CASE WHEN intent // 2 = label // 2 THEN 1 ELSE 0 END), 9) AS coarse FROM r JOIN embeddings USING (vec_id)",
        "run_compare": "WITH a AS (SELECT event_type, avg(value) FILTER (event_id % 2 = 0) AS base, avg(value) FILTER (event_id % 2 = 1) AS tuned FROM events GROUP BY 1) SELECT event_type, round(base, 6) AS base, round(tuned, 6) AS tuned, round(tuned - base, 6) AS change, CASE WHEN tuned - base > 0.5 THEN 'better' WHEN tuned - base < -0.5 THEN 'worse' ELSE 'same' END AS verdict FROM a",
        "pass_rate": "WITH a AS (SELECT l_returnflag, count(*) FILTER (l_linenumber <> 7 AND l_discount < 0.05) AS passed, count(*) FILTER (l_linenumber <> 7 AND l_discount >= 0.05) AS failed, count(*) FILTER (l_linenumber = 7) AS skipped FROM lineitem GROUP BY 1) SELECT *, round(passed / (passed + failed), 9) AS rate FROM a",
        "evidence_cases": "WITH c AS (SELECT item_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS fr FROM benchmark), u AS (SELECT item_id, len(fr) AS n, unnest(fr) AS f FROM c), h AS (SELECT item_id, doc_id FROM u JOIN documents d ON contains(d.text, f) GROUP BY 1, 2 HAVING count(*) = max(n)), k AS (SELECT item_id, count(*) AS n FROM h GROUP BY 1) SELECT item_id, CAST(len(fr) AS INT) AS fragments, coalesce(n, 0) AS documents FROM c LEFT JOIN k USING (item_id)",
    }


NAMES = "parse_requests engine_results topics ladders rule_gate amount_context refusals citation_lines reply_split excerpts hybrid_pool modal_quantity intent_accuracy run_compare pass_rate evidence_cases".split()
QUERIES = {name: globals()[name] for name in NAMES}
