"""Decisions over parsed questions: the rules in one pass, reference facts, and what was decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import questions as qs
from quire.operators import rendering, rules
from quire.operators.messages import LADDERS
from quire.operators.rules import compact

# Fixed severities of the flags.
SEVERITY = {
    "SPLIT_ORDER": "block", "SELECTION_NOT_ALLOWED": "block", "SOLE_SOURCE_INVALID": "block", "SOLE_SOURCE_JUSTIFICATION": "require", "SB_FEDERAL_OVER_100K": "caution",
    "SB_LIMIT_EXCEEDED": "require", "SB_CEILING_CONFLICT": "caution", "CERTIFIED_COST_PRICING": "require", "FEDERAL_PORTION_BELOW_TRIGGER": "info", "PHI": "require",
    "PHI_DEIDENTIFIED": "info", "DATA_SECURITY": "require", "IS3": "require", "BUS79": "info", "G41": "info", "G13": "info", "BUS50": "info", "VEHICLE": "info", "BUS63": "info",
}
# Fixed order of the topics that have reference facts, and how many facts each has.
FACTS = {"bid": 1, "sspr": 2, "federal": 2, "mixed": 1, "multi_year": 1, "small_business": 1, "sole_source": 2, "split": 1, "equipment": 1, "micro": 1, "sat": 1, "covered": 3}


def reference_facts(topics: Column) -> Column:
    """The keys topic:number of the facts that topics call up, in the facts' own order."""
    keys = F.array(*(F.struct(F.lit(t).alias("topic"), F.lit(f"{t}:{k + 1}").alias("key")) for t, n in FACTS.items() for k in range(n)))
    return F.transform(F.filter(keys, lambda x: F.array_contains(topics, x["topic"])), lambda x: x["key"])


def severity(flag: Column, prohibited: Column) -> Column:
    known = F.create_map(*(F.lit(x) for p in SEVERITY.items() for x in p))
    return F.when(flag == "COVERED_SERVICE", F.when(prohibited, "block").otherwise("require")).otherwise(F.element_at(known, flag))


def read(requests: DataFrame) -> DataFrame:
    """Adds what decide() takes from description and topics alone: heard, and rungs, what each ladder finds; rows that have both stay as they are.

    decide() calls it. Callers whose requests share their texts can call it on each text once and join.
    """
    if "rungs" in requests.columns:
        return rules.heard(requests)
    q = F.col("description")
    found = {"post_employment": qs.post_employment(q), "business_meal": F.when(qs.business_meal(q), "documents"), "alcohol_permit": F.when(qs.said(q, qs.ALCOHOL), "permit"), "risk_matrix": qs.risk(q)}
    return rules.heard(requests).withColumn("rungs", F.struct(*(F.when(F.array_contains("topics", k), v).alias(k) for k, v in found.items())))


def decide(requests: DataFrame, sections: DataFrame) -> DataFrame:
    """Requests, as parse() makes them, with all determinations: those of the rules, all_flags (code, severity), facts, ladders and their rungs, tagged items.

    Without an amount nothing is decided on funding and thresholds: bid_required and form_required are null. Facts are
    for questions without a purchase. substantive: something is required, blocked or tagged; empty: nothing was found.
    """
    out = rules.split_orders(rules.sole_source(rules.evaluated(rules.funding(read(requests)))))
    out = rules.forms(rules.categories(rules.covered_services(rules.thresholds(out, sections))))
    has = F.col("amount") > 0
    split = F.transform("split_flags", lambda _: F.lit("SPLIT_ORDER"))
    below = F.when(F.col("mixed") & ~F.col("federal_rules"), "FEDERAL_PORTION_BELOW_TRIGGER")
    bought = F.concat(split, "flags", compact(below))
    codes = F.concat(F.when(has, bought).otherwise(F.array().cast("array<string>")), "category_flags")
    tag = lambda x: F.struct(x["name"].alias("name"), x["cost"].alias("cost"), (x["cost"] >= rules.TAG).alias("must_tag"))
    out = out.withColumns({
        "all_flags": F.transform(codes, lambda c: F.struct(c.alias("code"), severity(c, F.col("prohibited")).alias("severity"))),
        "equipment": F.transform("items", tag), "ladders": compact(*(F.concat(F.lit(f"{k}:"), F.col("rungs")[k]) for k in LADDERS)),
        "facts": F.when((F.col("amount") == 0) & (F.size("items") == 0), reference_facts(F.col("topics"))).otherwise(F.array().cast("array<string>")),
        "bid_required": F.when(has, F.col("bid_required")), "form_required": F.when(has, F.col("form_required")),
    })
    serious = F.exists("all_flags", lambda f: f["severity"].isin("block", "require", "caution"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.withColumns({
        "substantive": yes("bid_required") | yes("form_required") | (F.size("forms") > 0) | (F.size("items") > 0) | serious | (F.size("ladders") > 0),
        "empty": ~has & (F.size("items") == 0) & (F.size("all_flags") == 0) & (F.size("facts") == 0) & (F.size("ladders") == 0),
    })


def use_rules(decided: DataFrame) -> Column:
    """Whether the rules have something to decide in a question: a purchase, items, a rule topic or a covered service."""
    topical = F.arrays_overlap("topics", F.array(*map(F.lit, qs.RULE_TOPICS)))
    return (F.col("amount") > 0) | (F.size("items") > 0) | topical | (F.size("services") > 0)


def header(decided: DataFrame) -> DataFrame:
    """Adds header, the determination in one line; empty where nothing was decided."""
    return rendering.answer_line(rendering.worded(decided))
