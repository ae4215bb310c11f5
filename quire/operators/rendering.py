"""Determinations in words: flags' messages, the summary, the answer's line, and the four-part answer.

Templates stand in a map by key; places() are the columns that fill them, and wording() puts the two side by side, so that
a row makes only those places that its own sentences name. Everything is a projection of the row: no join, no shuffle.
Lambdas are left to lists of a row, since Spark doesn't compile what stands in one or what it is applied to. Callers can
give their own templates.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.operators import messages as ms
from quire.operators import questions as qs
from quire.operators import rules
from quire.operators.rules import compact

SERIOUS = ("block", "require", "caution")


def mapping(values: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def fill(template: Column, places: Column) -> Column:
    """A template with each {name} replaced by its place's value; a name without one gives nothing. Values are not looked into. Null stays null."""
    pieces = F.split(template, "[{}]")  # every other piece is a name
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.coalesce(F.element_at(places, x), F.lit(""))).otherwise(x)), "")


def wording(template: str, places: Mapping[str, Column] | Column) -> Column:
    """fill() for a template that is known beforehand: its pieces and places, columns by name or a map, side by side."""
    own = lambda x: places.get(x, F.lit("")) if isinstance(places, Mapping) else F.element_at(places, x)
    return F.concat(*(F.coalesce(own(x), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(re.split("[{}]", template))))


def chosen(key: Column, templates: Mapping[str, str], places: Mapping[str, Column] | Column) -> Column:
    """The filled template of a key, null for an unknown one; templates that are known beforehand aren't taken apart for each row."""
    return F.coalesce(*(F.when(key == k, wording(t, places)) for k, t in templates.items()))


def rung(name: str) -> Column:
    """What decide() found on one of the ladders, without its details; null where it doesn't apply."""
    return F.substring_index(F.col("rungs")[name], ":", 1)


def dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 0))


def short(x: Column) -> Column:
    """A number without a fraction where it has none."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def listed(codes: Column) -> Column:
    return F.replace(codes, F.lit(","), F.lit(", "))


def places() -> dict[str, Column]:
    """What templates are filled with, columns of rows of engine.decide() by the places' names."""
    federal, contract = F.col("federal_rules"), F.col("award") == "contract"
    trigger = F.when(contract, rules.FORM_CONTRACT).otherwise(rules.FORM_GRANT)
    order_form = F.when(~federal, rules.FORM_OTHER).otherwise(trigger)
    orders = F.concat(F.array("amount"), F.coalesce("related", F.array().cast("array<double>")))
    label = F.when(F.col("federal_award") == "contract", "federal contract").otherwise("federal grant/cooperative agreement")
    exempt = F.element_at(mapping({k.partition(":")[2]: v for k, v in ms.MESSAGES.items() if k.startswith("exemption:")}), F.col("bid_exemption"))
    yes = lambda c: F.when(F.col(c), "YES").otherwise("NO")
    parity = F.when(F.col("notice_required"), F.concat(F.lit(" Wage/benefit parity: "), yes("parity_required"), F.lit("."))).otherwise("")
    letters = F.regexp_extract(F.coalesce(F.col("rungs")["risk_matrix"], qs.risk(F.col("description")), F.lit("")), "^high:(.*)$", 1)
    exposures = F.array_join(F.transform(F.split(letters, ""), lambda x: F.element_at(mapping(ms.EXPOSURES), x)), "; ")
    others = F.array_remove("forms", rules.FORMS[0])
    values = {
        "amount": dollars(F.col("amount")), "federal": dollars(F.coalesce("federal_amount", F.lit(0.0))), "other": dollars(F.col("non_federal")), "trigger": dollars(trigger),
        "award": F.coalesce("award", F.lit("grant")), "award_label": label, "requirements": F.when(F.col("federal_award") == "contract", "FAR").otherwise("2 CFR 200 Uniform Guidance"),
        "years": short(F.col("years")), "aggregate": dollars(F.col("aggregate")), "value": dollars(F.col("value")), "exemption": exempt,
        "form_label": F.when(federal, label).otherwise("non-federal"), "form_threshold": dollars(F.col("form_threshold")), "sections": listed(F.col("sections")), "selected": F.replace("selected", F.lit("_"), F.lit(" ")),
        "orders": F.array_join(F.transform(orders, dollars), " + "), "total": dollars(F.col("orders_total")), "order_form": dollars(order_form),
        "justification": F.col("justification"), "allowed": F.when(federal, ms.ALLOWED["federal"]).otherwise(ms.ALLOWED["other"]),
        "services": F.array_join("services", ", "), "exception": F.col("exception"), "exception_label": F.element_at(mapping(ms.EXCEPTIONS), F.col("exception")), "exceptions": F.lit("; ".join(ms.EXCEPTIONS.values())),
        "term": F.when(F.col("duration_days").isNotNull(), F.concat(F.col("duration_days").cast("string"), F.lit(" days"))).otherwise(F.concat(short(F.col("years")), F.lit(" year(s)"))),
        "bid": yes("bid_required"), "form": yes("form_required"), "notice": yes("notice_required"), "line_parity": parity, "others": F.array_join(others, "; "), "exposures": exposures,
        "line_exemption": F.when(F.col("over_bid"), F.concat(F.lit("; exemption: "), exempt)), "line_sections": F.when(F.col("form_required"), F.concat(F.lit("; sections "), listed(F.col("sections")))),
    }
    basis = chosen(F.col("basis"), {k.partition(":")[2]: v for k, v in ms.MESSAGES.items() if k.startswith("basis:")}, values)
    return values | {"basis": basis}


def flag_keys() -> Column:
    """The message key of each of all_flags, in their order: what a split or a justification makes of its code comes behind it."""
    j = F.col("justification")
    reason = F.when(j.isin(*rules.DISALLOWED) | (j == "no_competition"), F.concat(F.lit(":"), j)).otherwise("")
    awarded = (j == "no_competition") & F.coalesce(F.col("federal_award") == "grant", F.lit(False))  # not allowed for another reason than the funds
    detail = lambda code, i: (
        F.when(code == "SPLIT_ORDER", F.concat(F.lit(":"), F.get("split_flags", i)))
        .when(code == "SELECTION_NOT_ALLOWED", F.concat(F.lit(":"), "selection"))
        .when(code == "SOLE_SOURCE_INVALID", F.when(awarded, "").otherwise(reason))
        .when((code == "CERTIFIED_COST_PRICING") & F.col("commercial").isNull(), ":unknown")
        .otherwise("")
    )
    return F.transform("all_flags", lambda f, i: F.concat(f["code"], F.coalesce(detail(f["code"], i), F.lit(""))))


def covered_text(say) -> Column:
    """The sentences on a covered service, joined."""
    known = F.coalesce(F.col("exception").isin(*rules.EXCEPTIONS), F.lit(False))
    allowed = F.when(F.coalesce("displaces", F.lit(False)), say("covered:displaces")).when(known, say("covered:claimed")).when(F.col("exception").isNotNull(), say("covered:unknown")).otherwise(say("covered:none"))
    notice = F.when(F.col("notice_required"), say("covered:notice")).otherwise(say("covered:no_notice"))
    parity = F.when(F.col("parity_required"), say("covered:parity")).when(F.col("notice_required"), say("covered:no_parity"))
    return F.array_join(compact(say("covered:is"), allowed, notice, parity), " ")


def headline(name: str, templates: Mapping[str, str], own_places: Mapping[str, Column]) -> Column:
    """The first sentence of what decide() found on a ladder."""
    return chosen(rung(name), {k.partition(":")[2]: v for k, v in templates.items() if k.startswith(f"{name}:")}, own_places)


def prohibitions(templates: Mapping[str, str], say) -> list[Column]:
    """The messages of the flags that forbid something, in the flags' order, each null where its flag isn't up.

    Only purchases have such flags, and the rules' own columns tell them, so that all_flags need not be made for them.
    """
    has = F.col("amount") > 0
    up = lambda code: has & F.array_contains("flags", code)
    split = [F.when(has & F.array_contains("split_flags", kind), say(f"SPLIT_ORDER:{kind}")) for kind in ("competitive_bid", "form", "intent") if f"SPLIT_ORDER:{kind}" in templates]
    j, granted = F.col("justification"), F.coalesce(F.col("federal_award") == "grant", F.lit(False))
    reasons = [F.when((j == x) & ~granted if x == "no_competition" else j == x, say(f"SOLE_SOURCE_INVALID:{x}")) for x in (*rules.DISALLOWED, "no_competition") if f"SOLE_SOURCE_INVALID:{x}" in templates]
    return [*split, F.when(up("SOLE_SOURCE_INVALID"), F.coalesce(*reasons, say("SOLE_SOURCE_INVALID"))), F.when(up("SB_LIMIT_EXCEEDED"), say("SB_LIMIT_EXCEEDED"))]


def worded(decided: DataFrame, templates: Mapping[str, str] = ms.MESSAGES) -> DataFrame:
    """Rows of engine.decide() with flag_texts (code, severity, message, policy), notes, funding_text, facts_text, equipment_text and ladders_text (code, headline, lines)."""
    own_places = places()
    say = lambda key: wording(templates[key], own_places)
    has, federal, value = F.col("amount") > 0, F.col("federal_rules"), F.col("value")
    known = {k: v for k, v in templates.items() if k.partition(":")[0] in ms.POLICIES}
    covered = covered_text(say)
    own = lambda key, code: F.when(key.isin(*known), key).otherwise(code)
    message = lambda f, key: F.when(f["code"] == "COVERED_SERVICE", covered).otherwise(let(own(key, f["code"]), lambda k: chosen(k, known, own_places)))
    texts = F.zip_with("all_flags", flag_keys(), lambda f, k: F.struct(f["code"].alias("code"), f["severity"].alias("severity"), message(f, k).alias("message"), F.element_at(mapping(ms.POLICIES), f["code"]).alias("policy")))
    whole_term = (F.col("years") > 1) & ~federal & (F.col("aggregate") >= rules.BID) & (value < rules.BID)
    micro = federal & (F.col("federal_award") == "grant") & ~F.col("form_required") & (value >= rules.MICRO)
    notes = compact(
        F.when(F.col("over_bid"), say("note:over")).otherwise(say("note:under")),
        F.when(F.col("over_bid") & F.col("bid_exemption").isNotNull(), say("note:exempt")),
        F.when(federal, say("note:federal")),
        F.when(whole_term, say("note:whole_term")),
        F.when(F.col("quotes") == 2, say("note:quotes")).when(F.col("quotes") == 1, say("note:quote")),
        F.when(F.col("form_required"), say("note:form")).otherwise(say("note:no_form")),
        F.when(micro, say("note:micro")),
    )
    funding = F.when(F.coalesce("federal_amount", F.lit(0.0)) == 0, say("funding:none")).when(~F.col("mixed"), say("funding:federal")).when(federal, say("funding:mixed_federal")).otherwise(say("funding:mixed_other"))
    facts = mapping({f: templates[f] for f in templates if f.partition(":")[2].isdigit()})
    tag = lambda e, yes, no, more=None: fill(F.when(~e["must_tag"], templates[no]).when(F.coalesce(e["accessory"], F.lit(False)) if more else F.lit(False), templates[more or yes]).otherwise(templates[yes]), F.create_map(F.lit("name"), e["name"], F.lit("cost"), dollars(e["cost"])))
    kind = lambda e: F.struct(e["name"], e["cost"], e["must_tag"], F.get(F.filter("items", lambda x: x["name"] == e["name"]), F.lit(0))["accessory"].alias("accessory"))
    steps = lambda name, more: F.when(F.col("rungs")[name].isNotNull(), F.struct(F.lit(ms.LADDERS[name]).alias("code"), headline(name, templates, own_places).alias("headline"), F.concat(F.array(F.lit(templates[name])), more).alias("lines")))
    notes_of = lambda note: compact(*(F.when(F.array_contains(note, k), templates[f"alcohol_permit:{k}"]) for k in qs.PERMIT_NOTES))
    none = F.array().cast("array<string>")
    ladders = F.when(F.size("ladders") > 0, compact(
        steps("post_employment", F.array(F.lit(templates["post_employment:ask"]))), steps("business_meal", none),
        steps("alcohol_permit", let(F.split(F.coalesce(qs.alcohol(F.col("description")), F.lit("")), ","), notes_of)), steps("risk_matrix", F.array(F.lit(templates["risk_matrix:limits"]))),
    )).otherwise(F.array().cast("array<struct<code:string,headline:string,lines:array<string>>>"))
    out = decided.withColumns({"ladders_text": ladders, "facts_text": F.transform("facts", lambda k: F.element_at(facts, k)), "equipment": F.transform("equipment", kind)})
    return out.withColumns({
        "flag_texts": texts, "notes": F.when(has, notes), "funding_text": F.when(has, funding),
        "equipment_text": F.transform("equipment", lambda e: F.struct(tag(e, "tag:yes", "tag:no", "tag:accessory").alias("summary"), tag(e, "line:tag", "line:no_tag").alias("line"))),
    })


def answer_line(rows: DataFrame, templates: Mapping[str, str] = ms.MESSAGES) -> DataFrame:
    """worded() rows with header, the determination in one line: prohibitions first, so that no later NO reads as permission; headlines of the ladders last; else the first fact. Empty where nothing was decided."""
    own_places = places()
    say = lambda key: wording(templates[key], own_places)
    has = F.col("amount") > 0
    mixed = F.when(has & F.col("mixed"), F.when(F.col("federal_rules"), say("line:mixed_federal")).otherwise(say("line:mixed_other")))
    covered = F.when(F.size("services") > 0, F.when(F.col("prohibited"), say("line:prohibited")).otherwise(say("line:exception")))
    also = F.when(F.size(F.array_remove("forms", rules.FORMS[0])) > 0, say("line:also"))
    # one string rather than a list, whose filters and joins Spark doesn't compile; each part is a sentence, so it is empty only without parts
    parts = F.concat_ws(" ", *prohibitions(templates, say), mixed, F.when(has, say("line:bid")), F.when(has, say("line:form")), F.transform("equipment_text", lambda e: e["line"]), covered, also, *(headline(name, templates, own_places) for name in ms.LADDERS))
    line = F.when(F.col("_parts") != "", F.concat(F.lit(templates["line:before"]), "_parts")).when(F.size("facts_text") > 0, F.concat(F.lit(templates["line:before"]), F.get("facts_text", F.lit(0)))).otherwise("")
    return rows.withColumn("_parts", parts).withColumn("header", line).drop("_parts")


def summary(rows: DataFrame, templates: Mapping[str, str] = ms.MESSAGES) -> DataFrame:
    """worded() rows with summary, the lines of all that was decided, and context, the same between its two marks."""
    has = F.col("amount") > 0
    under = lambda title, lines: let(lines, lambda own: F.when(F.size(own) > 0, F.concat(F.array(F.lit(title)), F.transform(own, lambda x: F.concat(F.lit("  - "), x)))).otherwise(F.array().cast("array<string>")))
    yes = lambda c: F.when(F.col(c), "YES").otherwise("NO")
    own_places = places()
    form = lambda f: chosen(f, ms.FORM_LINES, own_places)
    serious = F.filter("flag_texts", lambda f: f["severity"].isin(*SERIOUS))
    related = F.filter("flag_texts", lambda f: f["severity"] == "info")
    flag = lambda f: F.concat(F.lit("["), F.upper(f["severity"]), F.lit("] "), f["message"], F.lit(" ("), f["policy"], F.lit(")"))
    thresholds = compact(
        F.when(has, F.concat(F.lit("FUNDING: "), "funding_text")),
        F.when(has, F.concat(F.lit("THRESHOLDS: "), F.array_join("notes", " "))),
        F.when(has, F.concat(F.lit("  Competitive bid required: "), yes("bid_required"))),
        F.when(has, F.concat(F.lit("  SSPR form required: "), yes("form_required"))),
        F.when(has & F.col("form_required"), F.concat(F.lit("  SSPR sections: "), listed(F.col("sections")))),
    )
    rungs = F.flatten(F.transform("ladders_text", lambda x: F.concat(F.array(F.concat(x["code"], F.lit(": "), x["headline"])), F.transform(x["lines"], lambda y: F.concat(F.lit("  - "), y)))))
    lines = F.concat(
        thresholds, under("EQUIPMENT TAGGING (BUS-29):", F.transform("equipment_text", lambda e: e["summary"])), under("REQUIRED FORMS:", F.transform("forms", form)),
        under("COMPLIANCE FLAGS:", F.transform(serious, flag)), under("RELATED POLICIES:", F.transform(related, lambda f: F.concat(f["message"], F.lit(" ("), f["policy"], F.lit(")")))),
        under("POLICY THRESHOLDS (reference):", F.col("facts_text")), rungs,
    )
    out = rows.withColumn("summary", lines)
    return out.withColumn("context", F.array_join(F.concat(F.array(F.lit(templates["context:before"])), "summary", F.array(F.lit(templates["context:after"]))), "\n"))


def rendered(decided: DataFrame, templates: Mapping[str, str] = ms.MESSAGES) -> DataFrame:
    """Rows of engine.decide() with flag_texts, header, summary and context."""
    return summary(answer_line(worded(decided, templates), templates), templates)


def cited(keys: Column, sources: Mapping[str, tuple[tuple[str, str], ...]]) -> Column:
    """The sources of rules' keys, each once, first seen first, as cite: "quote"; sources: (cite, quote) pairs by key."""
    lines = F.create_map(*(x for k, own in sources.items() for x in (F.lit(k), F.array(*(F.lit(f'{cite}: "{quote}"') for cite, quote in own)))))
    return F.array_distinct(F.flatten(F.transform(keys, lambda k: F.coalesce(F.element_at(lines, k), F.array().cast("array<string>")))))


def pure_threshold(intent: Column) -> Column:
    """Whether a question asks for a general threshold: facts, an intent and a topic that they answer, and no topic that needs more."""
    has = lambda names: F.arrays_overlap("topics", F.array(*map(F.lit, names)))
    return (F.size("facts") > 0) & (F.col("amount") == 0) & (F.size("items") == 0) & intent.isin(*qs.TEMPLATE_INTENTS) & has(qs.TEMPLATE_TOPICS) & ~has(qs.NOT_TEMPLATED)


def answered(rows: DataFrame, reply: Column, intent: Column, sources: Column, templates: Mapping[str, str] = ms.MESSAGES) -> DataFrame:
    """answer_line() rows with answer, its four parts in four lines.

    The rule and the sources are the engine's, word for word; answer and conditions are the reply's, without anything it
    says under Rule or Source. A question for a general threshold needs no reply: the facts are its answer. sources: an
    array of cited lines.
    """
    before = templates["line:before"]
    rule = F.when(F.startswith("header", F.lit(before)), F.substr("header", F.lit(len(before) + 1))).otherwise(F.col("header"))
    source = F.coalesce(F.nullif(F.array_join(sources, "; "), F.lit("")), F.lit(templates["answer:no_source"]))
    parts = qs.reply_parts(F.coalesce(reply, F.lit("")))
    out = rows.withColumns({"_rule": rule, "_pure": pure_threshold(intent), "_said": parts["answer"], "_conditions": parts["conditions"]})  # once a row
    said = F.when(F.col("_pure"), F.array_join("facts_text", " ")).when(F.col("_said") != "", F.col("_said")).otherwise(F.col("_rule"))
    conditions = F.when(F.col("_pure"), F.lit(templates["answer:general"])).otherwise(F.col("_conditions"))
    answer = F.concat(F.lit("Answer: "), said, F.lit("\nRule: "), F.col("_rule"), F.lit("\nSource: "), source, F.lit("\nConditions: "), conditions)
    return out.withColumn("answer", answer).drop("_rule", "_pure", "_said", "_conditions")
