"""Queries that put determinations into words, for requests that follow from orders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import engine as en
from quire.operators import messages as ms
from quire.operators import questions as qs
from quire.operators import rendering as rd
from quire.operators import rules
from quire.plans import purchases as pc
from quire.plans.tables import table
from quire.scratch import dealt, saved, sized

#: What a request's description goes on with.
MORE = (
    "", " Is a competitive bid needed above the micro-purchase threshold?", " A former director of the same department is the vendor: may we contract?", " A retired employee bids on the contract.",
    " Is a certificate of insurance due for chemical transport?", " What risk level has public data?", " Is our tax-free alcohol permit fine under a DEA registration? We haven't done an inventory count.",
    " Business lunch for guests: which receipts?", " A former employee, who wrote the spec, is a vendor now.", " Under the simplified acquisition threshold of federal grants?", " Generative AI tool: risk matrix?",
)
REPLIES = ("Answer: Yes,\n it is.\nRule: R1\nConditions: Ask first.", "**Answer**: No.", "", None)
INTENTS = ("bidding_threshold", "general")
# Places and passages of some rules.
SOURCES = {
    "BID": (("BUS-43, p.9, III, C. Expenditures of $100,000 or More Annually, 1. General Requirements", "requires that UC competitively bid all purchases with proposed annual expenditure of $100,000 or more unless an exception applies"),),
    "SMALL_BUSINESS": (("SSPR form, p.1, I. Source Selection, Non-Federal Funds", "Certified Small Business or DVBE (Only <$250k; Complete III, VII, VIII)"),),
}


def read_once(given: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with topics and what decide() takes from a description, from the distinct descriptions of the same rows as they are given."""
    texts = dealt(given.select(F.col("description").alias("text")).distinct(), "text")
    texts = en.read(texts.withColumns({"description": F.col("text"), "topics": qs.topics(F.col("text"))})).drop("description")
    return rows.join(sized(texts), F.col("description").eqNullSafe(F.col("text")), "left").drop("text")


def determined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by orders, every twelfth without an amount, decided; descriptions that many requests share are read once each."""
    described = lambda orders: pc.requests(orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 12 == 0, 0.0).otherwise(F.col("o_totalprice")))).withColumn("description", F.concat("description", pc.pick("request_id", MORE)))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    rows = read_once(described(orders), described(dealt(orders, "o_orderkey")))
    none = F.array().cast("array<struct<name:string,cost:double,accessory:boolean>>")
    thing = F.array(F.struct(F.lit("laser").alias("name"), F.col("amount").alias("cost"), (F.col("request_id") % 2 == 0).alias("accessory")))
    rows = rows.withColumns({"items": F.when(F.col("request_id") % 21 == 5, thing).otherwise(none)})
    return rules.source_keys(en.decide(rows, pc.sections(spark)))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """determined(), written once, for sentences in lambdas, into which the optimiser copies the rules."""
    return saved(determined(spark, sf_dir))


def answer_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The determination in one line: prohibitions first, headlines of ladders last."""
    return rd.answer_line(rd.worded(determined(spark, sf_dir))).select("request_id", "header")


def rule_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that was decided, line by line."""
    return rd.rendered(decided(spark, sf_dir)).select("request_id", "context")


def rule_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer's four parts around a reply."""
    rows = rd.answer_line(rd.worded(determined(spark, sf_dir)))  # the answer takes no line of the summary
    keys = F.when(F.col("amount") > 0, F.col("source_keys")).otherwise(F.array().cast("array<string>"))
    out = rd.answered(rows, pc.pick("request_id", REPLIES), pc.pick("request_id", INTENTS), rd.cited(keys, SOURCES))
    return out.select("request_id", "answer")


def flag_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each flag's message occurs, by severity and policy."""
    # the outer form, since the optimiser puts a filter before the other one that words all messages two more times
    flags = rd.worded(decided(spark, sf_dir)).select(F.explode_outer("flag_texts").alias("f")).where(F.col("f").isNotNull()).select("f.*")
    return flags.groupBy("code", "severity", "policy").agg(F.count("*").alias("n"), F.min("message").alias("first"), F.max("message").alias("last"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql() -> dict[str, str]:
    m = ms.MESSAGES
    money = lambda x: f"('$' || format('{{:,d}}', CAST(round_even({x}, 0) AS BIGINT)))"
    case = lambda key, values: f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + " END"
    kept = lambda *items: f"list_filter([{', '.join(items)}], lambda q: q IS NOT NULL)"
    exempt = case("bid_exemption", {k.partition(":")[2]: v for k, v in m.items() if k.startswith("exemption:")})
    label = "CASE WHEN federal_award = 'contract' THEN 'federal contract' ELSE 'federal grant/cooperative agreement' END"
    trigger = "CASE WHEN award = 'contract' THEN 15000 ELSE 50000 END"
    yes = lambda c: f"CASE WHEN {c} THEN 'YES' ELSE 'NO' END"
    listed = "replace(sections, ',', ', ')"
    places = {
        "amount": money("amount"), "federal": money("federal_amount"), "other": money("greatest(amount - federal_amount, 0)"), "trigger": money(trigger), "award": "coalesce(award, 'grant')", "award_label": label,
        "requirements": "CASE WHEN federal_award = 'contract' THEN 'FAR' ELSE '2 CFR 200 Uniform Guidance' END", "years": "CAST(CAST(years AS INT) AS VARCHAR)", "aggregate": money("aggregate"), "value": money("value"), "basis": "basis_text",
        "exemption": exempt, "form_label": f"CASE WHEN federal_rules THEN {label} ELSE 'non-federal' END", "form_threshold": money("form_threshold"), "sections": listed, "selected": "replace(selected, '_', ' ')",
        "orders": f"array_to_string(list_transform(os, lambda z: {money('z')}), ' + ')", "total": money("total"), "order_form": money("fm"), "justification": "justification",
        "allowed": f"CASE WHEN federal_rules THEN {quoted(ms.ALLOWED['federal'])} ELSE {quoted(ms.ALLOWED['other'])} END", "services": "replace(services, ',', ', ')", "exception": "exception",
        "exception_label": case("exception", ms.EXCEPTIONS), "exceptions": quoted("; ".join(ms.EXCEPTIONS.values())), "term": "CASE WHEN duration_days IS NOT NULL THEN duration_days || ' days' ELSE CAST(years AS INT) || ' year(s)' END",
        "bid": yes("bid_required"), "form": yes("form_required"), "notice": yes("notice"), "line_parity": f"CASE WHEN notice THEN ' Wage/benefit parity: ' || {yes('parity')} || '.' ELSE '' END", "others": "others", "exposures": "exposures",
        "line_exemption": f"CASE WHEN over_bid THEN '; exemption: ' || {exempt} END", "line_sections": f"CASE WHEN form_required THEN '; sections ' || {listed} END", "name": "'laser'", "cost": money("amount"),
    }

    def say(template: str) -> str:
        return "(" + " || ".join(f"coalesce({places[x]}, '')" if i % 2 else quoted(x) for i, x in enumerate(re.split("[{}]", template)) if x) + ")"

    by = lambda key, names: f"CASE {key} " + " ".join(f"WHEN {quoted(n)} THEN {say(m[k])}" for n, k in names.items()) + " END"
    said = lambda p, t="description": f"coalesce(regexp_matches({t}, '(?i){p}'), FALSE)"
    without = "regexp_replace(description, '(?i)non[- ]federal', '')"
    topics = kept(*(f"CASE WHEN {said(p, without) if t == 'federal' else said(p)} THEN '{t}' END" for t, p in qs.TOPICS.items()))
    services = kept(*(f"CASE WHEN {said(p)}" + (f" AND NOT ({said(rules.NOT_GUARDS)} AND NOT {said(rules.GUARDS)})" if n == "security" else f" AND NOT {said(rules.CRAFTS)}" if n == "building maintenance" else "") + f" THEN '{n}' END" for n, p in rules.COVERED))
    known = ", ".join(map(quoted, rules.EXCEPTIONS))
    letters = kept(*(f"CASE WHEN {said(p)} THEN {quoted(ms.EXPOSURES[k])} END" for k, p in qs.EXPOSURES.items()))
    has = lambda t: f"list_contains(ts, '{t}')"
    post = f"CASE WHEN {has('post_employment')} AND {said(qs.FORMER)} AND {said(qs.CONTRACTING)} THEN CASE WHEN {said(chr(92) + 'bretire')} AND NOT {said(qs.REPRESENTING)} THEN 'retiree' WHEN {said(qs.DECIDED)} THEN 'two_years' WHEN {said(qs.POLICYMAKER)} AND {said(qs.SAME_UNIT)} THEN '12_months' WHEN {said(qs.REPRESENTING)} THEN 'representing' ELSE 'check' END END"
    meal = f"{has('business_meal')} AND {said(qs.MEAL)} AND NOT ({said(qs.INSURANCE)} AND NOT {said('document|reimburs|receipt|expense|claim|approv')})"
    risk = f"CASE WHEN {has('risk_matrix')} AND ({said(qs.RISK)} OR ({said(qs.INSURANCE)} AND exposures <> '')) THEN CASE WHEN exposures <> '' THEN 'high' WHEN {said(qs.MODERATE)} THEN 'moderate' WHEN {said(qs.LOW)} THEN 'low' ELSE 'rule' END END"
    notes = {k: said(p.replace("'", "''")) for k, p in qs.PERMIT_NOTES.items()}
    notes["overdue"] += f" AND NOT {notes['scheduled']}"
    base = pc.REQ.replace("FROM orders)", "FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 12 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice) FROM orders))", 1).replace(f"{pc.choose(pc.TEXTS)} AS description", f"{pc.choose(pc.TEXTS)} || {pc.choose(MORE)} AS description")
    flag = lambda code, when, severity, text: f"CASE WHEN {when} THEN {{'code': '{code}', 'severity': {severity}, 'message': {text}, 'policy': {quoted(ms.POLICIES[code])}}} END"
    invalid = "CASE WHEN justification = 'no_competition' AND coalesce(federal_award, '') = 'grant' THEN " + say(m["SOLE_SOURCE_INVALID"]) + " ELSE coalesce(" + by("justification", {k.partition(":")[2]: k for k in m if k.startswith("SOLE_SOURCE_INVALID:")}) + ", " + say(m["SOLE_SOURCE_INVALID"]) + ") END"
    covered = f"array_to_string({kept(say(m['covered:is']), f'''CASE WHEN coalesce(displaces, FALSE) THEN {say(m['covered:displaces'])} WHEN exception IN ({known}) THEN {say(m['covered:claimed'])} WHEN exception IS NOT NULL THEN {say(m['covered:unknown'])} ELSE {say(m['covered:none'])} END''', f'''CASE WHEN notice THEN {say(m['covered:notice'])} ELSE {say(m['covered:no_notice'])} END''', f'''CASE WHEN parity THEN {say(m['covered:parity'])} WHEN notice THEN {say(m['covered:no_parity'])} END''')}, ' ')"
    in_flags = lambda code: f"am AND list_contains(string_split(flags, ','), '{code}')"
    n = {f: quoted(f) for f in rules.FORMS}
    f_ = list(n.values())
    forms = kept(
        f"CASE WHEN form_required THEN {f_[0]} END", f"CASE WHEN federal_rules THEN {f_[1]} END", f"CASE WHEN federal_rules AND value >= 100000 THEN {f_[2]} END", f"CASE WHEN federal_rules THEN {f_[3]} END",
        f"CASE WHEN federal_rules AND coalesce(federal_award = 'contract', FALSE) THEN {f_[5]} WHEN federal_rules THEN {f_[4]} END", f"CASE WHEN pricing_required THEN {f_[6]} END", f"CASE WHEN data THEN {f_[7]} END", f"CASE WHEN phi THEN {f_[8]} END", f"CASE WHEN it AND data THEN {f_[9]} END",
    )
    flags = kept(
        flag("SPLIT_ORDER", "am AND len(os) >= 2 AND most < 100000 AND total >= 100000", "'block'", say(m["SPLIT_ORDER:competitive_bid"])),
        flag("SPLIT_ORDER", "am AND fm <> 100000 AND len(os) >= 2 AND most < fm AND total >= fm", "'block'", say(m["SPLIT_ORDER:form"])),
        flag("SPLIT_ORDER", "am AND split_intent AND NOT (len(os) >= 2 AND ((most < 100000 AND total >= 100000) OR (fm <> 100000 AND most < fm AND total >= fm)))", "'block'", say(m["SPLIT_ORDER:intent"])),
        flag("SELECTION_NOT_ALLOWED", in_flags("SELECTION_NOT_ALLOWED"), "'block'", by("selection", {k.partition(":")[2]: k for k in m if k.startswith("SELECTION_NOT_ALLOWED")})),
        flag("SOLE_SOURCE_INVALID", in_flags("SOLE_SOURCE_INVALID"), "'block'", invalid), flag("SOLE_SOURCE_JUSTIFICATION", in_flags("SOLE_SOURCE_JUSTIFICATION"), "'require'", say(m["SOLE_SOURCE_JUSTIFICATION"])),
        flag("SB_FEDERAL_OVER_100K", in_flags("SB_FEDERAL_OVER_100K"), "'caution'", say(m["SB_FEDERAL_OVER_100K"])), flag("SB_LIMIT_EXCEEDED", in_flags("SB_LIMIT_EXCEEDED"), "'require'", say(m["SB_LIMIT_EXCEEDED"])),
        flag("SB_CEILING_CONFLICT", in_flags("SB_CEILING_CONFLICT"), "'caution'", say(m["SB_CEILING_CONFLICT"])),
        flag("CERTIFIED_COST_PRICING", in_flags("CERTIFIED_COST_PRICING"), "'require'", f"CASE WHEN commercial IS NULL THEN {say(m['CERTIFIED_COST_PRICING:unknown'])} ELSE {say(m['CERTIFIED_COST_PRICING'])} END"),
        flag("FEDERAL_PORTION_BELOW_TRIGGER", "am AND mixed AND NOT federal_rules", "'info'", say(m["FEDERAL_PORTION_BELOW_TRIGGER"])),
        flag("COVERED_SERVICE", "services <> ''", "CASE WHEN prohibited THEN 'block' ELSE 'require' END", covered), flag("PHI", "phi", "'require'", say(m["PHI"])),
        flag("PHI_DEIDENTIFIED", f"NOT phi AND {said(rules.DEIDENTIFIED)} AND {said(rules.PHI)} AND accesses_phi IS NULL", "'info'", say(m["PHI_DEIDENTIFIED"])), flag("DATA_SECURITY", "data", "'require'", say(m["DATA_SECURITY"])),
        flag("IS3", "it AND data", "'require'", say(m["IS3"])), *(flag(code, said(p), "'info'", say(m[code])) for code, p in rules.ADVISORY), flag("BUS63", f"{said(rules.SERVICE)} OR services <> ''", "'info'", say(m["BUS63"])),
    )
    ladder = lambda name, when, key, *lines: f"CASE WHEN {when} THEN {{'code': '{ms.LADDERS[name]}', 'headline': {by(key, {k.partition(':')[2]: k for k in m if k.startswith(name + ':')})}, 'lines': {kept(quoted(m[name]), *lines)}}} END"
    ladders = kept(
        ladder("post_employment", "post IS NOT NULL", "post", quoted(m["post_employment:ask"])), ladder("business_meal", "meal", "'documents'"),
        ladder("alcohol_permit", f"{has('alcohol_permit')} AND {said(qs.ALCOHOL)}", "'permit'", *(f"CASE WHEN {v} THEN {quoted(m['alcohol_permit:' + k])} END" for k, v in notes.items())),
        ladder("risk_matrix", "risk IS NOT NULL", "risk", quoted(m["risk_matrix:limits"])),
    )
    explained = kept(
        f"CASE WHEN over_bid THEN {say(m['note:over'])} ELSE {say(m['note:under'])} END", f"CASE WHEN over_bid AND bid_exemption IS NOT NULL THEN {say(m['note:exempt'])} END", f"CASE WHEN federal_rules THEN {say(m['note:federal'])} END",
        f"CASE WHEN years > 1 AND NOT federal_rules AND aggregate >= 100000 AND value < 100000 THEN {say(m['note:whole_term'])} END", f"CASE quotes WHEN 2 THEN {say(m['note:quotes'])} WHEN 1 THEN {say(m['note:quote'])} END",
        f"CASE WHEN form_required THEN {say(m['note:form'])} ELSE {say(m['note:no_form'])} END", f"CASE WHEN federal_rules AND federal_award = 'grant' AND NOT form_required AND value >= 15000 THEN {say(m['note:micro'])} END",
    )
    funding = f"CASE WHEN federal_amount = 0 THEN {say(m['funding:none'])} WHEN NOT mixed THEN {say(m['funding:federal'])} WHEN federal_rules THEN {say(m['funding:mixed_federal'])} ELSE {say(m['funding:mixed_other'])} END"
    facts = kept(*(f"CASE WHEN {has(t)} THEN {quoted(m[f'{t}:{k + 1}'])} END" for t, count in en.FACTS.items() for k in range(count)))
    tagged = "amount >= 5000"
    tag = f"CASE WHEN item THEN CASE WHEN {tagged} AND request_id % 2 = 0 THEN {say(m['tag:accessory'])} WHEN {tagged} THEN {say(m['tag:yes'])} ELSE {say(m['tag:no'])} END END"
    line_tag = f"CASE WHEN item THEN CASE WHEN {tagged} THEN {say(m['line:tag'])} ELSE {say(m['line:no_tag'])} END END"
    steps = f"""{base}, c0 AS (SELECT *, array_to_string({services}, ',') AS services, list_concat([amount], related) AS os, CASE WHEN NOT federal_rules THEN 100000 WHEN award = 'contract' THEN 15000 ELSE 50000 END AS fm, amount > 0 AS am, {topics} AS ts,
      coalesce(accesses_phi, {said(rules.PHI)} AND NOT {said(rules.DEIDENTIFIED)}) AS phi, coalesce(it_services, {said(rules.IT)}) AS it, array_to_string({letters}, '; ') AS exposures, request_id % 21 = 5 AS item, {by('basis', {k.partition(':')[2]: k for k in m if k.startswith('basis:')})} AS basis_text FROM t),
    c1 AS (SELECT *, coalesce(accesses_data, {said(rules.DATA)}) OR phi AS data, list_sum(os) AS total, list_max(os) AS most, services <> '' AND (coalesce(displaces, FALSE) OR coalesce(exception NOT IN ({known}), FALSE)) AS prohibited, services <> '' AND amount > 100000 AS notice,
      services <> '' AND amount > 100000 AND coalesce(duration_days::DOUBLE, years * 365) > 90 AS parity, {post} AS post, {meal} AS meal, {risk} AS risk FROM c0),
    c2 AS (SELECT *, {forms} AS fs FROM c1), c3 AS (SELECT *, array_to_string(list_filter(fs, lambda q: q <> 'SSPR Form'), '; ') AS others FROM c2),
    c4 AS (SELECT *, {flags} AS fl, {ladders} AS la, CASE WHEN NOT am AND NOT item THEN {facts} ELSE [] END AS fa FROM c3),
    c5 AS (SELECT *, list_concat(list_transform(list_filter(fl, lambda q: q.severity IN ('block', 'require') AND q.code IN ({', '.join(map(quoted, ms.PROHIBITIONS))})), lambda q: q.message),
      {kept(f"CASE WHEN am AND mixed THEN CASE WHEN federal_rules THEN {say(m['line:mixed_federal'])} ELSE {say(m['line:mixed_other'])} END END", f"CASE WHEN am THEN {say(m['line:bid'])} END", f"CASE WHEN am THEN {say(m['line:form'])} END", line_tag,
      f"CASE WHEN services <> '' THEN CASE WHEN prohibited THEN {say(m['line:prohibited'])} ELSE {say(m['line:exception'])} END END", f"CASE WHEN others <> '' THEN {say(m['line:also'])} END")}, list_transform(la, lambda q: q.headline)) AS parts FROM c4),
    h AS (SELECT *, CASE WHEN len(parts) > 0 THEN {quoted(m['line:before'])} || array_to_string(parts, ' ') WHEN len(fa) > 0 THEN {quoted(m['line:before'])} || fa[1] ELSE '' END AS header FROM c5)"""
    under = lambda title, lines: f"CASE WHEN len({lines}) > 0 THEN list_concat(['{title}'], list_transform({lines}, lambda z: '  - ' || z)) ELSE [] END"
    line_form = "CASE q " + " ".join(f"WHEN {quoted(k)} THEN {say(v)}" for k, v in ms.FORM_LINES.items()) + " END"
    context = f"""list_concat([{quoted(m['context:before'])}], CASE WHEN am THEN {kept(f"'FUNDING: ' || {funding}", f"'THRESHOLDS: ' || array_to_string({explained}, ' ')", f"'  Competitive bid required: ' || {yes('bid_required')}", f"'  SSPR form required: ' || {yes('form_required')}", f"CASE WHEN form_required THEN '  SSPR sections: ' || {listed} END")} ELSE [] END,
      {under('EQUIPMENT TAGGING (BUS-29):', kept(tag))}, {under('REQUIRED FORMS:', f"list_transform(fs, lambda q: {line_form})")},
      {under('COMPLIANCE FLAGS:', "list_transform(list_filter(fl, lambda q: q.severity <> 'info'), lambda q: '[' || upper(q.severity) || '] ' || q.message || ' (' || q.policy || ')')")},
      {under('RELATED POLICIES:', "list_transform(list_filter(fl, lambda q: q.severity = 'info'), lambda q: q.message || ' (' || q.policy || ')')")}, {under('POLICY THRESHOLDS (reference):', 'fa')},
      flatten(list_transform(la, lambda q: list_concat([q.code || ': ' || q.headline], list_transform(q.lines, lambda z: '  - ' || z)))), [{quoted(m['context:after'])}])"""
    has_any = lambda names: f"list_has_any(ts, [{', '.join(map(quoted, names))}])"
    pure = f"(NOT am AND NOT item AND len(fa) > 0 AND request_id % 2 = 0 AND {has_any(qs.TEMPLATE_TOPICS)} AND NOT {has_any(qs.NOT_TEMPLATED)})"
    cite = lambda k: quoted("; ".join(f'{c}: "{q}"' for c, q in SOURCES[k]))
    source = f"coalesce(nullif(array_to_string({kept(f'CASE WHEN am THEN {cite("BID")} END', f'CASE WHEN am AND (quotes IS NOT NULL OR list_contains(string_split(flags, {quoted(",")}), {quoted("SB_CEILING_CONFLICT")})) THEN {cite("SMALL_BUSINESS")} END')}, '; '), ''), {quoted(m['answer:no_source'])})"
    rule = f"substr(header, {len(m['line:before']) + 1})"
    reply = "CASE request_id % 4 WHEN 0 THEN 'Yes, it is.' WHEN 1 THEN 'No.' ELSE " + rule + " END"
    answer = f"'Answer: ' || CASE WHEN {pure} THEN array_to_string(fa, ' ') ELSE {reply} END || chr(10) || 'Rule: ' || {rule} || chr(10) || 'Source: ' || {source} || chr(10) || 'Conditions: ' || CASE WHEN {pure} THEN {quoted(m['answer:general'])} WHEN request_id % 4 = 0 THEN 'Ask first.' ELSE 'None' END"
    return {
        "answer_headers": f"{steps} SELECT request_id, header FROM h",
        "rule_context": f"{steps} SELECT request_id, array_to_string({context}, chr(10)) AS context FROM h",
        "rule_answers": f"{steps} SELECT request_id, {answer} AS answer FROM h",
        "flag_messages": f"{steps}, u AS (SELECT unnest(fl) AS f FROM h) SELECT f.code AS code, f.severity AS severity, f.policy AS policy, count(*) AS n, min(f.message) AS first, max(f.message) AS last FROM u GROUP BY 1, 2, 3",
    }


QUERIES = {f.__name__: f for f in (answer_headers, rule_context, rule_answers, flag_messages)}
