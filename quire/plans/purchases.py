"""Rule queries over purchases made from orders, line items and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import rules
from quire.plans.tables import table

TEXTS = (
    "janitorial cleaning services for the library", "cloud software with access to student records", "de-identified patient data hosting", "shuttle and bus services",
    "security guards and data security software", "building maintenance with a licensed electrician", "catering for a business meeting", "HIPAA patient records platform",
    "fleet vehicles and golf carts", "laboratory technician staffing", "laundry and housekeeping", "microscope with gift cards", "network security review", "relocation of a fentanyl study",
)
SELECTIONS = (None, "sole_source", "small_business", "professional_services", "urgent", "competitive_proposals", "competitive_bid")
JUSTIFICATIONS = (None, "one_of_a_kind", "emergency", "awarding_agency_approval", "no_competition", "match_existing", "pre_work", "price", "brand", "geographic", "other")


def pick(key: str, values: tuple, cast: str = "string"):
    """One of some values by a key's remainder."""
    return F.element_at(F.array(*(F.lit(v).cast(cast) for v in values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def requests(orders: DataFrame) -> DataFrame:
    """Purchase requests that follow from orders: funding by priority, the rest by the order's key."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    share = F.expr("(o_orderkey % 10 + 1)")
    priority = F.substring("o_orderpriority", 1, 1)
    federal = F.when(priority == "1", F.lit(0).cast("long")).when(priority.isin("2", "3"), F.col("cents")).otherwise(F.expr("cents * share div 20"))
    out = orders.withColumns({"cents": cents, "share": share.cast("long")})
    return out.select(
        F.col("o_orderkey").alias("request_id"),
        (F.col("cents") / 100).alias("amount"),
        (federal / 100).alias("federal_amount"),
        F.when(priority.isin("2", "4"), "grant").when(priority.isin("3", "5"), "contract").alias("award"),
        F.expr("cast(o_orderkey % 5 + 1 as double)").alias("years"),
        pick("o_orderkey", SELECTIONS).alias("selection"),
        pick("o_orderkey", JUSTIFICATIONS).alias("justification"),
        F.when(F.col("o_orderkey") % 4 == 0, F.array(F.expr("(cents div 2) / 100D"), F.lit(30000.0))).otherwise(F.array().cast("array<double>")).alias("related"),
        (F.col("o_orderkey") % 9 == 0).alias("split_intent"),
        pick("o_orderkey", TEXTS).alias("description"),
        pick("o_orderkey", (None, None, True, False), "boolean").alias("accesses_data"),
        pick("o_orderkey", (None, None, None, True, False), "boolean").alias("accesses_phi"),
        pick("o_orderkey", (None, True, None), "boolean").alias("it_services"),
        pick("o_orderkey", (None, False, False, True, False, False), "boolean").alias("displaces"),
        pick("o_orderkey", (None, True, False), "boolean").alias("commercial"),
        pick("o_orderkey", (None, "emergency", "unknown_reason", None, "registry_personnel")).alias("exception"),
        pick("o_orderkey", (None, 90, 91, 400), "int").alias("duration_days"),
    )


def literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def choose(values: tuple, key: str = "o_orderkey") -> str:
    return f"([{', '.join(map(literal, values))}])[{key} % {len(values)} + 1]"


REQ = f"""
WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(o_orderkey % 10 + 1 AS BIGINT) AS share, substr(o_orderpriority, 1, 1) AS pr FROM orders),
req AS (SELECT o_orderkey AS request_id, cents / 100 AS amount,
  CASE WHEN pr = '1' THEN 0 WHEN pr IN ('2', '3') THEN cents ELSE cents * share // 20 END / 100 AS federal_amount,
  CASE WHEN pr IN ('2', '4') THEN 'grant' WHEN pr IN ('3', '5') THEN 'contract' END AS award, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS years,
  {choose(SELECTIONS)} AS selection, {choose(JUSTIFICATIONS)} AS justification,
  CASE WHEN o_orderkey % 4 = 0 THEN [(cents // 2) / 100, 30000.0::DOUBLE] ELSE []::DOUBLE[] END AS related, o_orderkey % 9 = 0 AS split_intent, {choose(TEXTS)} AS description,
  {choose((None, None, True, False))}::BOOLEAN AS accesses_data, {choose((None, None, None, True, False))}::BOOLEAN AS accesses_phi, {choose((None, True, None))}::BOOLEAN AS it_services,
  {choose((None, False, False, True, False, False))}::BOOLEAN AS displaces, {choose((None, True, False))}::BOOLEAN AS commercial,
  {choose((None, "emergency", "unknown_reason", None, "registry_personnel"))} AS exception, {choose((None, 90, 91, 400))}::INT AS duration_days FROM o),
f AS (SELECT *, federal_amount > 0 AND amount - federal_amount > 0 AS mixed, CASE WHEN federal_amount > 0 THEN award END AS federal_award FROM req),
g AS (SELECT *, CASE WHEN federal_amount = 0 THEN FALSE WHEN NOT mixed THEN TRUE ELSE federal_amount >= CASE award WHEN 'contract' THEN 15000 ELSE 50000 END END AS federal_rules FROM f),
v AS (SELECT *, CASE WHEN federal_rules THEN 'federal_' || coalesce(award, 'grant') ELSE 'non_federal' END AS regime, amount + coalesce(list_sum(related), 0) AS aggregate FROM g),
w AS (SELECT *, CASE WHEN years > 1 AND NOT federal_rules THEN aggregate / years ELSE aggregate END AS value,
  CASE WHEN years > 1 THEN CASE WHEN federal_rules THEN 'total' ELSE 'annual' END WHEN aggregate <> amount THEN 'combined' ELSE 'purchase' END AS basis FROM v),
j AS (SELECT *, CASE WHEN justification IS NULL THEN 'SOLE_SOURCE_JUSTIFICATION'
   WHEN justification IN ('pre_work', 'price', 'brand', 'familiarity') OR (justification = 'geographic' AND federal_rules) THEN 'SOLE_SOURCE_INVALID'
   WHEN justification = 'no_competition' AND coalesce(federal_award, '') <> 'grant' THEN 'SOLE_SOURCE_INVALID'
   WHEN justification <> 'geographic' AND NOT (CASE WHEN federal_rules THEN justification IN ('one_of_a_kind', 'emergency', 'awarding_agency_approval', 'no_competition') ELSE justification IN ('one_of_a_kind', 'match_existing') END) THEN 'SOLE_SOURCE_INVALID' END AS justification_code FROM w),
k AS (SELECT *, coalesce(justification_code, '') <> 'SOLE_SOURCE_INVALID' AS justification_ok, coalesce(federal_rules AND selection IN ('professional_services', 'urgent'), FALSE) AS barred,
   coalesce(selection = 'small_business', FALSE) AS small, value >= 100000 AS over_bid, CASE WHEN NOT federal_rules THEN 100000 WHEN federal_award = 'contract' THEN 15000 ELSE 50000 END::DOUBLE AS form_threshold FROM j),
x AS (SELECT *, CASE WHEN barred THEN NULL WHEN selection = 'sole_source' THEN CASE WHEN justification_ok THEN 'sole_source' END WHEN small THEN CASE WHEN value < 250000 THEN 'small_business' END
   WHEN selection IN ('professional_services', 'urgent') THEN selection END AS bid_exemption, value >= form_threshold AS form_required FROM k),
y AS (SELECT *, over_bid AND bid_exemption IS NULL AS bid_required FROM x),
z AS (SELECT *, CASE WHEN barred OR selection IS NULL OR (selection = 'sole_source' AND NOT justification_ok) OR (small AND value >= 250000)
   THEN CASE WHEN bid_required OR NOT federal_rules THEN 'competitive_bid' ELSE 'competitive_proposals' END ELSE selection END AS selected FROM y),
t AS (SELECT *, coalesce(federal_rules AND federal_award = 'contract' AND selected = 'sole_source' AND value >= 2500000 AND NOT coalesce(commercial, FALSE), FALSE) AS pricing_required,
   CASE WHEN small AND value < 250000 THEN CASE WHEN value > 100000 THEN 2 ELSE 1 END END AS quotes,
   array_to_string(list_filter([CASE WHEN barred THEN 'SELECTION_NOT_ALLOWED' END, CASE WHEN selection = 'sole_source' AND NOT barred THEN justification_code END,
     CASE WHEN small AND value < 250000 AND federal_rules AND value >= 100000 THEN 'SB_FEDERAL_OVER_100K' END, CASE WHEN small AND value >= 250000 THEN 'SB_LIMIT_EXCEEDED' END,
     CASE WHEN small AND value = 250000 THEN 'SB_CEILING_CONFLICT' END,
     CASE WHEN federal_rules AND federal_award = 'contract' AND selected = 'sole_source' AND value >= 2500000 AND NOT coalesce(commercial, FALSE) THEN 'CERTIFIED_COST_PRICING' END], lambda q: q IS NOT NULL), ',') AS flags,
   CASE WHEN form_required THEN CASE selected || '/' || federal_rules WHEN 'competitive_proposals/true' THEN 'I,II,VII,VIII' WHEN 'sole_source/true' THEN 'I,III,IV,VII,VIII' WHEN 'sole_source/false' THEN 'I,III,IV,V,VI,VII,VIII'
     WHEN 'small_business/true' THEN 'I,III,VII,VIII' WHEN 'small_business/false' THEN 'I,III,VII,VIII' WHEN 'professional_services/false' THEN 'I,III,V,VII,VIII' WHEN 'urgent/false' THEN 'I,VI,VII,VIII' ELSE 'I,VII,VIII' END END AS sections FROM z)
"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.sole_source(rules.evaluated(rules.funding(requests(table(spark, sf_dir, "orders")))))


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(rules.SECTIONS), "selected string, federal boolean, sections string")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.thresholds(base(spark, sf_dir), sections(spark))


def purchase_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select(
        "request_id", "regime", "basis", F.round("value", 6).alias("value"), "over_bid", "bid_exemption", "bid_required", "selected", "form_threshold", "form_required",
        "sections", F.col("quotes").cast("int").alias("quotes"), "pricing_required", F.array_join("flags", ",").alias("flags"),
    )


def mixed_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.funding(requests(table(spark, sf_dir, "orders")))
    return out.groupBy("regime", "mixed").agg(F.count("*").alias("n"), F.sum(F.round(F.col("federal_amount") * 100).cast("long")).alias("federal_cents"))


def sole_source_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).groupBy("regime", "justification", "justification_code", "justification_ok").agg(F.count("*").alias("n"))


def split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order against the lines of the same order as related purchases, and requests with their own related ones."""
    out = rules.split_orders(rules.funding(requests(table(spark, sf_dir, "orders"))))
    return out.select("request_id", F.round("orders_total", 2).alias("orders_total"), F.col("n_orders").cast("int").alias("n_orders"), F.array_join("split_flags", ",").alias("split_flags"))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines are all below the bid threshold and together reach it."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"), F.max(cents).alias("most"))
    split = (F.col("n") >= 2) & (F.col("most") < rules.BID * 100) & (F.col("cents") >= rules.BID * 100)
    return lines.select("l_orderkey", "n", (F.col("cents") / 100).alias("total"), split.alias("split"))


def equipment_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("cost"), (F.year("l_shipdate") < 1995).alias("before_2004"))
    tagged = rules.equipment(items).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return tagged.groupBy("p_brand", "before_2004").agg(F.count("*").alias("items"), F.count_if("must_tag").alias("tagged"), F.max(F.when(~F.col("must_tag"), F.col("cost"))).alias("dearest_untagged"))


def covered_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.covered_services(requests(table(spark, sf_dir, "orders")))
    return out.select("request_id", F.array_join("services", ",").alias("services"), "prohibited", "notice_required", "parity_required")


def category_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.categories(rules.covered_services(requests(table(spark, sf_dir, "orders"))))
    return out.select("request_id", "needs_baa", "needs_data_appendix", "needs_is3", F.array_join("category_flags", ",").alias("category_flags"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.forms(rules.categories(rules.covered_services(decided(spark, sf_dir))))


def form_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select("request_id", F.array_join("forms", "; ").alias("forms"))


def rule_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many decisions rest on each rule, with the place of the rule in a table of documents."""
    where = spark.createDataFrame(
        [("BID", "BUS-43", 9), ("MIXED_CONTRACT", "SSPR form", 1), ("MIXED_GRANT", "SSPR form", 1), ("FORM_OTHER", "SSPR form", 1), ("FORM_CONTRACT", "SSPR form", 1), ("FORM_GRANT", "SSPR form", 1), ("SMALL_BUSINESS", "BUS-43", 25), ("COST_PRICING", "FAR 15.403-4", None), ("ANTI_LOBBYING", "Federal Funds Checklist", 1)],
        "key string, document string, page int",
    )
    keys = rules.source_keys(routed(spark, sf_dir)).select("request_id", F.posexplode("source_keys").alias("place", "key"))
    out = keys.join(F.broadcast(where), "key")
    cite = F.concat("document", F.coalesce(F.concat(F.lit(", p."), F.col("page").cast("string")), F.lit("")))
    return out.groupBy("key", cite.alias("cite")).agg(F.count("*").alias("n"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))


MONEY = "decimal(14,2)"


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cart for each order with its lines' sum; charges are unknown for some, funding goes by the priority."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("subtotal"), F.count_distinct(F.lower("s_name")).alias("suppliers"))
    charge = lambda n, k: F.when(F.col("o_orderkey") % n != 0, ((F.col("o_orderkey") % k) * F.lit("1.25").cast("decimal(4,2)")).cast(MONEY))
    kinds = F.create_map(*(F.lit(x) for x in ("1", "unknown", "2", "non_federal", "3", "federal_contract", "4", "federal_grant", "5", "mixed")))
    return table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("cart_id"), "subtotal", "suppliers", charge(5, 97).alias("tax"), charge(7, 31).alias("shipping"), charge(11, 13).alias("handling"),
        F.element_at(kinds, F.substring("o_orderpriority", 1, 1)).alias("funding"), (F.col("o_orderkey") % 13 != 0).alias("reviewed"), (F.col("o_orderkey") % 17 != 0).alias("single"),
    )


def cart_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.cart_guide(carts(spark, sf_dir)).select("cart_id", F.array_join("questions", ",").alias("questions"), "status", "assessed", "required")


def cart_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order's lines add up to its total within a cent, and problems of its fields."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("lines"), F.count_if(F.col("l_quantity") <= 0).alias("bad_lines"))
    total = F.col("o_totalprice").cast(MONEY)
    return table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", (F.abs(F.col("lines") - total) <= F.lit("0.01").cast(MONEY)).alias("reconciles"), F.coalesce("bad_lines", F.lit(0)).alias("bad_lines"),
        (F.isnan("o_totalprice") | (F.col("o_totalprice") < 0) | (F.abs("o_totalprice") == float("inf"))).alias("bad_total"),
    )


def sql() -> dict[str, str]:
    hit = lambda p: f"regexp_matches(coalesce(description, ''), '(?i){p}')"
    services = ", ".join(
        f"CASE WHEN {hit(p)}" + (f" AND NOT ({hit(rules.NOT_GUARDS)} AND NOT {hit(rules.GUARDS)})" if n == "security" else f" AND NOT {hit(rules.CRAFTS)}" if n == "building maintenance" else "") + f" THEN '{n}' END" for n, p in rules.COVERED
    )
    joined = lambda items, sep=",": f"array_to_string(list_filter([{items}], lambda q: q IS NOT NULL), '{sep}')"
    cs = f", c AS (SELECT *, {joined(services)} AS services FROM t)"
    known = ", ".join(map(literal, rules.EXCEPTIONS))
    cat = f""", d AS (SELECT *, coalesce(accesses_phi, {hit(rules.PHI)} AND NOT {hit(rules.DEIDENTIFIED)}) AS needs_baa, coalesce(it_services, {hit(rules.IT)}) AS it FROM c),
      e AS (SELECT *, coalesce(accesses_data, {hit(rules.DATA)}) OR needs_baa AS needs_data_appendix FROM d)"""
    advisory = ", ".join(f"CASE WHEN {hit(p)} THEN '{code}' END" for code, p in rules.ADVISORY)
    flags = f"""CASE WHEN services <> '' THEN 'COVERED_SERVICE' END, CASE WHEN needs_baa THEN 'PHI' WHEN {hit(rules.DEIDENTIFIED)} AND {hit(rules.PHI)} AND accesses_phi IS NULL THEN 'PHI_DEIDENTIFIED' END,
      CASE WHEN needs_data_appendix THEN 'DATA_SECURITY' END, CASE WHEN it AND needs_data_appendix THEN 'IS3' END, {advisory}, CASE WHEN {hit(rules.SERVICE)} OR services <> '' THEN 'BUS63' END"""
    n = [literal(x) for x in rules.FORMS]
    contract = "coalesce(federal_award = 'contract', FALSE)"
    routed_ = f"""CASE WHEN form_required THEN {n[0]} END, CASE WHEN federal_rules THEN {n[1]} END, CASE WHEN federal_rules AND value >= 100000 THEN {n[2]} END, CASE WHEN federal_rules THEN {n[3]} END,
      CASE WHEN federal_rules AND {contract} THEN {n[5]} WHEN federal_rules THEN {n[4]} END, CASE WHEN pricing_required THEN {n[6]} END, CASE WHEN needs_data_appendix THEN {n[7]} END, CASE WHEN needs_baa THEN {n[8]} END, CASE WHEN it AND needs_data_appendix THEN {n[9]} END"""
    cart = """
WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(14,2)) AS subtotal, count(DISTINCT lower(s_name)) AS suppliers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
c AS (SELECT o_orderkey AS cart_id, subtotal, suppliers, CASE WHEN o_orderkey % 5 <> 0 THEN CAST((o_orderkey % 97) * 1.25 AS DECIMAL(14,2)) END AS tax, CASE WHEN o_orderkey % 7 <> 0 THEN CAST((o_orderkey % 31) * 1.25 AS DECIMAL(14,2)) END AS shipping,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST((o_orderkey % 13) * 1.25 AS DECIMAL(14,2)) END AS handling,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'unknown' WHEN '2' THEN 'non_federal' WHEN '3' THEN 'federal_contract' WHEN '4' THEN 'federal_grant' ELSE 'mixed' END AS funding, o_orderkey % 13 <> 0 AS reviewed, o_orderkey % 17 <> 0 AS single
  FROM orders JOIN s ON o_orderkey = l_orderkey),
q AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT reviewed THEN 'reviewed' END, CASE WHEN NOT single THEN 'single' END, CASE WHEN suppliers <> 1 THEN 'suppliers' END, CASE WHEN funding = 'unknown' THEN 'funding' END, CASE WHEN funding = 'mixed' THEN 'mixed' END,
  CASE WHEN shipping IS NULL THEN 'shipping' END, CASE WHEN handling IS NULL THEN 'handling' END, CASE WHEN funding LIKE 'federal%' AND tax IS NULL THEN 'tax' END], lambda x: x IS NOT NULL), ',') AS questions FROM c),
a AS (SELECT *, CASE WHEN questions = '' THEN CAST(subtotal + shipping + handling + CASE WHEN funding LIKE 'federal%' THEN tax ELSE 0 END AS DECIMAL(14,2)) END AS assessed FROM q)
SELECT cart_id, questions, CASE WHEN questions = '' THEN 'checked' ELSE 'needs_details' END AS status, assessed, CASE WHEN questions = '' THEN assessed >= CASE funding WHEN 'non_federal' THEN 100000 WHEN 'federal_contract' THEN 15000 ELSE 50000 END END AS required FROM a"""
    keys = """CASE WHEN mixed THEN CASE award WHEN 'contract' THEN 'MIXED_CONTRACT' ELSE 'MIXED_GRANT' END END, 'BID', CASE WHEN NOT federal_rules THEN 'FORM_OTHER' WHEN federal_award = 'contract' THEN 'FORM_CONTRACT' ELSE 'FORM_GRANT' END,
      CASE WHEN quotes IS NOT NULL OR flags LIKE '%SB_CEILING%' THEN 'SMALL_BUSINESS' END, CASE WHEN pricing_required THEN 'COST_PRICING' END, CASE WHEN federal_rules AND value >= 100000 THEN 'ANTI_LOBBYING' END"""
    return {
        "purchase_thresholds": REQ + "SELECT request_id, regime, basis, round(value, 6) AS value, over_bid, bid_exemption, bid_required, selected, form_threshold, form_required, sections, quotes, pricing_required, flags FROM t",
        "mixed_funding": REQ + "SELECT regime, mixed, count(*) AS n, CAST(sum(CAST(round(federal_amount * 100) AS BIGINT)) AS BIGINT) AS federal_cents FROM t GROUP BY 1, 2",
        "sole_source_check": REQ + "SELECT regime, justification, justification_code, justification_ok, count(*) AS n FROM t GROUP BY 1, 2, 3, 4",
        "split_orders": REQ + """, a AS (SELECT request_id, list_concat([amount], related) AS os, federal_rules, split_intent, CASE WHEN NOT federal_rules THEN 100000 WHEN award = 'contract' THEN 15000 ELSE 50000 END AS fm FROM t),
          b AS (SELECT *, list_sum(os) AS total, list_max(os) AS most FROM a),
          c AS (SELECT *, array_to_string(list_filter([CASE WHEN len(os) >= 2 AND most < 100000 AND total >= 100000 THEN 'competitive_bid' END, CASE WHEN fm <> 100000 AND len(os) >= 2 AND most < fm AND total >= fm THEN 'form' END], lambda q: q IS NOT NULL), ',') AS fl FROM b)
          SELECT request_id, round(total, 2) AS orders_total, CAST(len(os) AS INT) AS n_orders, CASE WHEN fl = '' AND split_intent THEN 'intent' ELSE fl END AS split_flags FROM c""",
        "split_lines": "WITH a AS (SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS most FROM lineitem GROUP BY 1) SELECT l_orderkey, n, cents / 100 AS total, n >= 2 AND most < 10000000 AND cents >= 10000000 AS split FROM a",
        "equipment_tags": "WITH a AS (SELECT *, year(l_shipdate) < 1995 AS before_2004, l_extendedprice >= CASE WHEN year(l_shipdate) < 1995 THEN 1500 ELSE 5000 END AS must_tag FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT p_brand, before_2004, count(*) AS items, count(*) FILTER (must_tag) AS tagged, max(l_extendedprice) FILTER (NOT must_tag) AS dearest_untagged FROM a GROUP BY 1, 2",
        "covered_services": REQ + cs + f"SELECT request_id, services, services <> '' AND (coalesce(displaces, FALSE) OR coalesce(exception NOT IN ({known}), FALSE)) AS prohibited, services <> '' AND amount > 100000 AS notice_required, services <> '' AND amount > 100000 AND coalesce(duration_days::DOUBLE, years * 365) > 90 AS parity_required FROM c",
        "category_flags": REQ + cs + cat + f"SELECT request_id, needs_baa, needs_data_appendix, it AND needs_data_appendix AS needs_is3, {joined(flags)} AS category_flags FROM e",
        "form_routing": REQ + cs + cat + f"SELECT request_id, {joined(routed_, '; ')} AS forms FROM e",
        "rule_sources": REQ + f""", a AS (SELECT request_id, list_filter([{keys}], lambda q: q IS NOT NULL) AS ks FROM t), b AS (SELECT unnest(ks) AS key, generate_subscripts(ks, 1) - 1 AS place FROM a)
          SELECT key, CASE key WHEN 'BID' THEN 'BUS-43, p.9' WHEN 'SMALL_BUSINESS' THEN 'BUS-43, p.25' WHEN 'COST_PRICING' THEN 'FAR 15.403-4' WHEN 'ANTI_LOBBYING' THEN 'Federal Funds Checklist, p.1' ELSE 'SSPR form, p.1' END AS cite, count(*) AS n, CAST(min(place) AS INT) AS first_place, CAST(max(place) AS INT) AS last_place FROM b GROUP BY 1, 2""",
        "cart_guide": cart,
        "cart_checks": "WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(14,2)) AS lines, count(*) FILTER (l_quantity <= 0) AS bad_lines FROM lineitem GROUP BY 1) SELECT o_orderkey, abs(lines - CAST(o_totalprice AS DECIMAL(14,2))) <= 0.01 AS reconciles, coalesce(bad_lines, 0) AS bad_lines, isnan(o_totalprice) OR o_totalprice < 0 OR isinf(o_totalprice) AS bad_total FROM orders LEFT JOIN s ON o_orderkey = l_orderkey",
    }


QUERIES = {f.__name__: f for f in (purchase_thresholds, mixed_funding, sole_source_check, split_orders, split_lines, equipment_tags, covered_services, category_flags, form_routing, rule_sources, cart_guide, cart_checks)}
