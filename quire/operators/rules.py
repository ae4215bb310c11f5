"""Purchase rules as column expressions: funding, thresholds, sole source, split orders, categories, forms, sources.

A request has the columns amount, federal_amount, award ("grant", "contract" or null), years, selection, justification,
related (array of amounts), split_intent, description and the nullable flags accesses_data, accesses_phi, it_services,
displaces, commercial, exception, duration_days. Every operator is DataFrame -> DataFrame and adds columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text

# Fixed values of the policies.
BID, SAT, MICRO, GRANT_MICRO = 100_000, 350_000, 15_000, 50_000
SMALL_BUSINESS, SMALL_BUSINESS_FEDERAL, TWO_QUOTES_ABOVE = 250_000, 100_000, 100_000
FORM_CONTRACT, FORM_GRANT, FORM_OTHER = 15_000, 50_000, 100_000
COST_PRICING, ANTI_LOBBYING = 2_500_000, 100_000
NOTICE_ABOVE, PARITY_ABOVE_DAYS = 100_000, 90
TAG, TAG_BEFORE_2004 = 5_000, 1_500
ONLY_NON_FEDERAL = ("professional_services", "urgent")
ALLOWED = {
    "federal": ("one_of_a_kind", "emergency", "awarding_agency_approval", "no_competition"),
    "other": ("one_of_a_kind", "match_existing"),
}
DISALLOWED = ("pre_work", "price", "brand", "familiarity", "geographic")
SECTIONS = (
    ("competitive_bid", True, "I,VII,VIII"),
    ("competitive_bid", False, "I,VII,VIII"),
    ("competitive_proposals", True, "I,II,VII,VIII"),
    ("sole_source", True, "I,III,IV,VII,VIII"),
    ("sole_source", False, "I,III,IV,V,VI,VII,VIII"),
    ("small_business", True, "I,III,VII,VIII"),
    ("small_business", False, "I,III,VII,VIII"),
    ("professional_services", False, "I,III,V,VII,VIII"),
    ("urgent", False, "I,VI,VII,VIII"),
)


def compact(*items: Column) -> Column:
    """The items that aren't null, in order."""
    return F.array_compact(F.array(*items))


def funding(requests: DataFrame) -> DataFrame:
    """Adds non_federal, mixed, federal_rules and regime. A federal part that reaches its award's trigger makes the whole federal."""
    fed = F.coalesce("federal_amount", F.lit(0.0))
    rest = F.greatest(F.col("amount") - fed, F.lit(0.0))
    mixed = (fed > 0) & (rest > 0)
    trigger = F.when(F.col("award") == "contract", FORM_CONTRACT).otherwise(FORM_GRANT)
    federal = F.when(fed == 0, False).when(~mixed, True).otherwise(fed >= trigger)
    regime = F.when(~federal, "non_federal").otherwise(F.concat(F.lit("federal_"), F.coalesce("award", F.lit("grant"))))
    return requests.withColumns({"non_federal": rest, "mixed": mixed, "federal_rules": federal}).withColumn("regime", regime)


def evaluated(requests: DataFrame) -> DataFrame:
    """Adds aggregate (with related orders), value and basis: federal rules take the whole term, others a year of it."""
    related = F.coalesce(F.aggregate("related", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    out = requests.withColumn("aggregate", F.col("amount") + related)
    longer = F.col("years") > 1
    value = F.when(longer & ~F.col("federal_rules"), F.col("aggregate") / F.col("years")).otherwise(F.col("aggregate"))
    basis = F.when(longer, F.when(F.col("federal_rules"), "total").otherwise("annual")).when(F.col("aggregate") != F.col("amount"), "combined").otherwise("purchase")
    return out.withColumns({"value": value, "basis": basis})


def sole_source(requests: DataFrame) -> DataFrame:
    """Adds justification_ok and justification_code for the stated justification under the funding's rules."""
    j = F.col("justification")
    geographic = (j == "geographic") & ~F.col("federal_rules")
    allowed = F.when(F.col("federal_rules"), j.isin(*ALLOWED["federal"])).otherwise(j.isin(*ALLOWED["other"]))
    code = (
        F.when(j.isNull(), "SOLE_SOURCE_JUSTIFICATION")
        .when(j.isin(*DISALLOWED) & ~geographic, "SOLE_SOURCE_INVALID")
        .when((j == "no_competition") & ~F.coalesce(F.col("federal_award") == "grant", F.lit(False)), "SOLE_SOURCE_INVALID")
        .when(~allowed & ~j.isin(*DISALLOWED), "SOLE_SOURCE_INVALID")
    )
    out = requests.withColumn("federal_award", F.when(F.coalesce("federal_amount", F.lit(0.0)) > 0, F.col("award")))
    return out.withColumn("justification_code", code).withColumn("justification_ok", ~F.coalesce(F.col("justification_code") == "SOLE_SOURCE_INVALID", F.lit(False)))


def thresholds(requests: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds the bid and form decisions, the source selection that holds and its form sections, quotes and flags.

    requests: after funding(), evaluated() and sole_source(); sections: (selected, federal, sections), a table of nine rows.
    """
    federal, value, asked = F.col("federal_rules"), F.col("value"), F.col("selection")
    barred = federal & asked.isin(*ONLY_NON_FEDERAL)
    small = asked == "small_business"
    exempt = (
        F.when(barred | asked.isNull(), None)
        .when(asked == "sole_source", F.when(F.col("justification_ok"), "sole_source"))
        .when(small, F.when(value < SMALL_BUSINESS, "small_business"))
        .when(asked.isin(*ONLY_NON_FEDERAL), asked)
    )
    dropped = barred | ((asked == "sole_source") & ~F.col("justification_ok")) | (small & (value >= SMALL_BUSINESS))
    form = F.when(~federal, FORM_OTHER).when(F.col("federal_award") == "contract", FORM_CONTRACT).otherwise(FORM_GRANT)
    out = requests.withColumns({"bid_exemption": exempt, "over_bid": value >= BID, "form_threshold": form.cast("double")})
    out = out.withColumns({"bid_required": F.col("over_bid") & F.col("bid_exemption").isNull(), "form_required": value >= F.col("form_threshold")})
    default = F.when(F.col("bid_required") | ~federal, "competitive_bid").otherwise("competitive_proposals")
    out = out.withColumn("selected", F.when(F.coalesce(dropped, F.lit(False)) | asked.isNull(), default).otherwise(asked))
    pricing = federal & (F.col("federal_award") == "contract") & (F.col("selected") == "sole_source") & (value >= COST_PRICING)
    flags = compact(
        F.when(barred, "SELECTION_NOT_ALLOWED"),
        F.when((asked == "sole_source") & ~barred, F.col("justification_code")),
        F.when(small & (value < SMALL_BUSINESS) & federal & (value >= SMALL_BUSINESS_FEDERAL), "SB_FEDERAL_OVER_100K"),
        F.when(small & (value >= SMALL_BUSINESS), "SB_LIMIT_EXCEEDED"),
        F.when(small & (value == SMALL_BUSINESS), "SB_CEILING_CONFLICT"),
        F.when(pricing & ~F.coalesce("commercial", F.lit(False)), "CERTIFIED_COST_PRICING"),
    )
    quotes = F.when(small & (value < SMALL_BUSINESS), F.when(value > TWO_QUOTES_ABOVE, 2).otherwise(1))
    out = out.withColumns({"quotes": quotes, "pricing_required": F.coalesce(pricing & ~F.coalesce("commercial", F.lit(False)), F.lit(False)), "flags": flags})
    out = out.join(F.broadcast(sections.withColumnRenamed("federal", "federal_rules")), ["selected", "federal_rules"], "left")
    return out.withColumn("sections", F.when(F.col("form_required"), F.coalesce("sections", F.lit("I,VII,VIII"))))


def split_orders(requests: DataFrame) -> DataFrame:
    """Adds split_flags: thresholds that no order reaches but all together do, else the stated intent."""
    orders = F.concat(F.array("amount"), F.coalesce("related", F.array().cast("array<double>")))
    total = F.aggregate(orders, F.lit(0.0), lambda a, x: a + x)
    form = F.when(~F.col("federal_rules"), FORM_OTHER).when(F.col("award") == "contract", FORM_CONTRACT).otherwise(FORM_GRANT)
    # by the largest order, not forall(), since Spark doesn't compile lambdas; a null among the orders leaves no total
    under = lambda limit: (F.col("n_orders") >= 2) & (F.col("_most") < limit) & (F.col("orders_total") >= limit)
    bid, own = under(F.lit(BID)), (form != BID) & under(form)
    named = lambda *names: F.array(*map(F.lit, names))
    flags = F.when(bid & own, named("competitive_bid", "form")).when(bid, named("competitive_bid")).when(own, named("form")).when(F.col("split_intent"), named("intent")).otherwise(F.array().cast("array<string>"))
    return requests.withColumns({"orders_total": total, "n_orders": F.size(orders), "_most": F.array_max(orders)}).withColumn("split_flags", flags).drop("_most")


def equipment(items: DataFrame) -> DataFrame:
    """Adds tag_threshold and must_tag to items (cost, before_2004)."""
    limit = F.when(F.col("before_2004"), TAG_BEFORE_2004).otherwise(TAG).cast("double")
    return items.withColumns({"tag_threshold": limit, "must_tag": F.col("cost") >= limit})


# Fixed patterns of the covered services, in order.
COVERED = (
    ("cleaning", r"\bcleaning\b"),
    ("custodial", r"\bcustodial\b|\bcustodian"),
    ("janitorial", r"\bjanitor"),
    ("housekeeping", r"\bhousekeeping\b"),
    ("food services", r"\bfood service|\bcafeteria\b|\bdining service|\bdining hall"),
    ("laundry", r"\blaundry\b"),
    ("grounds keeping", r"\bgrounds ?keep|\blandscap(e|ing) (maintenance|services?)|\bgardening\b"),
    ("building maintenance", r"\bbuilding maintenance\b|\bfacilit(y|ies) maintenance\b"),
    ("transportation", r"\bshuttle\b|\btransportation services?\b|\bbus (drivers?|services?)\b"),
    ("parking", r"\bparking (services?|attendants?|enforcement|operations?)\b|\bvalet\b"),
    ("security", r"\bsecurity (guards?|officers?|services?|patrols?)\b|\bguard services?\b"),
    ("nursing assistant", r"\bnursing assistant|\bcertified nursing"),
    ("medical imaging", r"\bmedical imaging\b|\bradiology tech|\bimaging tech"),
    ("medical technician", r"\bmedical tech|\blab(oratory)? tech|\bpatient care tech"),
)
NOT_GUARDS = r"\b(data|information|cyber|network|it|cloud|application|software)\s+security\b"
GUARDS = r"\bguard|\bpatrol"
CRAFTS = r"\b(electric(al|ian)|plumb(ing|er)|hvac|carpent|elevator|roofing|welding|skilled craft)"
EXCEPTIONS = ("emergency", "insufficient_staff", "specialized_expertise", "incidental_to_lease", "urgent_temporary", "remote_facility", "registry_personnel", "required_by_law")
DATA = (
    r"\b(institutional data|uc data|university data|student (data|records?|information)|personal (data|information)|pii\b|employee (data|records?)|research data"
    r"|confidential data|access(es|ing)? (our|uc|university|campus) (data|systems?|records?)|data access|(access|handle|store|process)(es|ing)? .{0,20}data)"
)
PHI = r"\b(phi\b|protected health|hipaa|patient (data|records?|information)|medical records?|health information)"
DEIDENTIFIED = r"\b(de-?identified|anonymi[sz]ed)\b"
IT = r"\b(it (services?|consult\w*|contract)|software|saas|cloud|hosting|hosted|web ?site|database|information system|records system|it support|platform|app(lication)? development)"
ADVISORY = (
    ("BUS79", r"\b(catering|caterer|meal|lunch|dinner|breakfast|entertainment|reception|banquet|business meeting)"),
    ("G41", r"\b(gift cards?|employee (award|gift)s?|non-cash award|recognition award)"),
    ("G13", r"\b(moving|relocation|relocate)\b"),
    ("BUS50", r"\b(controlled substances?|dea\b|narcotic|schedule (i|ii|iii|iv|v)\b|opioid|ketamine|fentanyl)"),
    ("VEHICLE", r"\b(vehicles?|trucks?|vans?|cars?|golf carts?|fleet)\b"),
)
SERVICE = r"\b(services?|contractor|consult\w*|vendor on.?site|on.?site|install\w*|event|catering|repair|maintenance)\b"


def said(pattern: str) -> Column:
    """Whether a pattern is in a description, in any case; false for null. Of rows with _low, the description in lower case."""
    return text.said(F.col("description"), pattern, F.col("_low"))


def heard(texts: DataFrame) -> DataFrame:
    """Adds heard, what the rules on services and categories take from a description alone; rows that have it stay as they are."""
    if "heard" in texts.columns:
        return texts
    not_this = {"security": said(NOT_GUARDS) & ~said(GUARDS), "building maintenance": said(CRAFTS)}
    found = {
        "services": compact(*(F.when(said(p) & ~not_this.get(name, F.lit(False)), name) for name, p in COVERED)),
        "advisory": compact(*(F.when(said(p), code) for code, p in ADVISORY)),
        "phi": said(PHI), "deidentified": said(DEIDENTIFIED), "data": said(DATA), "it": said(IT), "service": said(SERVICE),
    }
    return texts.withColumn("_low", F.lower("description")).withColumn("heard", F.struct(*(v.alias(k) for k, v in found.items()))).drop("_low")


def covered_services(requests: DataFrame) -> DataFrame:
    """Adds heard, services, prohibited, notice_required (above 100 000) and parity_required (and longer than 90 days)."""
    found = F.size("services") > 0
    prohibited = F.coalesce("displaces", F.lit(False)) | (F.col("exception").isNotNull() & ~F.col("exception").isin(*EXCEPTIONS))
    days = F.coalesce(F.col("duration_days").cast("double"), F.col("years") * 365.0)
    notice = found & (F.col("amount") > NOTICE_ABOVE)
    out = heard(requests).withColumn("services", F.col("heard.services"))
    return out.withColumns({"prohibited": found & prohibited, "notice_required": notice, "parity_required": notice & (days > PARITY_ABOVE_DAYS)})


def categories(requests: DataFrame) -> DataFrame:
    """Adds needs_baa, needs_data_appendix, needs_is3 and category_flags, and drops heard; a stated flag goes before the text. After covered_services()."""
    phi, data = F.col("needs_baa"), F.col("needs_data_appendix")
    covered = F.size("services") > 0
    is_in = lambda name: F.col("heard")[name]
    flags = F.concat(
        compact(
            F.when(covered, "COVERED_SERVICE"),
            F.when(phi, "PHI").when(F.col("accesses_phi").isNull() & is_in("deidentified") & is_in("phi"), "PHI_DEIDENTIFIED"),
            F.when(data, "DATA_SECURITY"),
            F.when(F.col("needs_is3"), "IS3"),
        ),
        is_in("advisory"),
        compact(F.when(is_in("service") | covered, "BUS63")),
    )
    out = heard(requests)
    out = out.withColumn("needs_baa", F.coalesce("accesses_phi", is_in("phi") & ~is_in("deidentified")))
    out = out.withColumn("needs_data_appendix", F.coalesce("accesses_data", is_in("data")) | phi)
    return out.withColumn("needs_is3", data & F.coalesce("it_services", is_in("it"))).withColumn("category_flags", flags).drop("heard")


FORMS = (
    "SSPR Form", "Federal Funds Checklist", "Anti-Lobbying Verification (Byrd Amendment)", "Debarment & Suspension Verification",
    "Uniform Guidance (2 CFR 200) Flow-Down Articles", "FAR Flow-Down Articles", "UC Certified Cost or Pricing Data for Federal Contract Purchases",
    "Appendix Data Security", "Business Associate Agreement (BAA)", "IS-3 Compliance",
)


def forms(requests: DataFrame) -> DataFrame:
    """Adds forms, in their fixed order. After thresholds() and categories()."""
    federal, contract = F.col("federal_rules"), F.coalesce(F.col("federal_award") == "contract", F.lit(False))
    return requests.withColumn(
        "forms",
        compact(
            F.when(F.col("form_required"), FORMS[0]),
            F.when(federal, FORMS[1]),
            F.when(federal & (F.col("value") >= ANTI_LOBBYING), FORMS[2]),
            F.when(federal, FORMS[3]),
            F.when(federal & contract, FORMS[5]).when(federal, FORMS[4]),
            F.when(F.col("pricing_required"), FORMS[6]),
            F.when(F.col("needs_data_appendix"), FORMS[7]),
            F.when(F.col("needs_baa"), FORMS[8]),
            F.when(F.col("needs_is3"), FORMS[9]),
        ),
    )


def source_keys(requests: DataFrame) -> DataFrame:
    """Adds source_keys, the rules that the decision rests on, first seen first. After forms()."""
    federal = F.col("federal_rules")
    keys = compact(
        F.when(F.col("mixed"), F.when(F.col("award") == "contract", "MIXED_CONTRACT").otherwise("MIXED_GRANT")),
        F.lit("BID"),
        F.when(~federal, "FORM_OTHER").when(F.col("federal_award") == "contract", "FORM_CONTRACT").otherwise("FORM_GRANT"),
        F.when(F.col("quotes").isNotNull(), "SMALL_BUSINESS"),
        F.when(F.array_contains("flags", "SB_CEILING_CONFLICT"), "SMALL_BUSINESS"),
        F.when(F.col("pricing_required"), "COST_PRICING"),
        F.when(federal & (F.col("value") >= ANTI_LOBBYING), "ANTI_LOBBYING"),
    )
    return requests.withColumn("source_keys", F.array_distinct(keys))


def cart_guide(carts: DataFrame) -> DataFrame:
    """Adds questions, status, assessed and required to carts in decimals (subtotal, tax, shipping, handling, funding, suppliers, reviewed, single).

    A null charge is unknown, never 0. Only federal funding adds tax.
    """
    federal = F.col("funding").isin("federal_contract", "federal_grant")
    questions = compact(
        F.when(~F.col("reviewed"), "reviewed"),
        F.when(~F.col("single"), "single"),
        F.when(F.col("suppliers") != 1, "suppliers"),
        F.when(F.col("funding") == "unknown", "funding"),
        F.when(F.col("funding") == "mixed", "mixed"),
        F.when(F.col("shipping").isNull(), "shipping"),
        F.when(F.col("handling").isNull(), "handling"),
        F.when(federal & F.col("tax").isNull(), "tax"),
    )
    limit = F.when(F.col("funding") == "non_federal", FORM_OTHER).when(F.col("funding") == "federal_contract", FORM_CONTRACT).otherwise(FORM_GRANT)
    amount = F.col("subtotal") + F.col("shipping") + F.col("handling") + F.when(federal, F.col("tax")).otherwise(F.lit(0).cast("decimal(14,2)"))
    out = carts.withColumn("questions", questions).withColumn("status", F.when(F.size("questions") > 0, "needs_details").otherwise("checked"))
    done = F.col("status") == "checked"
    return out.withColumns({"assessed": F.when(done, amount.cast("decimal(14,2)")), "required": F.when(done, amount >= limit)})


# Fixed places of a cart page's fields.
CART_ITEM = r'(?s)<[^>]*class="[^"]*document__cell__item[^"]*"[^>]*id="LineItemSixPack[^"]*"[^>]*>(.*?)(?=<[^>]*class="[^"]*document__cell__item|<table|$)'
CART_ROW = r"(?s)<tr[^>]*>\s*<td[^>]*>([^<]*)</td>\s*<td[^>]*>([^<]*)</td>\s*</tr>"


def read_cart(pages: DataFrame, html: str) -> DataFrame:
    """pages with items (description, quantity, unit_price), tax, shipping and handling of a cart page; what isn't on it, or no amount, is null.

    Taxes are the rows Tax, Tax1 and so on, together.
    """
    page = F.col(html)
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    money = lambda c: F.when(F.trim(F.regexp_replace(c, r"\bUSD\b|[$,]", "")).rlike(r"^\d+(\.\d{1,2})?$"), F.trim(F.regexp_replace(c, r"\bUSD\b|[$,]", ""))).cast("decimal(14,2)")
    one = lambda x: F.struct(
        plain(F.regexp_extract(x, r'class="[^"]*ProductDescription[^"]*"[^>]*>([^<]*)<', 1)).alias("description"),
        F.regexp_extract(x, r'name="Req_ProductHdrQuantity:[^"]*"[^>]*value="(\d+(?:\.\d+)?)"', 1).try_cast("decimal(12,4)").alias("quantity"),
        money(F.regexp_extract(x, r'id="UnitPriceValueBlock:[^"]*"[^>]*>([^<]*)<', 1)).alias("unit_price"),
    )
    names = F.transform(F.regexp_extract_all(page, F.lit(CART_ROW), F.lit(1)), lambda x: F.lower(plain(x)))
    rows = F.arrays_zip(names.alias("name"), F.transform(F.regexp_extract_all(page, F.lit(CART_ROW), F.lit(2)), money).alias("amount"))
    out = pages.withColumns({"items": F.transform(F.regexp_extract_all(page, F.lit(CART_ITEM), F.lit(1)), one), "rows": rows})
    named = lambda n: F.get(F.filter("rows", lambda r: r["name"] == n), F.lit(0))["amount"]
    taxes = F.filter("rows", lambda r: r["name"].rlike(r"^tax\d*$"))
    tax = F.when(F.size(taxes) > 0, F.aggregate(taxes, F.lit(0).cast("decimal(24,2)"), lambda s, r: (s + r["amount"]).cast("decimal(24,2)"))).cast("decimal(14,2)")
    return out.withColumns({"tax": tax, "shipping": named("shipping"), "handling": named("handling")}).drop("rows")
