"""Purchase requests read from questions: amounts, funding, orders, years, source selection, items.

parse() fills the columns that quire.operators.rules takes, for all questions at once, with column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import NUMBERS, duration_days, number
from quire.operators.questions import FEDERAL, TOPICS, amounts, said, topics

# Fixed patterns of the question parser.
FEDERAL_WORD = rf"(?<!non-)(?<!non ){FEDERAL}"
FEDERAL_CONTRACT = r"(federal(ly funded)?|nih|nsf|doe|dod|nasa|darpa)\s+contracts?\b|\bcontract (funds|funding)\b|\bFAR\b"
OTHER_MONEY = r"\b(non-?federal|state|departmental|discretionary|gift|general funds?|campus funds?|uc funds?|recharge|endowment|private)\b"
PROCUREMENT = (
    r"\b(purchas\w*|buy\w*|bought|order\w*|procur\w*|vendors?|suppliers?|contract\w*|bid\w*|quotes?|sspr|equipment|services?|acquisition|po\b|spend\w*"
    r"|janitor\w*|custodial|consult\w*|tag\w*)"
)
PERSONAL = r"professional (or|and|/) ?personal services|personal services"
URGENT = r"\burgen(t|cy)\b|compelling|\bemergency\b"
EMERGENCY = r"\bemergency\b"
JUSTIFICATIONS = (  # in this order; those that aren't allowed come first
    ("pre_work", r"pre-?work|customi[sz]\w+ .{0,40}(to exclude|exclud|so only)|helped (us )?(write|draft|develop) (the )?spec"),
    ("brand", r"\bbrand\b"),
    ("price", r"cheapest|lowest price|best price|better price|cheaper"),
    ("familiarity", r"familiar|proficien|already (trained|know|use)|used to using|preference"),
    ("geographic", r"\blocal (vendor|supplier|business)|nearby|geograph"),
    ("emergency", EMERGENCY),
    ("awarding_agency_approval", r"(agency|sponsor|program officer)\s+(has\s+)?approv"),
    ("match_existing", r"match(ing)? (our )?existing|compatib"),
    ("one_of_a_kind", r"one.of.a.kind|unique|only (manufacturer|vendor|supplier|company)|no other (manufacturer|vendor|supplier|company)|only available|only one (vendor|supplier|manufacturer|company)|only available from"),
)
REALLY_ONE = r"one.of.a.kind|unique|no other|only (manufacturer|available)"
DIVIDED = (
    r"\bsplit|break (it |this |them |the purchase )?up|\bdivid|separate (purchase )?orders|(two|three|several|multiple) (separate )?(purchase )?orders"
    r"|to avoid (the )?(competitive )?bid|stay (under|below)|smaller orders|independent purchases|separate purchases|without triggering"
)
EQUIPMENT = r"\btag(ged|ging)?\b|inventori(al|ed)|\basset|capitaliz|\bcaan\b|bus-29|tracked|equipment.{0,60}\$5,000 threshold|\$5,000 threshold.{0,60}equipment"
ITEM_BEFORE = r"(?i)(?:an?|the|one)\s+([a-z][a-z\-]*(?:\s+[a-z][a-z\-]*){0,2}?)\s+(?:for|costing|valued at|worth|priced at|at)\s*(?:about\s+)?$"
ITEM_AFTER = r"(?i)^\s*([a-z][a-z\-]*(?:\s+(?!and\b|or\b|for\b)[a-z][a-z\-]*)?)"
NOT_ITEMS = (
    "and or for of in per from each total worth to the a which that with purchase order grant annually but we i our it is was this they you market value"
).split()
DISPLACING = r"displac|eliminat\w* (their|the|uc|our|those|these)? ?(jobs|positions)|lay ?offs?|laid off|replace (uc|university|our|existing) (staff|employees|workers)|job loss"
EXCEPTIONS = (
    ("emergency", EMERGENCY),
    ("specialized_expertise", r"specialized (skills|expertise|equipment)|no uc (employee|staff) has|not available (internally|in-house)"),
    ("remote_facility", r"\bremote (facility|site|location)|more than (10|ten) miles"),
    ("urgent_temporary", r"\btemporary|occasional|one-time"),
    ("incidental_to_lease", r"\blease\b"),
    ("registry_personnel", r"\bregistry\b"),
    ("required_by_law", r"required by (law|federal)|court order"),
    ("insufficient_staff", r"insufficient (uc )?staff|not enough (uc )?staff|understaffed"),
)
YEARS = rf"(?i)(?:×|x|for|over)?\s*\b(\d+|{'|'.join(NUMBERS)})[\s-]*(?:years?|yrs?)\b(?!\s+ago)"


def first_said(text: Column, patterns: tuple, low: Column) -> Column:
    """The name of the first pattern that is in a text; low as in said()."""
    return F.coalesce(*(F.when(said(text, p, low), name) for name, p in patterns))


def total_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, a: s + a["value"])


def item(text: Column, a: Column, i: Column) -> Column:
    """The name, cost and kind of the item that an amount is said of: words before it, else behind it, else its number."""
    before = F.regexp_extract(F.substring(text, F.greatest(a["start"] - 49, F.lit(1)), F.least(a["start"], F.lit(50))), ITEM_BEFORE, 1)
    behind = F.regexp_extract(F.substring(text, a["end"] + 1, F.lit(40)), ITEM_AFTER, 1)
    stop = F.array(*map(F.lit, NOT_ITEMS))
    words = lambda x: F.split(F.trim(x), r"\s+")
    behind = F.when(~F.array_contains(stop, F.lower(F.get(words(behind), F.lit(0)))), behind).otherwise("")
    name = F.array_join(F.filter(words(F.when(before != "", before).otherwise(behind)), lambda w: ~F.array_contains(stop, F.lower(w))), " ")
    name = F.when(name == "", F.concat(F.lit("Item "), (i + 1).cast("string"))).otherwise(name)
    return F.struct(name.alias("name"), a["value"].alias("cost"), name.rlike("(?i)accessor").alias("accessory"))


def parse(questions: DataFrame) -> DataFrame:
    """questions (q_id, question) with amounts, topics and the columns of a request; amount is 0 without a purchase."""
    q = F.coalesce("question", F.lit(""))
    out = questions.withColumns({"description": q, "topics": topics(q), "amounts": amounts(q)})
    q, low = F.col("description"), F.col("_low")
    is_in = lambda p: said(q, p, low)
    out = out.withColumn("_low", F.lower("description"))
    out = out.withColumn("concrete", F.filter("amounts", lambda a: ~a["reference"]))
    n = F.size("concrete")
    out = out.withColumn("tagging", is_in(EQUIPMENT) & (n > 0))
    out = out.withColumn("buying", ~F.col("tagging") & (n > 0) & is_in(PROCUREMENT))
    every = total_of(F.col("concrete"))
    stated = F.get(F.filter("concrete", lambda a: a["total"]), F.lit(0))
    summed = F.when(n >= 3, F.get(F.filter("concrete", lambda a: F.abs(every - 2 * a["value"]) < 1), F.lit(0)))
    out = out.withColumn("whole", F.coalesce(stated, summed))
    out = out.withColumn("parts", F.filter("concrete", lambda a: F.coalesce(a["start"] != F.col("whole.start"), F.lit(True))))

    def behind(a: Column) -> Column:
        later = F.array_min(F.transform(F.filter("concrete", lambda o: o["start"] > a["start"]), lambda o: o["start"]))
        return F.substring(q, a["end"] + 1, F.least(F.coalesce(later, F.length(q)), a["end"] + 70) - a["end"])

    other = lambda a: said(behind(a), OTHER_MONEY, low)
    out = out.withColumns({"other_parts": F.filter("parts", other), "federal_parts": F.filter("parts", lambda a: ~other(a) & said(behind(a), FEDERAL_WORD, low))})
    whole, parts = F.col("whole"), F.col("parts")
    related = is_in(TOPICS["split"])
    by_funds = (F.size("federal_parts") > 0) & ((F.size("other_parts") > 0) | whole.isNotNull())
    by_orders = (F.size(parts) >= 2) & related & (whole.isNull() | (F.abs(total_of(parts) - whole["value"]) < 1))
    years = F.when(F.contains(low, F.lit("year")) | F.contains(low, F.lit("yr")), number(F.nullif(F.regexp_extract(q, YEARS, 1), F.lit(""))).cast("double"))
    out = out.withColumns({"by_funds": by_funds, "by_orders": by_orders, "term": F.greatest(F.coalesce(years, F.lit(1.0)), F.lit(1.0)), "named_federal": is_in(FEDERAL_WORD)})
    by_funds, by_orders, years, buying = F.col("by_funds"), F.col("by_orders"), F.col("term"), F.col("buying")
    federal = F.col("named_federal") | (buying & by_funds)
    sole = is_in(TOPICS["sole_source"]) | (federal & is_in(EMERGENCY))
    out = out.withColumn("sole", buying & sole)
    out = out.withColumn("reason", F.when(F.col("sole"), first_said(q, JUSTIFICATIONS, low)))
    main = F.get(F.array_sort(parts, lambda a, b: F.when(a["value"] != b["value"], F.when(a["value"] > b["value"], -1).otherwise(1)).otherwise((a["start"] - b["start"]).cast("int"))), F.lit(0))
    one = ~by_funds & ~by_orders & whole.isNull()
    first = F.get(parts, F.lit(0))["value"]
    amount = (
        F.when(by_funds, F.coalesce(whole["value"], total_of(F.col("federal_parts")) + total_of(F.col("other_parts"))))
        .when(by_orders, first)
        .when(whole.isNotNull(), whole["value"])
        .otherwise(main["value"] * F.when(main["per_year"], years).otherwise(1.0))
    )
    award = F.when(federal, F.when(F.col("named_federal") & is_in(FEDERAL_CONTRACT), "contract").otherwise("grant"))
    term = F.when(one, years).when(by_orders & ~by_funds, 1.0).when(F.exists(parts, lambda a: a["per_year"]), 1.0).otherwise(years)
    selection = F.when(F.col("sole"), "sole_source").when(is_in(TOPICS["small_business"]), "small_business").when(is_in(PERSONAL), "professional_services").when(is_in(URGENT), "urgent")
    reason = F.when(~((F.col("reason") == "one_of_a_kind") & ~is_in(REALLY_ONE)), F.col("reason"))
    none = F.array().cast("array<double>")
    pieces = lambda text: F.transform(F.col("concrete"), lambda a, i: item(text, a, i))
    out = out.withColumns({
        "amount": F.when(buying, amount).otherwise(0.0), "award": F.when(~F.col("tagging"), award), "split_intent": buying & is_in(DIVIDED),
        "related": F.when(buying & by_orders & ~by_funds, F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda a: a["value"])).otherwise(none),
        "years": F.when(buying, term).otherwise(1.0), "duration_days": F.when(buying, duration_days(q, low)), "selection": F.when(buying, selection), "justification": F.when(buying, reason),
        "exception": F.when(buying, first_said(q, EXCEPTIONS, low)), "displaces": F.when(~F.col("tagging") & is_in(DISPLACING), True),
        "federal_part": F.when(buying & by_funds, total_of(F.col("federal_parts"))), "items": F.when(F.col("tagging"), pieces(q)).otherwise(F.array().cast("array<struct<name:string,cost:double,accessory:boolean>>")),
        "accesses_data": F.lit(None).cast("boolean"), "accesses_phi": F.lit(None).cast("boolean"), "it_services": F.lit(None).cast("boolean"), "commercial": F.lit(None).cast("boolean"),
        "topics": F.when(F.col("tagging"), F.array_sort(F.array_union("topics", F.array(F.lit("equipment"))))).otherwise(F.col("topics")),
    })
    out = out.withColumn("federal_amount", F.coalesce("federal_part", F.when(F.col("award").isNotNull(), F.col("amount")).otherwise(0.0)))
    return out.drop("_low", "by_funds", "by_orders", "term", "named_federal", "sole", "reason", "concrete", "tagging", "buying", "whole", "parts", "other_parts", "federal_parts", "federal_part")
