"""Questions: topics, amounts in context, gates, policy ladders, refusals and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let, said

# Fixed patterns of the topics, in the order of their names' declaration.
#: Without the look-behinds that topics() puts before it, since SQL engines without them take it too.
FEDERAL = r"\b(federal(ly)?|nih|nsf|doe|dod|nasa|usda|darpa|noaa|hhs|uniform guidance|2 cfr)\b"
SPLIT = (
    r"same (vendor|supplier|company)|\bsplit|break (it |this |them |the purchase )?up|\bdivid|separate (purchase )?orders|(two|three|several|multiple) (separate )?(purchase )?orders"
    r"|to avoid (the )?(competitive )?bid|stay (under|below)|smaller orders|independent purchases|separate purchases|without triggering"
)
TOPICS = {
    "bid": r"competitive(ly)? bid|bidding|bid threshold|formal bid|\bbid\b",
    "sspr": r"\bsspr\b|source selection|price reasonableness",
    "federal": FEDERAL,
    "mixed": r"mixed fund|portion|state funds?|departmental|discretionary|federal fund\w* .{0,30}exceed",
    "multi_year": r"multi-?year|\d+-year|(three|five|\d) years?|per year|annual",
    "small_business": r"small business|\bdvbe\b|disabled veteran",
    "sole_source": r"sole.?source|single.?source|only (one|a single) (vendor|supplier|manufacturer|source|company)|one.of.a.kind|only available from|no other (manufacturer|vendor|supplier)",
    "split": SPLIT,
    "equipment": r"\btag(ged|ging)?\b|inventorial|capitaliz|\bcaan\b|bus-29|asset management",
    "micro": r"micro-?purchase",
    "sat": r"simplified acquisition",
    "covered": r"contract(ing)? out|covered services?|regents policy 5402|afscme|wage parity",
    "post_employment": r"former (uc |university |campus )?(employee|staff|official|director|manager)|ex-?employee|\bretire[ds]?\b|\bretiree|\bretiring\b|left (the )?(university|uc)\b|post-?employment|after (leaving|retir\w+)|used to work (at|for) (uc|the university)|no longer (works?|employed)",
    "business_meal": r"business (meal|meeting|lunch|dinner|breakfast)|entertainment (expense|event|check)|meal expense|\b(catering|caterer|reception|banquet|refreshments)\b|(lunch|dinner|breakfast|meal)s? (for|with|at) |hospitality expense",
    "alcohol_permit": r"tax-?free (alcohol|permit)|alcohol (permit|use permit)|\b(190|200)-?proof\b|\bethanol\b|\bttb\b|alcohol free of tax",
    "risk_matrix": r"certificate of insurance|\bcoi\b|risk matrix|risk level|risk exposure|(high|moderate|low)[- ]risk",
}
RULE_TOPICS = tuple(t for t in TOPICS if t != "federal")
TEMPLATE_TOPICS = ("bid", "sspr", "federal", "micro", "sat", "small_business", "equipment", "mixed")
NOT_TEMPLATED = ("split", "sole_source", "covered", "post_employment", "business_meal", "alcohol_permit", "risk_matrix")
TEMPLATE_INTENTS = ("bidding_threshold", "sspr_form", "federal_funding", "equipment_tagging")


def topics(text: Column) -> Column:
    """The topics of a text, sorted. Federal doesn't count right behind "non-" or "non "."""
    found = lambda low: F.array(*(F.when(said(text, rf"(?<!non-)(?<!non ){p}" if t == "federal" else p, low), t) for t, p in TOPICS.items()))
    return let(F.lower(text), lambda low: F.array_sort(F.array_compact(found(low))))


# Fixed patterns of the amounts and of what stands around them.
AMOUNT = r"\$\s?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*(?i:k|m|mm|million|thousand)?\b|\b\d+(?:\.\d+)?\s?[kK]\b"
TIMES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mm": 1e6, "million": 1e6}
BEFORE = r"((threshold|limit|maximum|minimum|cap)\s*(is|of|at|amount of)?\s*(the\s+)?|\b(under|below|over|exceeds?|exceeding|above|than|up to|at least|within)\s+(the\s+)?(approximately\s+)?)$"
AFTER = r"^\s*(\w+\s+){0,2}(threshold|limit|per occurrence|umbrella|coverage|insurance|policy limit|grant\b|award\b|budget\b)"
TOTAL = r"(total(ing|s)?|in total|combined|bringing .{0,40}to|overall|altogether)\s*(of|is|to)?\s*(about|approximately|roughly)?\s*$"
YEARLY = r"^\s*(/\s*(year|yr)|per\s+(year|yr|annum)|a\s+year|each\s+year|annually|every\s+year)"
INSURED = r"insurance|liability|umbrella|per occurrence|coverage|policy limit"


def amounts(text: Column) -> Column:
    """The amounts of a text with their start and end, and whether what stands around makes each a reference, a total or a yearly one.

    Dollar amounts, and bare ones in thousands such as 25k. Offsets are sums of the lengths of amounts and of the pieces
    between them; context is 45 characters before, 40 after, and for insurance the sentence.
    """
    amount = f"(?=[$0123456789])(?:{AMOUNT})"
    gaps = F.split(F.regexp_replace(F.translate(text, "\1", "\2"), amount, "\1"), "\1")
    found = F.struct(F.lower(text).alias("low"), F.regexp_extract_all(text, F.lit(amount), F.lit(0)).alias("hits"), gaps.alias("gaps"))
    none = F.array().cast("array<struct<value:double,start:int,end:int,reference:boolean,total:boolean,per_year:boolean>>")
    number = lambda h: F.regexp_replace(F.regexp_extract(h, r"([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("double")
    unit = lambda h: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in TIMES.items() for x in p)), F.lower(F.regexp_extract(h, r"([A-Za-z]+)$", 1))), F.lit(1.0))

    def one(f: Column, h: Column, before: Column) -> Column:
        end, low = before + F.length(h), f["low"]
        left = F.substring(text, F.greatest(before - 44, F.lit(1)), F.least(before, F.lit(45)))
        right = F.substring(text, end + 1, F.lit(40))
        sentence = F.concat(F.regexp_extract(F.substring(text, F.lit(1), before), r"(?s)^(?:.*[.?] )?(.*)\z", 1), h, F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"(?s)^(.*?)(?:[.?] |\z)", 1))
        reference = said(left, BEFORE, low) | said(right, AFTER, low) | said(sentence, INSURED, low)
        return F.struct((number(h) * unit(h)).alias("value"), before.alias("start"), end.alias("end"), reference.alias("reference"), said(left, TOTAL, low).alias("total"), said(right, YEARLY, low).alias("per_year"))

    def start(f: Column, i: Column) -> Column:
        return F.aggregate(F.slice(f["gaps"], 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice(f["hits"], 1, i), F.lit(0), lambda a, h: a + F.length(h))

    every = lambda f: F.transform(f["hits"], lambda h, i: let(start(f, i), lambda at: one(f, h, at)))
    return F.when(text.rlike(r"\d"), F.filter(let(found, every), lambda a: a["value"] > 0)).when(text.isNotNull(), none)


def gates(rows: DataFrame) -> DataFrame:
    """Adds use_rules and template to rows (topics, amount, covered, intent): whether the rules can decide, and whether fixed facts answer."""
    has = lambda names: F.arrays_overlap("topics", F.array(*map(F.lit, names)))
    template = (F.col("amount") == 0) & F.col("intent").isin(*TEMPLATE_INTENTS) & has(TEMPLATE_TOPICS) & ~has(NOT_TEMPLATED)
    return rows.withColumns({"use_rules": (F.col("amount") > 0) | has(RULE_TOPICS) | F.col("covered"), "template": template})


# Fixed patterns of the ladders. Those of former employees and of meals are longer than their topics' on purpose.
FORMER = r"former (uc |university |campus )?(employee|staff|official|director|manager|dean|chancellor)|ex-?employee|\bretire[ds]?\b|\bretiree|\bretiring\b|left (the )?(university|uc)\b|post-?employment|after (leaving|retir\w+)|used to work (at|for) (uc|the university)|recently (left|departed|separated)|no longer (works?|employed)"
CONTRACTING = r"\b(contract\w*|hire|hiring|hired|bid\w*|vendor|supplier|consult\w*|award\w*|procure\w*|rfp|rfq|purchase order|ban|post-?employment)\b"
DECIDED = r"negotiat|\bplanning\b|arrangements?|decision-?making|part of the decision|(helped|involved in) (select|choos|evaluat|award|draft|write|writ|develop)|wrote the (spec|rfp|rfq|requirements)|evaluated (the )?(bids?|proposals?)|managed (the|this) (contract|vendor|supplier)|approved (the )?(contract|purchase|award)|on the (selection|evaluation) (committee|panel)"
POLICYMAKER = r"policy-?making|\b(director|dean|chancellor|provost|vice president|chief|department head|head of|associate vice|assistant vice|manager|supervisor)\b"
SAME_UNIT = r"same department|(their|his|her) (former|old|previous) (department|unit|office)|department (he|she|they) (left|worked|used to work|came from)|(the|our) department (that )?(he|she|they) (was|were) in|back into (the|their) (own )?department|former (department|unit)"
REPRESENTING = r"represent(ing)? (another|a|the|an outside) (person|party|company|vendor|supplier|client|firm)|appear(ing)? before|lobby|on behalf of (a|an|the|another) (vendor|company|client|supplier|firm)"
MEAL = r"business (meal|meeting|lunch|dinner|breakfast)|entertainment (expense|event|check request)|meal expense|\b(catering|caterer|reception|banquet|refreshments)\b|(lunch|dinner|breakfast|meal)s? (for|with|at) |hospitality expense|working (lunch|dinner)"
INSURANCE = r"\binsurance\b|\bindemnif|\bliability (policy|limit|coverage|insurance)|per occurrence"
RISK = TOPICS["risk_matrix"]
EXPOSURES = {
    "C": r"\bp3\b|\bp4\b|protected level [34]|\b(phi|hipaa|ssn|social security numbers?|credit card|payment card|pci)\b|vra.{0,30}(high|critical)",
    "D": r"construction|renovation|hazardous|biohazard|chemical|security (guard|service)|building maintenance|elevator|scaffold|demolition|asbestos|electrical work",
    "E": r"\b(medical|legal|accounting|architect\w*|engineering) services?\b|\b(attorney|law firm|cpa|auditor|architect|engineer)s?\b",
    "F": r"controlled substance|medical device|implant|prescription|human stem cell|critical care equipment",
    "G": r"\binternational\b|overseas|foreign (entity|vendor|company|supplier)|outside (of )?the (u\.?s\.?|united states)|abroad",
    "H": r"\bminors?\b|under (18|eighteen)|\bstudents?\b.{0,40}(supervis|care|custody|camp|field trip)|(camp|field trip|tutoring|youth program)",
    "I": r"use of (uc |university |our )?(facilit|space|building|room|field|auditorium)|facilit(y|ies) use agreement|\blease\b|rent(ing)? (our|uc|university|campus) (space|facilit|building)",
    "J": r"\bcash\b|cash equivalent|bank account|investment|revenue shar|handle(s|d)? (uc |university )?(money|funds|payments)|point of sale|ticket sales",
    "K": r"\btransport(ing|ation)?\b|\bshuttle\b|\bbus(es)?\b|charter|drive (students|staff|faculty)|\bdriver\b",
}
MODERATE = r"\bp2\b|protected level 2|generative (ai|artificial)|\bai\b (model|tool|service)|third-?party analytics|vra.{0,30}moderate"
LOW = r"\bp1\b|protected level 1|public data|vra.{0,30}(minimal|low)"


def post_employment(text: Column) -> Column:
    """Which rung holds for a former employee: retiree, two years, 12 months, representing, check; null for other texts."""

    def rung(low: Column) -> Column:
        is_in = lambda p: said(text, p, low)
        ladder = (
            F.when(is_in(r"\bretire") & ~is_in(REPRESENTING), "retiree")
            .when(is_in(DECIDED), "two_years")
            .when(is_in(POLICYMAKER) & is_in(SAME_UNIT), "12_months")
            .when(is_in(REPRESENTING), "representing")
            .otherwise("check")
        )
        return F.when(is_in(FORMER) & is_in(CONTRACTING), ladder)

    return let(F.lower(text), rung)


def business_meal(text: Column) -> Column:
    documents = r"document|reimburs|receipt|expense|claim|approv"
    return let(F.lower(text), lambda low: said(text, MEAL, low) & ~(said(text, INSURANCE, low) & ~said(text, documents, low)))


def risk(text: Column) -> Column:
    """high with the exposures, moderate, low or rule; null where the matrix isn't asked for."""

    def level(low: Column) -> Column:
        is_in = lambda p: said(text, p, low)
        found = F.array_join(F.array_compact(F.array(*(F.when(is_in(p), k) for k, p in EXPOSURES.items()))), "")
        of = lambda letters: F.when(is_in(RISK) | (letters != ""), F.when(letters != "", F.concat(F.lit("high:"), letters)).when(is_in(MODERATE), "moderate").when(is_in(LOW), "low").otherwise("rule"))
        return F.when(is_in(RISK) | is_in(INSURANCE), let(found, of))

    return let(F.lower(text), level)


# Fixed patterns of the alcohol permit ladder.
ALCOHOL = TOPICS["alcohol_permit"]
PERMIT_NOTES = {
    "dea": r"\bdea\b",
    "scheduled": r"inventory (is )?(scheduled|planned|set|booked) (for )?(next|this|in|on)|(next|this) (week|month).{0,30}inventory|inventory.{0,30}(next|this) (week|month)",
    "overdue": r"(haven'?t|have not|hasn'?t|has not|no|never|without|last) .{0,40}inventory|inventory .{0,40}(last year|a year ago|over (six|6) months|overdue|annual)|annual inventory",
    "leaving": r"(pi|investigator|holder|professor|faculty).{0,60}(retir|leav|depart)|(retir|leav|depart).{0,60}(pi\b|investigator|permit)",
}


def alcohol(text: Column) -> Column:
    """The notes that go with the rule on permits for tax-free alcohol; an overdue inventory only where none is scheduled. Null for other texts."""
    notes = {k: said(text, p) for k, p in PERMIT_NOTES.items()}
    notes["overdue"] = notes["overdue"] & ~notes["scheduled"]
    return F.when(said(text, ALCOHOL), F.array_join(F.array_compact(F.array(*(F.when(v, k) for k, v in notes.items()))), ","))


# Fixed pattern of vague replies.
VAGUE = r"(excerpts?|provided (text|context|documents?)|sources?) (do(es)? not|don't) (contain|provide|specify|mention|address|include)|not (specified|mentioned|addressed|covered) in the|insufficient (information|evidence)|cannot (be )?(determine|answer)d?"


def refused(answer: Column, best: Column, decided: Column) -> Column:
    """Whether a reply is a refusal: the best passage below the floor without a rule, an empty or a vague answer."""
    return (~decided & (best < -8.0)) | ~F.coalesce(answer, F.lit("")).rlike(r"\S") | said(answer, VAGUE)


def citation(policy: Column, page: Column, section: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(~blank(page), F.concat(policy, F.lit(", p."), page)).when(~blank(section), F.concat(policy, F.lit(" ("), section, F.lit(")"))).otherwise(policy)


def reply_parts(text: Column) -> Column:
    """(answer, conditions) of a reply; lines under Rule or Source are dropped, conditions without text are None."""
    # not by split(), which compiles its pattern again for each row
    first = lambda t: F.regexp_replace(t, r"(?im)^\s*\**(?:Rule|Source)s?\**\s*:(?s:.*)", "")
    conditions = r"(?im)^\s*\**Conditions\**\s*:\s*((?s:.*))"
    answer = F.regexp_replace(F.trim(first(F.regexp_replace(text, conditions, ""))), r"(?i)^\s*\**Answer\**\s*:\s*", "")
    rest = F.trim(F.regexp_replace(first(F.coalesce(F.regexp_extract(text, conditions, 1), F.lit(""))), r"^\s+|\s+$", ""))
    return F.struct(F.trim(F.regexp_replace(answer, r"\s+", " ")).alias("answer"), F.when(rest == "", "None").otherwise(rest).alias("conditions"))


def excerpt(text: Column, match: Column, size: int = 400) -> Column:
    """About `size` characters around the first place of a match, from a line's start to a line's end; null without one."""
    at = F.instr(text, match)
    begin = F.greatest(at - size // 2, F.lit(1))
    part = F.substring(text, begin, F.lit(size))
    inward = F.when(begin > 1, F.regexp_replace(part, r"^[^\n]*\n", "")).otherwise(part)
    inward = F.when(F.contains(inward, match), inward).otherwise(part)
    tail = F.regexp_replace(inward, r"\n[^\n]*$", "")
    return F.when(at > 0, F.when(F.contains(tail, match) & (begin + size <= F.length(text)), tail).otherwise(inward))
