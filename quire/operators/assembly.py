"""Evidence for answers: body texts, clipped blocks, quotes by number or by text, verified claims, passages and one reference hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import search_terms, terms
from quire.operators.retrieval import K1, TIES, B
from quire.scratch import saved

#: Fixed equivalents of typographic marks, one for one.
TYPOGRAPHY = ("‐‑–—’‘“”", "----''\"\"")
ANCILLARY_KINDS = ("header", "footer", "footnote")
ANCILLARY_PARTS = r"^word/(header|footer|footnotes|endnotes)"
BLANK = r"\n\s*\n"


def body_positions(blocks: DataFrame) -> DataFrame:
    """The body's blocks (doc_id, ordinal, kind, part, text) with start and end in the text that joins them by blank lines; no blank line before the first text."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    body = blocks.where(~F.col("kind").isin(*ANCILLARY_KINDS) & ~F.coalesce("part", F.lit("")).rlike(ANCILLARY_PARTS))
    body = body.withColumn("chars", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    start = F.col("chars") + 2 * F.sum((F.col("chars") > 0).cast("int")).over(order)
    return body.withColumn("start", start).withColumn("end", F.col("start") + F.length("text")).drop("chars")


def clipped(sections: DataFrame, blocks: DataFrame, width: int = 4096) -> DataFrame:
    """(doc_id, section, block, start, end, source_start, source_end): what of each block (doc_id, block, start, end) is in each section (doc_id, section, start, end).

    start and end are within the section, the source ones within the block. They meet on the stretches of `width`
    characters that both touch; a pair counts in the stretch where its overlap begins.
    """
    touch = lambda t: t.withColumn("stretch", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"greatest(end - 1, start) div {width}"))))
    s = touch(sections.select("doc_id", "section", "start", "end")).withColumnsRenamed({"start": "a", "end": "z"})
    met = s.join(touch(blocks.select("doc_id", "block", "start", "end")), ["doc_id", "stretch"])
    low, high = F.greatest("a", "start"), F.least("z", "end")
    met = met.where((F.col("end") > F.col("a")) & (F.col("start") < F.col("z")) & (F.expr(f"greatest(a, start) div {width}") == F.col("stretch")))
    return met.select("doc_id", "section", "block", (low - F.col("a")).alias("start"), (high - F.col("a")).alias("end"), (low - F.col("start")).alias("source_start"), (high - F.col("start")).alias("source_end"))


def quote_spans(text: Column, borders: Column) -> Column:
    """Numbered parts (quote_id, start, end, quote) of a text between its borders and blank lines, without white space around them."""
    hits, gaps = F.regexp_extract_all(text, F.lit(f"({BLANK})"), F.lit(1)), F.split(text, BLANK, -1)
    sizes = F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h))  # null for the last gap, which no blank line ends
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["ends"], F.array(s["at"] + n)).alias("ends"))
    after = F.aggregate(F.filter(sizes, lambda n: n.isNotNull()), start, step)["ends"]
    inside = F.filter(F.transform(borders, lambda b: b.cast("int")), lambda b: (b > 0) & (b < F.length(text)))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.length(text)), inside, after)))
    ends = F.slice(cuts, F.lit(2), F.greatest(F.size(cuts) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), ends, lambda a, b: F.struct(a.alias("a"), F.substring(text, a + 1, b - a).alias("s")))
    said = F.filter(pairs, lambda p: p["s"].rlike(r"\S"))

    def one(p: Column, i: Column) -> Column:
        bare = F.regexp_replace(p["s"], r"^\s+", "")
        start = p["a"] + F.length(p["s"]) - F.length(bare)
        bare = F.regexp_replace(bare, r"\s+$", "")
        return F.struct((i + 1).alias("quote_id"), start.alias("start"), (start + F.length(bare)).alias("end"), bare.alias("quote"))

    return F.transform(said, one)


def located(quote: Column, text: Column) -> Column:
    """(start, end) of a quote's first place in a text, whatever its white space and typographic marks; null where it is absent or has under 20 characters."""
    plain = lambda c: F.translate(c, *TYPOGRAPHY)
    words = F.filter(F.split(plain(quote), r"\s+"), lambda w: w != "")
    pattern = F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1")), r"\s+")
    at = F.regexp_instr(plain(text), pattern) - 1
    hit = F.call_function("regexp_extract", plain(text), pattern, F.lit(0))
    return F.when((F.length(F.array_join(words, " ")) >= 20) & (at >= 0), F.struct(at.alias("start"), (at + F.length(hit)).alias("end")))


def numbers(text: Column) -> Column:
    """The distinct numbers of a text without thousands commas; policy numbers such as BUS-43 are none."""
    bare = F.regexp_replace(text, r"(?i)\bBUS[-\s]?\d+\b", "")
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda n: F.regexp_replace(n, ",", "")))


def verified(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Each claim (q_id, claim, text, support) with problem, quotes, cited and line; support lists (source_id, quote_id, quote), one of the last two.

    passages: (q_id, source_id, text, borders). A claim stands if its text isn't blank and has no citation of its own, each
    support is a numbered part or a located quote of a passage, and all its numbers are in its quotes.
    """
    kept = passages.select("q_id", "source_id", F.col("text").alias("passage"), quote_spans(F.col("text"), F.col("borders")).alias("spans"))
    each = claims.select("q_id", "claim", "text", F.posexplode_outer("support").alias("place", "s")).select("q_id", "claim", "text", "place", "s.source_id", "s.quote_id", "s.quote")
    met = each.join(kept, ["q_id", "source_id"], "left")
    place = located(F.col("quote"), F.col("passage"))
    by_text = F.expr("substring(passage, at.start + 1, at.end - at.start)")
    met = met.withColumn("at", place)
    found = F.when(F.col("quote_id").isNotNull(), F.get("spans", F.col("quote_id") - 1)["quote"]).otherwise(by_text)
    met = met.withColumn("found", found)
    wrong = F.when(F.col("place").isNull(), "no support").when(F.col("passage").isNull(), "unknown source").when(F.col("found").isNull(), F.when(F.col("quote_id").isNotNull(), "unknown part").otherwise("absent quote"))
    rows = F.array_sort(F.collect_list(F.struct("place", "source_id", "found", wrong.alias("wrong"))))  # a claim has six supports at most
    out = met.groupBy("q_id", "claim").agg(F.first("text").alias("text"), rows.alias("rows"))
    quotes = F.transform("rows", lambda r: r["found"])
    bad = F.get(F.filter(F.transform("rows", lambda r: r["wrong"]), lambda w: w.isNotNull()), F.lit(0))
    cited = F.array_sort(F.array_distinct(F.transform("rows", lambda r: r["source_id"])))
    unsupported = F.size(F.array_except(numbers(F.col("text")), numbers(F.array_join(quotes, " ")))) > 0
    problem = F.when(~F.col("text").rlike(r"\S"), "blank").when(F.col("text").rlike(r"\[\d+\]"), "own citation").when(bad.isNotNull(), bad).when(unsupported, "number without evidence")
    line = F.concat(F.trim("text"), F.lit(" "), F.array_join(F.transform(cited, lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))), " "))
    return out.select("q_id", "claim", problem.alias("problem"), quotes.alias("quotes"), cited.alias("cited"), line.alias("line"))


def window(text: Column, start: Column, end: Column, limit: Column) -> Column:
    """(a, b): the whole text up to limit characters, else about limit around a match, from behind a blank line to before one."""
    whole = F.length(text) <= limit
    a = F.greatest(F.lit(0), F.floor((start + end) / 2).cast("int") - F.floor(limit / 2).cast("int"))
    b = F.least(F.length(text), a + limit)
    first = F.instr(F.substring(text, a + 1, F.greatest(start - a, F.lit(0))), "\n\n")
    rest = F.substring(text, end + 1, F.greatest(b - end, F.lit(0)))
    last = F.instr(F.reverse(rest), "\n\n")
    low, high = F.when(first > 0, a + first + 1).otherwise(a), F.when(last > 0, end + F.length(rest) - last - 1).otherwise(b)
    return F.when(whole, F.struct(F.lit(0).alias("a"), F.length(text).alias("b"))).otherwise(F.struct(low.cast("int").alias("a"), high.cast("int").alias("b")))


PICK = "struct<section:bigint,doc_id:bigint,a:int,b:int,text:string,edge:bigint>"


def add(state: Column, x: Column, most: int, budget: int, each: int, least: int) -> Column:
    """state (picks, used) with a candidate (section, doc_id, start, end, text, edge), if it is new, adds text that no pick has, and fits."""
    picks, left = state["picks"], F.lit(budget) - state["used"]
    w = window(x["text"], x["start"], x["end"], F.least(F.lit(each), left))
    part = F.substring(x["text"], w["a"] + 1, w["b"] - w["a"])
    again = F.exists(picks, lambda p: (p["section"] == x["section"]) | ((p["doc_id"] == x["doc_id"]) & (F.contains(p["text"], x["text"]) | F.contains(x["text"], p["text"]))))
    go = (F.size(picks) < most) & (left >= least) & ~again & (x["end"] - x["start"] <= w["b"] - w["a"])
    pick = F.struct(x["section"].alias("section"), x["doc_id"].alias("doc_id"), w["a"].alias("a"), w["b"].alias("b"), part.alias("text"), x["edge"].alias("edge"))
    return F.when(go, F.struct(F.concat(picks, F.array(pick)).alias("picks"), (state["used"] + w["b"] - w["a"]).alias("used"))).otherwise(state)


def hop_ranked(named: DataFrame, sections: DataFrame, questions: DataFrame, most: int = 30) -> DataFrame:
    """(q_id, edge, section, rank): for references (q_id, edge, target_doc, target_section, label) that questions (q_id, question) meet, the sections (section, doc_id, text) of the target, best first.

    The query is the question with the target's label; frequencies are those of the target's sections alone. Sections
    without any of its terms aren't ranked; ties by section.
    """
    query = F.array_distinct(search_terms(F.concat_ws(" ", "question", "label")))
    pairs = named.join(questions, "q_id").select("q_id", "edge", "target_doc", "target_section", query.alias("query"))
    own = sections.select("section", F.col("doc_id").alias("target_doc"), terms(F.col("text")).alias("t"))
    met = pairs.join(own, "target_doc").where("target_section is null or target_section = section").select("q_id", "edge", "section", "t", "query", F.size("t").alias("len"))
    totals = met.groupBy("q_id", "edge").agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg"))
    count = F.transform("query", lambda w: F.struct(w.alias("term"), F.size(F.filter("t", lambda x: x == w)).alias("f")))
    hits = met.select("q_id", "edge", "section", "len", F.explode(count).alias("x")).select("q_id", "edge", "section", "len", "x.term", "x.f").where("f > 0")
    df = hits.groupBy("q_id", "edge", "term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = hits.join(df, ["q_id", "edge", "term"]).join(totals, ["q_id", "edge"]).groupBy("q_id", "edge", "section").agg(F.round(F.sum(part), TIES).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q_id", "edge").orderBy(F.desc("score"), "section"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("q_id", "edge", "section", "rank")


def assembled(ranked: DataFrame, edges: DataFrame, sections: DataFrame, questions: DataFrame, first: int = 4, most: int = 6, hops: int = 2, budget: int = 24_000, each: int = 12_000, least: int = 500) -> DataFrame:
    """(q_id, picks, used): passages of ranked sections, four of them first, and up to two more by one reference hop, six in all.

    ranked: (q_id, rank, section, doc_id, start, end, text), a top-k of each question (q_id, question). edges: (edge,
    source, target_doc, target_section or null, label, quote), references whose quote stands in the source section.
    sections: (section, doc_id, start, end, text), from which a reference's section is taken: the best one for question
    and label, by hop_ranked(), that can be added.
    """
    none = F.struct(F.array().cast(f"array<{PICK}>").alias("picks"), F.lit(0).alias("used"))
    x = F.struct("rank", "section", "doc_id", "start", "end", "text", F.lit(None).cast("bigint").alias("edge"))
    rows = ranked.groupBy("q_id").agg(F.array_sort(F.collect_list(x)).alias("rows"))
    base = saved(rows.select("q_id", F.aggregate("rows", none, lambda s, r: add(s, r, first, budget, each, least)).alias("s")))
    here = base.select("q_id", F.posexplode("s.picks").alias("place", "p")).select("q_id", "place", F.col("p.section").alias("source"), F.col("p.doc_id").alias("from_doc"), F.col("p.text").alias("passage"))
    named = here.join(edges, "source").where(F.contains("passage", "quote") & (F.col("target_doc") != F.col("from_doc")))
    named = saved(named.select("q_id", "place", "edge", "target_doc", "target_section", "label"))
    best = hop_ranked(named.drop("place").distinct(), sections, questions)
    met = named.select("q_id", "place", "edge").join(best, ["q_id", "edge"]).join(sections, "section")
    y = F.struct("place", "edge", "rank", "section", "doc_id", "start", "end", "text")
    more = met.groupBy("q_id").agg(F.array_sort(F.collect_list(y)).alias("more"))  # sections of the documents that four passages name
    state = F.struct(F.col("s.picks").alias("picks"), F.col("s.used").alias("used"))

    def hop(s: Column, r: Column) -> Column:
        came = F.filter(s["picks"], lambda p: p["edge"].isNotNull())
        go = (F.size(came) < hops) & ~F.exists(came, lambda p: p["edge"] == r["edge"])
        return F.when(go, add(s, r, most, budget, each, least)).otherwise(s)

    out = base.join(more, "q_id", "left").select("q_id", F.when(F.col("more").isNull(), state).otherwise(F.aggregate("more", state, hop)).alias("s"))
    return out.select("q_id", "s.picks", "s.used")


def rewritten(terms: Column, model: Column, question: Column) -> Column:
    """What to search for: an intent's terms, else a model's keywords, else the question; white space is collapsed and blank ones count as missing."""
    said = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.coalesce(said(terms), said(model), said(question))


def model_windows(sized: DataFrame, limit: int, special: int, size: int = 240, overlap: int = 40, spare: int = 8) -> DataFrame:
    """Token windows (doc_id, window, first, last, tokens) that a model of `limit` tokens can take whole with its special ones; no usable budget is refused."""
    from quire.operators.structure import windows

    budget = min(size, limit - special - spare)
    if budget < 2:
        raise ValueError("the model has no usable input")
    return windows(sized, budget, min(overlap, budget - 1)).withColumn("tokens", F.col("last") - F.col("first") + special)
