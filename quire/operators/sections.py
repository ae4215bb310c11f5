"""Sections as evidence: headings, content, promotion to parents, locations, markings, relations, page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import page_range, terms
from quire.scratch import saved

#: Fixed patterns of a chunk's own heading, and of a page's first line.
NUMBERED = r"^([IVXLCDM]+\.|[A-Z]\.|[0-9]+\.)\s+\S"
CAPITALS = r"^[A-Z][A-Z\s]{4,}$"
FIRST_LINE = r"^([A-Z][^\n]{3,80})\n"
#: Kinds of sections that can answer, and the longest parent that a chunk is promoted to.
ANSWERS, LONGEST = ("body", "table"), 12_000
HISTORY = "REVISION HISTORY"
INTERNAL, DRAFT = r"(?i)internal\s+UC\s+use\s+only", r"(?i)^\s*DRAFT\b"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def visible_lines(text: Column) -> Column:
    """The lines of a text without white space around them, empty ones left out."""
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")


def chunk_heading(chunk: Column, page: Column, given: Column) -> Column:
    """A chunk's heading: the first numbered or capital line among its first three, else the page's first line, else the given one."""
    first = F.transform(F.slice(F.split(stripped(chunk), "\n"), 1, 3), stripped)
    own = F.filter(first, lambda x: x.rlike(NUMBERED) | (x.rlike(CAPITALS) & (F.length(x) < 80)))
    on_page = stripped(F.regexp_extract(stripped(page), FIRST_LINE, 1))
    return F.coalesce(F.substring(F.get(own, F.lit(0)), 1, 80), F.nullif(on_page, F.lit("")), given, F.lit(""))


def substantive(kind: Column, title: Column, text: Column) -> Column:
    """Whether a section says something besides its title and capitals: six terms, or 25 characters with a full stop."""
    lines = visible_lines(text)
    content = F.array_join(F.filter(lines, lambda x: x != stripped(title)), " ")
    says = (F.size(terms(content)) >= 6) | ((F.length(content) >= 25) & F.contains(content, F.lit(".")))
    shouts = (F.size(lines) < 5) & F.forall(lines, lambda x: (F.upper(x) == x) & (F.lower(x) != x))
    return F.coalesce(kind.isin(*ANSWERS) & says & ~shouts, F.lit(False))


def promoted(sections: DataFrame) -> DataFrame:
    """(section, answer): the nearest section from each one upwards that is substantive; null where none is.

    sections: section, parent, title, text, kind, each section once. Below a revision history no section answers, and none
    is promoted to a text of more than LONGEST characters. Each round doubles the ancestors that a section has seen, by a
    join of ids and flags only, until all have seen theirs up to the top, or as many as there are sections on a cycle.
    """
    good = substantive(F.col("kind"), F.col("title"), F.col("text"))
    long, old = F.length("text") > LONGEST, F.contains(F.upper("title"), F.lit(HISTORY))
    flags = sections.select("section", F.col("parent").alias("at"), good.alias("good"), long.alias("long"), old.alias("old"))
    off = F.coalesce("old", F.lit(False))
    state = saved(flags.select("section", "at", F.when(F.col("good"), F.col("section")).alias("answer"), F.coalesce(F.col("good") & F.col("long"), F.lit(False)).alias("far"), off.alias("dead")))
    n, seen, done = state.count(), 1, state.where("at is null")
    open_ = state.where("at is not null")
    while seen < n and not open_.isEmpty():
        above = open_.unionByName(done).select(F.col("section").alias("at"), F.col("at").alias("up"), F.col("answer").alias("a"), F.col("far").alias("f"), F.col("dead").alias("d"))
        far = F.when(F.col("answer").isNull(), F.coalesce("f", F.lit(False))).otherwise(F.col("far"))
        met = saved(open_.join(above, "at", "left").select("section", F.col("up").alias("at"), F.coalesce("answer", "a").alias("answer"), far.alias("far"), (F.col("dead") | F.coalesce("d", F.lit(False))).alias("dead")))
        done, open_, seen = done.unionByName(met.where("at is null")), met.where("at is not null"), 2 * seen
    own = F.col("answer") == F.col("section")
    return done.unionByName(open_).select("section", F.when(~F.col("dead") & (own | ~F.col("far")), F.col("answer")).alias("answer"))


def locations(spans: DataFrame, blocks: DataFrame, width: int = 4096) -> DataFrame:
    """(doc_id, span, pages, n): of each span (doc_id, span, start, end) the page range and number of the blocks (doc_id, start, end, page) it overlaps.

    Spans and blocks meet on the stretches of `width` characters that they touch, so that a long document is many keys
    and not all its pairs are compared; a pair counts in the stretch where its overlap begins.
    """
    touch = lambda t: t.withColumn("stretch", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"greatest(end - 1, start) div {width}"))))
    s = touch(spans.select("doc_id", "span", "start", "end")).withColumnsRenamed({"start": "a", "end": "b"})
    met = s.join(touch(blocks.select("doc_id", "start", "end", "page")), ["doc_id", "stretch"])
    hit = met.where((F.col("start") < F.col("b")) & (F.col("a") < F.col("end")) & (F.expr(f"greatest(a, start) div {width}") == F.col("stretch")))
    out = hit.groupBy("doc_id", "span").agg(F.collect_set("page").alias("pages"), F.count("*").alias("n"))
    return out.select("doc_id", "span", page_range(F.col("pages")).alias("pages"), "n")


def marked(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """documents (doc_id, classification) after the markings in their blocks (doc_id, kind, text): promoted ones, notes for internal use and drafts."""
    draft = F.col("kind").isin("header", "footer") & F.col("text").rlike(DRAFT)
    seen = blocks.groupBy("doc_id").agg(F.bool_or(F.col("text").rlike(INTERNAL)).alias("internal"), F.bool_or(draft).alias("draft"))
    out = documents.join(seen, "doc_id", "left").withColumns({"internal": F.coalesce("internal", F.lit(False)), "draft": F.coalesce("draft", F.lit(False))})
    up = F.col("internal") & (F.col("classification") == "public")
    return out.withColumns({"promoted": up, "classification": F.when(up, "internal").otherwise(F.col("classification"))})


def relation_problem(relation: Column, quotes: Column, conditions: Column, reviewer: Column, day: Column) -> Column:
    """What is wrong with a relation: no evidence or an empty quote; an override without conditions, reviewer and ISO date."""
    none = F.coalesce(F.size(quotes) <= 0, F.lit(True)) | F.exists(quotes, lambda q: F.coalesce(stripped(q) == "", F.lit(True)))
    short = (F.coalesce(F.size(conditions), F.lit(0)) <= 0) | (F.coalesce(stripped(reviewer), F.lit("")) == "") | (F.coalesce(day, F.lit("")) == "")
    wrong = F.try_to_timestamp(F.when(day.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)?(Z|[+-]\d\d:\d\d)?$"), F.regexp_extract(day, r"^([\d-]{10})", 1))).isNull()
    return F.when(none, "no evidence").when((relation == "overrides") & short, "not reviewed").when((relation == "overrides") & wrong, "not a date")


def contains(sections: DataFrame) -> DataFrame:
    """(source, target, quote): each section from its parent, or from its document where it has none; the quote is its first 160 characters."""
    source = F.coalesce(F.concat(F.lit("section:"), F.col("parent").cast("string")), F.concat(F.lit("document:"), F.col("doc_id").cast("string")))
    return sections.select(source.alias("source"), F.concat(F.lit("section:"), F.col("section").cast("string")).alias("target"), stripped(F.substring("text", 1, 160)).alias("quote"))


def named_sources(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(q_id, targets): the documents whose aliases a question names, the longest alias first where they overlap.

    Aliases of four letters and digits or more count. They meet questions on their first word.
    """
    key = lambda c: stripped(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    known = aliases.select("target", key("alias").alias("alias")).where(F.length(F.regexp_replace("alias", " ", "")) >= 4)
    known = known.groupBy("alias").agg(F.min("target").alias("target")).withColumn("word", F.element_at(F.split("alias", " "), 1))
    asked = questions.select("q_id", F.concat(F.lit(" "), key("question"), F.lit(" ")).alias("q"))
    words = asked.select("q_id", "q", F.explode(F.array_distinct(F.split(F.trim("q"), " "))).alias("word"))
    hit = words.join(known, "word").where(F.contains("q", F.concat(F.lit(" "), F.col("alias"), F.lit(" "))))
    ordered = hit.groupBy("q_id", "q").agg(F.array_sort(F.collect_list(F.struct((-F.length("alias")).alias("n"), "alias", "target"))).alias("hits"))
    start = F.struct(F.col("q").alias("rest"), F.array().cast("array<bigint>").alias("targets"))

    def take(s: Column, h: Column) -> Column:
        spaced = F.concat(F.lit(" "), h["alias"], F.lit(" "))
        # a taken alias leaves a mark that no other alias can span
        return F.when(F.contains(s["rest"], spaced), F.struct(F.replace(s["rest"], spaced, F.lit(" | ")).alias("rest"), F.array_append(s["targets"], h["target"].cast("bigint")).alias("targets"))).otherwise(s)

    return ordered.select("q_id", F.array_sort(F.array_distinct(F.aggregate("hits", start, take)["targets"])).alias("targets"))


def swapped(results: DataFrame, key: DataFrame) -> DataFrame:
    """results (id, question, truth) with the truth of an answer key (question, answer) where it has one, and whether that changed it."""
    out = results.join(key.groupBy("question").agg(F.min("answer").alias("answer")), "question", "left")
    now = F.coalesce("answer", "truth")
    return out.select("id", "question", now.alias("truth"), (~now.eqNullSafe(F.col("truth"))).alias("changed"), F.col("answer").isNotNull().alias("matched"))


def listed(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each question (q_id, section, kind, chars, score): bodies and tables before other kinds, short ones last, then the score; 1 to 100 rows."""
    order = Window.partitionBy("q_id").orderBy((~F.col("kind").isin(*ANSWERS)).cast("int"), (F.col("chars") < 120).cast("int"), F.desc("score"), "section")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= min(max(most, 1), 100))
