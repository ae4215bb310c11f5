"""Structure of texts: lines, headings, section ranges, owners, token windows, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import heading_level


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 0, line)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def headings(rows: DataFrame) -> DataFrame:
    return rows.withColumn("level", heading_level(F.col("line"))).where("level is not null")


#: Fixed value: lines that open a part of the text, which are no running headers even where they are repeated.
STRUCTURAL = r"(?i)^(?:ARTICLE|PART|SECTION)\b|^[IVXLCDM]{1,6}\.|^[A-Z]\."


def running_labels(rows: DataFrame, k: int = 3) -> DataFrame:
    """Lines (doc_id, page, pos, label) that stand among the first or last k of more than one page of their document, with keep for the first occurrence.

    A label is a whole line without the white space around it; structural markers don't run.
    """
    page = Window.partitionBy("doc_id", "page")
    edge = rows.withColumns({"up": F.row_number().over(page.orderBy("pos")), "down": F.row_number().over(page.orderBy(F.desc("pos")))}).where((F.col("up") <= k) | (F.col("down") <= k))
    edge = edge.where((F.col("label") != "") & ~F.col("label").rlike(STRUCTURAL))
    often = edge.groupBy("doc_id", "label").agg(F.count_distinct("page").alias("pages")).where("pages > 1")
    found = edge.join(often, ["doc_id", "label"])
    return found.withColumn("keep", F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("page", "pos")) == 1).drop("up", "down")


#: Distinct levels of headings in one table; Word has nine.
LEVELS = 64


def levels_of(heads: DataFrame) -> list[int]:
    """The levels that headings have, ascending."""
    found = sorted(r[0] for r in heads.select("level").where("level is not null").distinct().limit(LEVELS + 1).collect())
    if len(found) > LEVELS:
        raise ValueError(f"more than {LEVELS} levels of headings")
    return found


def section_ranges(heads: DataFrame, ends: DataFrame) -> DataFrame:
    """heads (doc_id, start, level) with end: the next heading of the same or a smaller level, else the document's end.

    Each level that occurs has its next heading from one window over the document's headings.
    """
    after = Window.partitionBy("doc_id").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("start"))).over(after)) for k in levels_of(heads)]
    following = F.least(*nexts, F.lit(None)) if nexts else F.lit(None)
    return heads.withColumn("next", following.cast("int")).join(ends, "doc_id").withColumn("end", F.coalesce("next", "end")).drop("next")


def parents(ranges: DataFrame) -> DataFrame:
    """ranges, as section_ranges() makes them, with parent: the start of the enclosing range with the greatest smaller level.

    That is the last heading before with a smaller level: none of those between ends it.
    """
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("start"))).over(before)) for k in levels_of(ranges)]
    return ranges.withColumn("parent", (F.greatest(*lasts, F.lit(None)) if lasts else F.lit(None)).cast("int"))


def owners(ranges: DataFrame, ends: DataFrame) -> DataFrame:
    """Slices (doc_id, a, b, owner) between all borders of ranges that section_ranges() made, each owned by the deepest range around it; null owns the rest.

    A range ends where another begins, or with the document, so the borders are the headings, and the deepest range at a
    place is that of the last heading.
    """
    own = ranges.select("doc_id", F.col("start").alias("a"), F.col("start").alias("owner"))
    border = own.unionByName(ends.select("doc_id", F.lit(0).alias("a"), F.lit(None).cast("int").alias("owner")))
    border = border.groupBy("doc_id", "a").agg(F.max("owner").alias("owner"))
    cut = border.withColumn("b", F.lead("a").over(Window.partitionBy("doc_id").orderBy("a")))
    return cut.join(ends, "doc_id").select("doc_id", "a", F.coalesce("b", "end").alias("b"), "owner").where("b > a")


def windows(sized: DataFrame, size: int = 240, overlap: int = 40) -> DataFrame:
    """(doc_id, window, first, last) over n tokens of each document: one window for up to `size`, else steps of size - overlap."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the window")
    step = size - overlap
    count = F.when(F.col("n") <= size, 1).otherwise(1 + F.ceil((F.col("n") - size) / step)).cast("int")
    cut = sized.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    return cut.select("doc_id", "window", (F.col("window") * step).alias("first"), F.least(F.col("window") * step + size, F.col("n")).alias("last"))


def union_intervals(rows: DataFrame) -> DataFrame:
    """(key, start, end) with overlapping and touching intervals merged; those without a start go into their key's last one, where it has one."""
    order = Window.partitionBy("key").orderBy(F.col("start").asc_nulls_last(), F.col("end").asc_nulls_last())
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    group = flagged.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return group.groupBy("key", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def chunk_stats(sizes: DataFrame) -> DataFrame:
    """One row: number, mean, least and greatest token count, small (< 80) and large (> 350) ones, and buckets."""
    t = F.col("tokens")
    between = lambda a, b: F.count_if((t >= a) & (t < b))
    return sizes.agg(
        F.count("*").alias("chunks"), F.round(F.avg(t), 6).alias("mean"), F.min(t).alias("least"), F.max(t).alias("greatest"), F.count_if(t < 80).alias("small"), F.count_if(t > 350).alias("large"),
        between(0, 80).alias("b0"), between(80, 150).alias("b80"), between(150, 300).alias("b150"), F.count_if(t >= 300).alias("b300"),
    )


#: What stands before a piece's first character while a text is cut. A text that holds it is cut there too.
CUT = "\x01\x02"
#: Lines in capitals, and numbers, letters and words that open a section.
CAPITALS = r"(?md)^[ \t]*[A-Z][A-Z\s]{4,}:?\s*$"
OPENING = (
    rf"(?mid)^(?:{CUT})?[ \t]*(?:Part\s+\d+|[IVXLCDM]{{1,6}}\.|[A-Z]\.\s|\d{{1,2}}\.\s|[a-z]\)\s|\(\d+\)\s"
    r"|SECTION|DEFINITIONS?|POLICY|PROCEDURES?|BACKGROUND|PURPOSE|SCOPE|RESPONSIBILITIES|COMPLIANCE|REFERENCES?|APPENDIX|EXHIBIT)"
)


def pieces_by_marker(text: Column) -> Column:
    """A text cut before lines that open a section, pieces of more than 20 characters; at blank lines if no line does, all that say something."""
    marked = F.regexp_replace(F.regexp_replace(text, CAPITALS, f"{CUT}$0"), OPENING, f"{CUT}$0")
    trimmed = lambda pieces: F.transform(pieces, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    sections = F.filter(trimmed(F.split(marked, CUT)), lambda s: F.length(s) > 20)
    paragraphs = F.filter(trimmed(F.split(text, r"\n\s*\n")), lambda s: s != "")
    return F.when(F.contains(marked, F.lit(CUT)), sections).otherwise(paragraphs)
