"""Pages laid out in runs of characters: body size, lines, headings by their looks, and links' targets.

A reader of page files gives runs (file, page, line, ordinal, text, x0, top, x1, bottom, size, font), a run being one or
more characters set alike; boxes of tables (file, page, x0, top, x1, bottom); and link annotations with their bytes.
Everything here is built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.scratch import saved

#: White space, as \\s has it.
BLANKS = " \t\n\x0b\f\r"
#: Side of the squares that a page is cut into where boxes and lines meet.
SQUARE = 144.0


def shown(text: str) -> Column:
    """The number of a text's characters other than white space."""
    return F.length(reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), BLANKS, F.col(text)))


def body_sizes(runs: DataFrame) -> DataFrame:
    """(file, body_size): the size, to a tenth, that most characters other than white space have; of equally frequent ones the first met."""
    seen = F.col("seen")
    n = runs.withColumn("seen", shown("text")).where(seen > 0).groupBy("file", F.round("size", 1).alias("size")).agg(F.sum(seen).alias("n"), F.min(F.struct("page", "line", "ordinal")).alias("first"))
    return n.groupBy("file").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "size")).alias("b")).select("file", F.col("b.size").alias("body_size"))


def lines(runs: DataFrame) -> DataFrame:
    """(file, page, line, text, start, its box, size, bold): lines of runs, where each begins in its page's text, its largest size and the share of bold characters.

    A page's text is its lines with a line end between them. Runs move once, by file, which also serves the pages and what
    is joined by file.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "")
    seen = F.col("seen")
    bold = F.sum(F.when(F.lower("font").contains("bold"), seen).otherwise(0))
    box = [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")]
    dealt = runs.withColumn("seen", shown("text")).repartition("file")
    out = dealt.groupBy("file", "page", "line").agg(text.alias("text"), *box, F.max(F.when(seen > 0, F.col("size"))).alias("size"), F.try_divide(bold, F.sum(seen)).alias("bold"))
    before = Window.partitionBy("file", "page").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def inside(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """The lines that lie wholly in one of the boxes of their page.

    A box is listed for each square of the page that it touches; a line looks only where its upper left corner is, so
    lines and boxes meet by an equality and a line's box is compared with those of its own square.
    """
    at = lambda x: F.floor(F.col(x) / SQUARE)
    over = lambda a, b: F.explode(F.sequence(at(a), F.greatest(at(a), at(b))))
    edges = boxes.select("file", "page", *(F.col(c).alias(f"box_{c}") for c in ("x0", "top", "x1", "bottom")))
    listed = edges.withColumn("across", over("box_x0", "box_x1")).withColumn("down", over("box_top", "box_bottom"))
    held = (F.col("x0") >= F.col("box_x0")) & (F.col("x1") <= F.col("box_x1")) & (F.col("top") >= F.col("box_top")) & (F.col("bottom") <= F.col("box_bottom"))
    placed = found.withColumn("across", at("x0")).withColumn("down", at("top")).alias("l")
    same = [F.col(f"l.{c}") == F.col(f"b.{c}") for c in ("file", "page", "across", "down")]
    on = same[0] & same[1] & same[2] & same[3] & held
    return placed.join(listed.alias("b"), on, "left_semi").drop("across", "down")


def heading_hints(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(file, page, line, start, title, level, its box) of lines that look like headings.

    Of 4 to 150 characters, without a full stop at the end, outside of tables, and 2 points larger than the body or
    bold for 85 % of its characters; of level 1 where it is 4 points larger, else 2.
    """
    found = lines(runs).join(body_sizes(runs), "file")
    title = F.btrim("text", F.lit(BLANKS))
    looks = F.length(title).between(4, 150) & ~title.endswith(".") & ((F.col("size") >= F.col("body_size") + 2) | (F.col("bold") >= 0.85))
    hints = saved(found.where(looks).withColumn("title", title).withColumn("level", F.when(F.col("size") >= F.col("body_size") + 4, 1).otherwise(2)))  # read twice
    out = hints.join(inside(hints, boxes).select("file", "page", "line"), ["file", "page", "line"], "left_anti")
    return out.select("file", "page", "line", "start", "title", "level", "x0", "top", "x1", "bottom")


def page_tables(cells: DataFrame) -> DataFrame:
    """(file, page, table, text, rows) of cells (file, page, table, row, column, text); tables without a word are left out."""
    one = cells.groupBy("file", "page", "table", "row").agg(F.array_sort(F.collect_list(F.struct("column", F.coalesce("text", F.lit("")).alias("text")))).alias("cells"))
    rows = one.groupBy("file", "page", "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: F.transform(r["cells"], lambda c: c["text"])).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n")
    return rows.withColumn("text", text).where(F.col("text").rlike(r"[^\s|]")).select("file", "page", "table", "text", "rows")


# The characters of PDFDocEncoding that Latin-1 has otherwise, by code.
PDF_CODES = [*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0]
PDF_CHARACTERS = "˘ˇˆ˙˝˛˚˜•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž€"
#: UTF-16 in hexadecimal digits, without half a pair.
PAIRED = {
    "FEFF": r"^FEFF(?:(?!D[89A-F])[0-9A-F]{4}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})*+$",
    "FFFE": r"^FFFE(?:[0-9A-F]{2}(?!D[89A-F])[0-9A-F]{2}|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F])*+$",
}


def link_target(raw: Column) -> Column:
    """(target, encoding) of a link's bytes: UTF-16 behind its mark, else UTF-8 if it is valid, else PDFDocEncoding; what can't be read is named by its hash. Null for null."""
    marked = F.hex(F.substring(raw, 1, 2))
    wide = marked.isin(*PAIRED)
    paired = F.when(marked == "FEFF", F.hex(raw).rlike(PAIRED["FEFF"])).otherwise(F.hex(raw).rlike(PAIRED["FFFE"]))
    plain = F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, PDF_CODES)), PDF_CHARACTERS)
    narrow = F.is_valid_utf8(raw.cast("string"))
    target = F.when(wide & paired, F.decode(F.when(wide & paired, raw), "UTF-16")).when(wide, F.concat(F.lit("unresolved-uri:"), F.sha2(raw, 256))).when(narrow, raw.cast("string")).otherwise(plain)
    encoding = F.when(wide & paired, "utf-16").when(wide, "unresolved; original bytes preserved").when(narrow, "utf-8").otherwise("pdfdocencoding")
    return F.when(raw.isNotNull(), F.struct(target.alias("target"), encoding.alias("encoding")))


def links(annotations: DataFrame) -> DataFrame:
    """annotations (raw, uri, rect, page_height) with target, encoding, raw_base64 and bbox, without those that lead nowhere.

    raw is a link's bytes, uri its text where the reader gives that. rect is any two corners, counted from the lower
    left; bbox is counted from the upper left, and null unless rect has four numbers.
    """
    made = annotations.withColumn("made", link_target(F.col("raw")))
    r = [F.col("rect")[i] for i in range(4)]
    h = F.col("page_height")
    bbox = F.when(F.size("rect") == 4, F.array(F.least(r[0], r[2]), h - F.greatest(r[1], r[3]), F.greatest(r[0], r[2]), h - F.least(r[1], r[3])))
    out = made.withColumns({"target": F.coalesce("made.target", "uri"), "encoding": F.col("made.encoding"), "raw_base64": F.base64("raw"), "bbox": bbox})
    return out.where("target is not null").drop("made")
