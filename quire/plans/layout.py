"""Queries over pages laid out from the documents' texts, and over the links of web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.tables import table
from quire.sources import layout

#: Lines of a page; points that a line and a character take.
LINES, HEIGHT, WIDTH = 40, 12.0, 6.0
SENTENCES = r"[.\n] ?"


#: Words of a bold line's runs: so many bold ones, then a plain one.
BOLD = 8


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of all documents, set on pages of 40 lines, a sentence to a line; some lines are larger, some bold but for every ninth word.

    A plain line is one run; a bold one has runs of eight words and of one, whose places are summed up along the line.
    """
    n, file = F.col("n"), F.col("file")
    docs = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", SENTENCES)).alias("n", "t"))
    bold = (n + file) % 11 == 7
    piece = lambda k, text, font: F.struct(k.cast("int").alias("ordinal"), text.alias("text"), F.lit(font).alias("font"))
    pair = lambda k: F.array(piece(k, F.array_join(F.slice("words", k + 1, F.lit(BOLD)), " "), "Serif-Bold"), piece(k + BOLD, F.get("words", k + BOLD), "Serif"))
    cut = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(BOLD + 1)), pair)), lambda x: x["text"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda s, x: F.struct((s["at"] + F.length(x["text"]) + 1).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))
    lined = docs.select("file", n.cast("long").alias("n"), "t", F.when(bold, F.split("t", " ")).alias("words"))
    lined = lined.withColumn("pieces", F.when(bold, cut).otherwise(F.array(piece(F.lit(0), F.col("t"), "Serif"))))
    lined = lined.withColumn("starts", F.when(bold, F.aggregate("pieces", start, step)["starts"]).otherwise(F.array(F.lit(0))))
    each = lined.select("file", "n", F.explode(F.arrays_zip("pieces", "starts")).alias("x")).select("file", "n", "x.pieces.*", F.col("x.starts").alias("before"))
    size = F.when((n + file) % 17 == 3, 14.0).when((n + file) % 13 == 5, 12.0).otherwise(10.0)
    x0, top = F.col("before") * WIDTH, n % LINES * HEIGHT
    text = F.when(F.col("ordinal") > 0, F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    return each.select("file", F.floor(n / LINES).alias("page"), "n", (n % LINES).alias("line"), "ordinal", text.alias("text"), x0.alias("x0"), top.alias("top"), (x0 + F.length("text") * WIDTH).alias("x1"), (top + 10.0).alias("bottom"), size.alias("size"), "font")


def boxes(found: DataFrame) -> DataFrame:
    """A table on each page, as wide as its number allows, from line 8 to 20."""
    pages = found.select("file", "page").distinct()
    return pages.select("file", "page", F.lit(0.0).alias("x0"), F.lit(8 * HEIGHT).alias("top"), (F.pmod(F.col("file") * 37, F.lit(900)) + 200.0).alias("x1"), F.lit(21 * HEIGHT).alias("bottom"))


def layout_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that look like headings."""
    found = runs(spark, sf_dir)
    return layout.heading_hints(found, boxes(found)).select("file", "page", "line", "start", "title", "level", "x1")


def body_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_sizes(runs(spark, sf_dir))


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of web pages, as bytes in four encodings, a broken one among them, read back; boxes turned over."""
    hrefs = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("n", "href"))
    kind = (F.col("page_id") + F.col("n")) % 4
    raw = F.when(kind == 0, F.encode("href", "UTF-8")).when(kind == 1, F.encode("href", "UTF-16")).when(kind == 2, F.concat(F.encode(F.regexp_replace("href", "[^ -~]", ""), "UTF-8"), F.unhex(F.lit("80")))).otherwise(F.concat(F.unhex(F.lit("FEFFD8")), F.encode("href", "UTF-8")))
    y = (F.col("n") * 20 + 30).cast("double")
    rows = hrefs.select("page_id", "n", kind.alias("kind"), raw.alias("raw"), F.lit(None).cast("string").alias("uri"), F.array(F.lit(90.0), y + 12, F.lit(40.0), y).alias("rect"), F.lit(792.0).alias("page_height"))
    out = layout.links(rows)
    return out.select("page_id", F.col("n").cast("long").alias("n"), "target", "encoding", F.when(F.col("kind") != 1, F.col("raw_base64")).alias("raw_base64"), *(F.col("bbox")[i].alias(f"b{i}") for i in range(4)))


def sql() -> dict[str, str]:
    base = f"""l AS (SELECT doc_id AS file, unnest(string_split_regex(text, '{SENTENCES}')) AS t, generate_subscripts(string_split_regex(text, '{SENTENCES}'), 1) - 1 AS n FROM documents WHERE text <> ''),
      w AS (SELECT *, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) - 1 AS k FROM l),
      r AS (SELECT file, n // {LINES} AS page, n % {LINES} AS line, k, word, length(regexp_replace(word, '\\s+', '', 'g')) AS shown, CASE WHEN (n + file) % 17 = 3 THEN 14.0 WHEN (n + file) % 13 = 5 THEN 12.0 ELSE 10.0 END::DOUBLE AS size, (n + file) % 11 = 7 AND k % 9 < 8 AS bold FROM w),
      z AS (SELECT file, size, sum(shown) AS c, min(page * 100000000000 + line * 1000000000 + k) AS place FROM r WHERE shown > 0 GROUP BY 1, 2), b AS (SELECT file, arg_max(size, (c, -place)) AS body_size FROM z GROUP BY 1)"""
    return {
        "body_fonts": f"WITH {base} SELECT file, body_size FROM b",
        "layout_headings": f"""WITH {base}, s AS (SELECT file, page, line, sum(shown) AS shown, sum(CASE WHEN bold THEN shown ELSE 0 END) AS b, max(CASE WHEN shown > 0 THEN size END) AS size FROM r GROUP BY 1, 2, 3),
          p AS (SELECT file, n // {LINES} AS page, n % {LINES} AS line, t, CAST(length(t) * {WIDTH} AS DOUBLE) AS x1, coalesce(sum(length(t) + 1) OVER (PARTITION BY file, n // {LINES} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS title FROM l)
          SELECT file, page, line, CAST(start AS BIGINT) AS start, title, CASE WHEN size >= body_size + 4 THEN 1 ELSE 2 END AS level, x1 FROM p JOIN s USING (file, page, line) JOIN b USING (file)
          WHERE length(title) BETWEEN 4 AND 150 AND NOT ends_with(title, '.') AND (size >= body_size + 2 OR b / nullif(shown, 0) >= 0.85) AND NOT (line BETWEEN 8 AND 20 AND x1 <= file * 37 % 900 + 200)""",
        "link_targets": """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS n FROM pages), k AS (SELECT *, (page_id + n) % 4 AS kind FROM h),
          r AS (SELECT *, CASE kind WHEN 0 THEN encode(href) WHEN 2 THEN encode(regexp_replace(href, '[^ -~]', '', 'g')) || from_hex('80') WHEN 3 THEN from_hex('FEFFD8') || encode(href) END AS raw FROM k)
          SELECT page_id, n, CASE kind WHEN 2 THEN regexp_replace(href, '[^ -~]', '', 'g') || '•' WHEN 3 THEN 'unresolved-uri:' || sha256(raw) ELSE href END AS target, CASE kind WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16' WHEN 2 THEN 'pdfdocencoding' ELSE 'unresolved; original bytes preserved' END AS encoding,
          base64(raw) AS raw_base64, 40.0::DOUBLE AS b0, 792.0::DOUBLE - (n * 20 + 42) AS b1, 90.0::DOUBLE AS b2, 792.0::DOUBLE - (n * 20 + 30) AS b3 FROM r""",
    }


QUERIES = {f.__name__: f for f in (layout_headings, body_fonts, link_targets)}
