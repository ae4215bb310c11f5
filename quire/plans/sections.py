"""Queries over sections: lines of documents, parts as a tree of sections, and what follows from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import sections as se
from quire.operators import structure as st
from quire.plans.purchases import pick
from quire.plans.tables import table

OPENINGS = ("IV. Scope of work\n", "PURCHASING RULES\n", "12. Limits\n", "\n\n  b. lower case\n", "")
DAYS = ("2024-05-01", "2024-13-01", "", "2024-05-01T10:00:00Z", "May 2024", None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def chunk_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading of each document, which begins with one of five openings; the source where it has none."""
    d = documents(spark, sf_dir).withColumn("text", F.concat(pick("doc_id", OPENINGS), "text"))
    return d.select("doc_id", se.chunk_heading(F.col("text"), F.col("text"), F.col("source")).alias("heading"))


def substantive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its lines, as sections of three kinds, and those that say something; every seventh is in capitals."""
    rows = st.lines(documents(spark, sf_dir)).withColumn("line", F.when(F.col("line_no") % 7 == 3, "NO LETTERS HERE\nABC").otherwise(F.col("line")))
    good = se.substantive(pick("line_no", ("body", "table", "title")), F.lit("ABC"), F.col("line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(good).alias("substantive"))


def promoted_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sections below the one with a third of their key: some only a title, some very long, some a revision history."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "ABC").when(k % 11 == 1, F.repeat(F.lit("A limit. "), F.lit(1400))).otherwise(F.concat(F.lit("Purchases of this type are limited. "), "p_name"))
    tree = table(spark, sf_dir, "part").select(k.alias("section"), F.nullif(F.expr("p_partkey div 3"), F.lit(0)).alias("parent"), F.when(k % 40 == 7, "Revision history").otherwise("ABC").alias("title"), text.alias("text"), F.lit("body").alias("kind"))
    return se.promoted(tree)


def span_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, of six lines each, that stretches of 500 characters of each document lie on."""
    d = documents(spark, sf_dir)
    size = F.length("line") + 1
    end = F.sum(size).over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    blocks = st.lines(d).withColumn("end", end).select("doc_id", (F.col("end") - size + 1).alias("start"), "end", F.expr("line_no div 6").alias("page"))
    spans = d.select("doc_id", F.length("text").cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr("length(text) div 500"))).alias("span"))
    return se.locations(spans.select("doc_id", "span", (F.col("span") * 500).alias("start"), F.least(F.col("span") * 500 + 500, "n").alias("end")), blocks)


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines have markings that follow from their number."""
    d = documents(spark, sf_dir)
    k = F.col("doc_id") + F.col("line_no")
    text = F.when(k % 11 == 0, F.concat(F.lit("INTERNAL  uc Use only "), "line")).when((F.col("line_no") == 0) & (F.col("doc_id") % 4 == 1), F.concat(F.lit(" draft "), "line")).otherwise(F.col("line"))
    blocks = st.lines(d).select("doc_id", F.when(F.col("line_no") == 0, "header").otherwise("text").alias("kind"), text.alias("text"))
    kinds = d.select("doc_id", pick("doc_id", ("public", "internal", "restricted")).alias("classification"))
    return se.marked(kinds, blocks).select("doc_id", "classification", "promoted", "draft")


def relation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    quotes = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("x"), F.lit(" "))).otherwise(F.array(F.lit("a quote")))
    wrong = se.relation_problem(pick("o_orderkey", ("overrides", "references", "overrides")), quotes, F.when(k % 5 != 0, F.array(F.lit("c"))), pick("o_orderkey", ("r", "r", "r", "r", "r", "r", " ")), pick("o_orderkey", DAYS))
    return o.select("o_orderkey", wrong.alias("problem"))


def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sections in a binary tree below their document."""
    rows = st.lines(documents(spark, sf_dir))
    number = lambda k: F.col("doc_id") * 1_000_000 + k
    return se.contains(rows.select("doc_id", number(F.col("line_no")).alias("section"), F.when(F.col("line_no") > 0, number(F.expr("(line_no - 1) div 2"))).alias("parent"), F.col("line").alias("text")))


def named_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts whose brand or type customers' questions name."""
    p = table(spark, sf_dir, "part")
    aliases = p.select(F.col("p_brand").alias("alias"), F.col("p_partkey").alias("target")).unionByName(p.select(F.col("p_type").alias("alias"), F.col("p_partkey").alias("target")))
    asked = table(spark, sf_dir, "customer").join(p, F.col("c_custkey") == F.col("p_partkey")).select(F.col("c_custkey").alias("q_id"), F.concat(F.lit("Does "), F.lower("p_brand"), F.lit(" cover "), "p_type", F.lit("?")).alias("question"))
    return se.named_sources(asked, aliases.groupBy("alias").agg(F.min("target").alias("target"))).select("q_id", F.concat_ws(",", F.transform("targets", lambda x: x.cast("string"))).alias("targets"))


def key_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' answers by nation, with an answer key for four of five nations."""
    results = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("question"), pick("c_custkey", ("x", "y")).alias("truth"))
    key = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").cast("string").alias("question"), F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise(F.col("n_name")).alias("answer"))
    return se.swapped(results, key)


def listed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    found = p.select(F.col("p_brand").alias("q_id"), F.col("p_partkey").alias("section"), pick("p_partkey", ("body", "table", "footer")).alias("kind"), (F.col("p_size") * 5).alias("chars"), F.col("p_retailprice").alias("score"))
    return se.listed(found, 10).select("q_id", "section", "rank")


def case(key: str, values: tuple) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


def sql() -> dict[str, str]:
    strip = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    stop = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
    lines = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents)"
    says = lambda t: rf"(len(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: w NOT IN ({stop}))) >= 6 OR (length({t}) >= 25 AND contains({t}, '.')))"
    return {
        "chunk_headings": f"""WITH p AS (SELECT doc_id, source, {strip(case('doc_id', OPENINGS) + " || coalesce(text, '')")} AS t FROM documents),
            h AS (SELECT *, list_filter(list_transform(string_split(t, chr(10))[1:3], lambda x: {strip('x')}), lambda x: regexp_matches(x, '{se.NUMBERED}') OR (regexp_matches(x, '{se.CAPITALS}') AND length(x) < 80)) AS own FROM p)
            SELECT doc_id, coalesce(substr(own[1], 1, 80), nullif({strip(f"regexp_extract(t, '{se.FIRST_LINE}', 1)")}, ''), source, '') AS heading FROM h""",
        "substantive_lines": f"""WITH {lines}, s AS (SELECT doc_id, line_no, {strip("CASE WHEN line_no % 7 = 3 THEN 'NO LETTERS HERE' ELSE line END")} AS t FROM l)
            SELECT doc_id, count(*) AS lines, count(*) FILTER (line_no % 3 < 2 AND t <> 'ABC' AND line_no % 7 <> 3 AND {says('t')} AND NOT (upper(t) = t AND lower(t) <> t)) AS substantive FROM s GROUP BY 1""",
        "promoted_sections": """WITH RECURSIVE s AS (SELECT p_partkey AS section, nullif(p_partkey // 3, 0) AS parent, p_partkey % 3 <> 0 AS good, p_partkey % 40 = 7 AS old, p_partkey % 11 = 1 AS far FROM part),
            w AS (SELECT section, section AS at, 0 AS d FROM s UNION ALL SELECT w.section, s.parent, d + 1 FROM w JOIN s ON s.section = w.at WHERE s.parent IS NOT NULL),
            g AS (SELECT w.section, bool_or(old) AS dead, min(d) FILTER (good) AS first FROM w JOIN s ON s.section = w.at GROUP BY 1)
            SELECT g.section, CASE WHEN NOT dead AND (first = 0 OR NOT far) THEN w.at END AS answer FROM g LEFT JOIN w ON w.section = g.section AND w.d = g.first LEFT JOIN s ON s.section = w.at""",
        "span_locations": f"""WITH {lines}, b AS (SELECT doc_id, line_no // 6 AS page, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 - length(line) AS a, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS z FROM l),
            s AS (SELECT doc_id, length(coalesce(text, '')) AS n, unnest(range(length(coalesce(text, '')) // 500 + 1)) AS span FROM documents)
            SELECT s.doc_id, span, CASE WHEN min(page) = max(page) THEN min(page)::VARCHAR ELSE min(page) || '-' || max(page) END AS pages, count(*) AS n
            FROM s JOIN b ON b.doc_id = s.doc_id AND a < least(span * 500 + 500, s.n) AND span * 500 < z GROUP BY 1, 2""",
        "marked_documents": f"""WITH {lines}, m AS (SELECT doc_id, bool_or((doc_id + line_no) % 11 = 0 OR regexp_matches(line, '{se.INTERNAL}')) AS i, bool_or(line_no = 0 AND ((doc_id % 4 = 1 AND doc_id % 11 <> 0) OR (doc_id % 11 <> 0 AND regexp_matches(line, '{se.DRAFT}')))) AS draft FROM l GROUP BY 1)
            SELECT doc_id, CASE WHEN i AND doc_id % 3 = 0 THEN 'internal' ELSE {case('doc_id', ('public', 'internal', 'restricted'))} END AS classification, i AND doc_id % 3 = 0 AS promoted, draft FROM m""",
        "relation_checks": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'no evidence' WHEN o_orderkey % 3 = 1 THEN NULL WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 6 OR o_orderkey % 6 IN (2, 5) THEN 'not reviewed' WHEN o_orderkey % 6 IN (1, 4) THEN 'not a date' END AS problem FROM orders""",
        "contains_edges": f"""WITH {lines} SELECT CASE WHEN line_no > 0 THEN 'section:' || (doc_id * 1000000 + (line_no - 1) // 2) ELSE 'document:' || doc_id END AS source, 'section:' || (doc_id * 1000000 + line_no) AS target, {strip('substr(line, 1, 160)')} AS quote FROM l""",
        "key_swap": """WITH k AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE n_name END AS answer FROM nation WHERE n_nationkey % 5 <> 0), r AS (SELECT c_custkey AS id, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'y' END AS truth FROM customer)
            SELECT id, c_nationkey::VARCHAR AS question, coalesce(answer, truth) AS truth, coalesce(answer, truth) <> truth AS changed, answer IS NOT NULL AS matched FROM r LEFT JOIN k ON n_nationkey = c_nationkey""",
        "listed_sections": """SELECT q_id, section, rank FROM (SELECT p_brand AS q_id, p_partkey AS section, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 3 = 2, p_size * 5 < 120, p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 10""",
    }


NAMES = "chunk_headings substantive_lines promoted_sections span_locations marked_documents relation_checks contains_edges named_sources key_swap listed_sections".split()
QUERIES = {name: globals()[name] for name in NAMES}
