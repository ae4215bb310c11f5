"""A bundle made from the documents, with faults that follow from their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import bundle as bd
from quire.plans.tables import table
from quire.scratch import scratch_dir
from quire.streaming import rebuild as rb


def made(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Each document is a section of two blocks, with chunks of 200 characters, a node and an edge to itself; some of each are spoilt."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where("length(text) > 3").select("doc_id", "text", F.length("text").cast("int").alias("n"), F.expr("cast(length(text) div 2 as int)").alias("h"))
    twice = lambda t, where: t.unionByName(t.where(where))
    places = F.when(F.col("odd"), F.array().cast("array<string>")).otherwise(F.array(F.lit("p1")))
    blocks = d.select(F.col("doc_id").alias("version"), "text", "h", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("b"))
    cut = d.select("doc_id", "text", "n", F.explode(F.sequence(F.lit(0), F.expr("cast((n - 1) div 200 as int)"))).alias("k"))
    k = F.col("doc_id") + F.col("k")
    end = F.least(F.col("k") * 200 + 200, F.col("n"))
    chunks = cut.select(
        (i * 1000 + F.col("k")).alias("chunk"), i.alias("section"), F.when(k % 67 == 17, i + 1).otherwise(i).alias("version"), (F.col("k") * 200).alias("start"), F.when(k % 59 == 11, end + 1_000_000).otherwise(end).alias("end"),
        F.when(k % 53 == 9, "").otherwise(F.substring("text", F.col("k") * 200 + 1, F.lit(200))).alias("text"), (k % 61 == 13).alias("odd"),
    )
    edges = d.select(
        i.alias("edge"), i.alias("source"), F.when(i % 79 == 29, -5).otherwise(i).cast("long").alias("target"), F.when(i % 5 == 0, "overrides").otherwise("references").alias("relation"), F.array(F.lit("when asked")).alias("conditions"),
        F.when(i % 10 != 5, "reviewer").alias("reviewer"), F.when(i % 20 == 10, "2024-13-01").otherwise("2024-05-01").alias("day"),
    )
    proof = d.where("doc_id % 83 <> 31").select(
        i.alias("edge"), i.alias("section"), i.alias("version"), F.lit(0).alias("start"), F.least("n", F.lit(20)).alias("end"), F.when(i % 89 == 37, "zz").otherwise(F.substring("text", 1, 20)).alias("quote"),
        F.array(F.lit("p1")).alias("locations"), F.when(i % 3 == 0, F.concat(F.lit("https://example.org/"), i.cast("string"))).alias("link_target"),
    )
    spans = blocks.select(
        F.col("version").alias("section"), (F.col("version") * 10 + F.col("b")).alias("block"), F.when(F.col("b") == 0, 0).otherwise(F.col("h")).alias("start"), F.when(F.col("b") == 0, F.col("h")).otherwise(F.col("n")).alias("end"),
        F.when((F.col("b") == 1) & (F.col("version") % 47 == 6), 1).otherwise(0).alias("source_start"), F.when(F.col("b") == 0, F.col("h")).otherwise(F.col("n") - F.col("h")).alias("source_end"),
    )
    return {
        "documents": twice(d.select(i.alias("version"), F.when(i % 3 == 0, "review").when(i % 3 == 1, "archived").otherwise("active").alias("status")), "version % 101 = 7"),
        "blocks": blocks.select((F.col("version") * 10 + F.col("b")).alias("block"), "version", F.when(F.col("version") % 4 == 0, "table").otherwise("text").alias("kind"), F.when(F.col("b") == 0, F.expr("substring(text, 1, h)")).otherwise(F.expr("substring(text, h + 1, n)")).alias("text")),
        "links": d.where("doc_id % 3 = 0 and doc_id % 97 <> 39").select(i.alias("version"), F.concat(F.lit("https://example.org/"), i.cast("string")).alias("target"), F.lit("p1").alias("location")),
        "sections": d.select(i.alias("section"), F.when(i % 41 == 3, -1).otherwise(i).cast("long").alias("version"), F.when(i % 43 == 5, -9).cast("long").alias("parent"), "text"),
        "spans": spans, "chunks": twice(chunks.withColumn("locations", places).drop("odd"), "section % 71 = 19 and start = 0"), "nodes": twice(d.select(i.alias("node")), "node % 73 = 23"), "edges": edges, "evidence": proof,
    }


def bundle_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What doesn't fit together, by kind."""
    return bd.problems(made(spark, sf_dir)).groupBy("problem").agg(F.count("*").alias("n"), F.min(F.col("key").cast("long")).alias("first"))


def bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = made(spark, sf_dir)
    return bd.summary(own, bd.repeated(own))


def unowned_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 90 characters from every 150th on, against chunks of 200."""
    own = made(spark, sf_dir)
    starts = own["sections"].select("section", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.expr("cast((length(text) - 1) div 150 as int)"))).alias("k"))
    rows = starts.select("section", (F.col("k") * 150).alias("start"), F.least(F.col("k") * 150 + 90, "n").alias("end"))
    return bd.unowned(rows, own["chunks"].where("end < 1000000 or end is null").select("section", "start", "end"))


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions after three batches of a stream: half of the documents, then the others and changes to some, then changes back, deletions and repetitions; how many chunks each has, and which batch made them."""
    folder = scratch_dir(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    rows = lambda where, n, text="text", gone=False: d.where(where).select("doc_id", F.expr(text).alias("text"), F.lit(n).cast("long").alias("modified"), F.lit(gone).alias("deleted"))
    batches = (
        rows("doc_id % 2 = 0", 1), rows("doc_id % 2 = 1", 2).unionByName(rows("doc_id % 4 = 0", 2, "concat(text, ' changed')")).unionByName(rows("doc_id % 6 = 2", 2)),
        rows("doc_id % 8 = 0", 3).unionByName(rows("doc_id % 5 = 0", 4, gone=True)).unionByName(rows("doc_id % 7 = 0 and doc_id % 4 <> 0", 3)),
    )
    cut = lambda texts: texts.select("doc_id", "version", F.explode(F.sequence(F.lit(0), F.expr("cast(greatest(length(text) - 1, 0) div 500 as int)"))).alias("k"))
    for batch in batches:
        batch.write.mode("append").parquet(f"{folder}/landing")
        rb.rebuild(spark, f"{folder}/landing", f"{folder}/index", f"{folder}/checkpoint", cut).awaitTermination()
    made = rb.chunks(spark, f"{folder}/index", "k int", archived=True).groupBy("doc_id", "version").agg(F.count("*").alias("chunks"), F.max("batch").alias("made"))
    return rb.versions(spark, f"{folder}/index").join(made, ["doc_id", "version"]).select(i, "version", "status", "batch", "chunks", "made")


def sql() -> dict[str, str]:
    base = """d AS (SELECT doc_id AS i, text, length(text) AS n, length(text) // 2 AS h FROM documents WHERE length(text) > 3),
      c0 AS (SELECT i, n, unnest(range((n - 1) // 200 + 1)) AS k FROM d), c AS (SELECT *, i * 1000 + k AS chunk FROM c0 UNION ALL SELECT *, i * 1000 + k FROM c0 WHERE i % 71 = 19 AND k = 0)"""
    owner = "CASE WHEN i % 41 = 3 THEN -1 ELSE i END"
    return {
        "bundle_problems": f"""WITH {base}, p AS (
          SELECT 'repeated version' AS problem, i AS key FROM d WHERE i % 101 = 7 UNION ALL SELECT 'repeated chunk', i * 1000 FROM d WHERE i % 71 = 19 UNION ALL SELECT 'repeated node', i FROM d WHERE i % 73 = 23
          UNION ALL SELECT 'section without document', i FROM d WHERE i % 41 = 3 UNION ALL SELECT 'section without parent', i FROM d WHERE i % 43 = 5 UNION ALL SELECT 'edge without target', i FROM d WHERE i % 79 = 29
          UNION ALL SELECT 'span is not its block''s text', i FROM d WHERE i % 47 = 6
          UNION ALL SELECT 'chunk is not its section''s text', chunk FROM c WHERE (i + k) % 53 = 9 OR (i + k) % 59 = 11 OR (i + k) % 61 = 13 OR CASE WHEN (i + k) % 67 = 17 THEN i + 1 ELSE i END <> {owner}
          UNION ALL SELECT 'evidence is not its section''s text', i FROM d WHERE i % 83 <> 31 AND (i % 89 = 37 OR i % 41 = 3)
          UNION ALL SELECT 'edge: ' || CASE WHEN i % 83 = 31 THEN 'no evidence' WHEN i % 10 = 5 THEN 'not reviewed' ELSE 'not a date' END, i FROM d WHERE i % 83 = 31 OR i % 10 = 5 OR i % 20 = 10
          UNION ALL SELECT 'link is not in its document', i FROM d WHERE i % 3 = 0 AND i % 97 = 39 AND i % 83 <> 31) SELECT problem, count(*) AS n, min(key) AS first FROM p GROUP BY 1""",
        "bundle_summary": f"""WITH {base} SELECT (SELECT count(*) FROM d) + (SELECT count(*) FROM d WHERE i % 101 = 7) AS documents, (SELECT count(*) FROM d WHERE i % 3 = 2) + (SELECT count(*) FROM d WHERE i % 101 = 7 AND i % 3 = 2) AS active_documents,
          (SELECT count(*) FROM d WHERE i % 3 = 1) + (SELECT count(*) FROM d WHERE i % 101 = 7 AND i % 3 = 1) AS archived_documents, (SELECT count(*) FROM d WHERE i % 3 = 0) + (SELECT count(*) FROM d WHERE i % 101 = 7 AND i % 3 = 0) AS documents_needing_review,
          (SELECT count(*) FROM d) AS graph_edges, (SELECT count(*) FROM d WHERE i % 5 = 0) AS overrides, (SELECT 2 * count(*) FROM d WHERE i % 4 = 0) AS tables, (SELECT count(*) FROM d) AS sections, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM d) + (SELECT count(*) FROM d WHERE i % 73 = 23) AS graph_nodes,
          (SELECT count(*) FROM d WHERE i % 101 = 7) + (SELECT count(*) FROM d WHERE i % 71 = 19) + (SELECT count(*) FROM d WHERE i % 73 = 23) AS warnings""",
        "rebuilt": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(text || ' changed', '') AS other FROM documents),
          v AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 OR (doc_id % 4 = 0 AND doc_id % 8 <> 0) THEN 'archived' ELSE 'active' END AS status, CASE WHEN doc_id % 8 = 0 AND doc_id % 5 <> 0 THEN 2 WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS batch, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS made FROM d
            UNION ALL SELECT doc_id, other, CASE WHEN doc_id % 8 = 0 OR doc_id % 5 = 0 THEN 'archived' ELSE 'active' END, 1, 1 FROM d WHERE doc_id % 4 = 0)
          SELECT doc_id, sha256(text) AS version, status, CAST(batch AS BIGINT) AS batch, CAST(greatest(length(text) - 1, 0) // 500 + 1 AS BIGINT) AS chunks, CAST(made AS BIGINT) AS made FROM v""",
        "unowned_evidence": f"""WITH {base}, e AS (SELECT i AS section, n, unnest(range((n - 1) // 150 + 1)) AS k FROM d), f AS (SELECT section, CAST(k * 150 AS INT) AS start, CAST(least(k * 150 + 90, n) AS INT) AS "end" FROM e),
          r AS (SELECT i, k * 200 AS a, least(k * 200 + 200, n) AS b FROM c0 WHERE (i + k) % 59 <> 11) SELECT section, start, "end" FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.i = section AND a <= start AND b >= "end")""",
    }


QUERIES = {f.__name__: f for f in (rebuilt, bundle_problems, bundle_summary, unowned_evidence)}
