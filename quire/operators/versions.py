"""Versions of documents, access scopes, integrity of published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("public", "internal", "restricted")


def normalized(name: Column) -> Column:
    """A file name's lookup key: lower-case letters and digits of ASCII."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def first_versions(files: DataFrame) -> DataFrame:
    """One row for each content (doc_id, text): the first document with it, its hash and the others' number and least id.

    Aggregated before the shuffle, so a content that a third of all files share is no hot task.
    """
    sha = F.sha2(F.col("text").cast("binary"), 256)
    own = files.select("doc_id", sha.alias("sha"))
    out = own.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("copies"), F.max("doc_id").alias("last_copy"))
    return out.withColumn("version_id", F.concat(F.lit("document:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("sha")))


def status(versions: DataFrame, manifest: DataFrame) -> DataFrame:
    """versions (doc_id, sha) with status and error: archived where its hash is listed so; an active one must have the reviewed hash."""
    out = versions.join(manifest, "doc_id", "left")
    archived = F.coalesce(F.array_contains("archived", F.col("sha")), F.lit(False))
    wrong = (F.col("review") == "active") & ~F.col("sha").eqNullSafe(F.col("reviewed_sha")) & ~archived
    return out.withColumns({"status": F.when(archived, "archived").otherwise(F.col("review")), "error": F.when(F.col("review").isNull(), "unregistered").when(wrong, "hash differs")})


def retained(old: DataFrame, new: DataFrame) -> DataFrame:
    """All of new, and the versions of old that aren't in it, as archived."""
    gone = old.join(new.select("version_id"), "version_id", "left_anti").withColumn("status", F.lit("archived"))
    return new.unionByName(gone)


def latest(rows: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of tables, of equal keys the row of the last table."""
    out = None
    for i, r in enumerate(rows):
        part = r.withColumn("from", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("from")))).where("k = 1").drop("k", "from")


def permitted(classes: Sequence[str], review: bool, archived: bool) -> Column:
    """Whether a row (classification, status) is within a scope."""
    states = (F.col("status") == "active") | (F.lit(review) & (F.col("status") == "review")) | (F.lit(archived) & (F.col("status") == "archived"))
    return F.col("classification").isin(*classes) & states


def snapshot(documents: DataFrame, sections: DataFrame, nodes: DataFrame, edges: DataFrame, scope: Column) -> dict[str, DataFrame]:
    """The tables as a scope sees them: rows of permitted documents, nodes of their own right, edges between seen nodes."""
    seen = documents.where(scope)
    ids = seen.select("doc_id")
    own = nodes.where(scope)
    kept = own.where("doc_id is null").unionByName(own.where("doc_id is not null").join(ids, "doc_id", "left_semi").select(own.columns))
    node = kept.select("node_id")
    between = edges.join(node.withColumnRenamed("node_id", "source"), "source", "left_semi").join(node.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return {"documents": seen, "sections": sections.join(ids, "doc_id", "left_semi"), "nodes": kept, "edges": between}


#: What each clearance may read; anything else is public only.
CLEARANCES = (("public", "public"), ("internal", "public,internal"), ("staff", "public,internal"), ("restricted", "public,internal,restricted"))


def clearance(users: DataFrame, table: DataFrame) -> DataFrame:
    """users (clearance, approved) with classes, an array, and error where they aren't approved."""
    out = users.join(F.broadcast(table), "clearance", "left")
    return out.withColumns({"classes": F.split(F.coalesce("classes", F.lit("public")), ","), "error": F.when(~F.coalesce("approved", F.lit(False)), "not approved")})


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(problem, key, n) of a manifest (id, name, review, reviewer, sha): bad ids and hashes, incomplete reviews, duplicate ids and names."""
    one = lambda name, where: manifest.where(where).select(F.lit(name).alias("problem"), F.col("id").alias("key"), F.lit(1).cast("long").alias("n"))
    twice = lambda name, key: manifest.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("problem"), "key", "n")
    rows = one("id", ~F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$")).unionByName(one("hash", F.col("sha").isNotNull() & ~F.col("sha").rlike("^[0-9a-f]{64}$")))
    rows = rows.unionByName(one("review", (F.col("review") == "active") & (F.col("reviewer").isNull() | F.col("sha").isNull())))
    return rows.unionByName(twice("duplicate id", F.col("id"))).unionByName(twice("ambiguous name", normalized(F.col("name"))))


def problems(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(problem, doc_id, n) of chunks (doc_id, start, end, text): no document, outside it, or not the exact part of its text; repeated documents.

    A document's text moves once, to the places that its chunks name; the parts there meet the chunks by place. start and
    end must not be null.
    """
    wanted = chunks.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    cut = wanted.join(documents.select("doc_id", F.col("text").alias("whole")), "doc_id", "left").select("doc_id", "whole", F.explode("ranges").alias("r"))
    piece = F.expr("substring(whole, r.start + 1, r.end - r.start)")
    cut = cut.select("doc_id", "r.start", "r.end", F.length("whole").alias("size"), piece.alias("piece"))
    joined = chunks.join(cut, ["doc_id", "start", "end"])
    kind = (
        F.when(F.col("size").isNull(), "no document")
        .when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("size")), "outside")
        .when(F.col("piece") != F.col("text"), "differs")
    )
    found = joined.select(kind.alias("problem"), "doc_id").where("problem is not null").groupBy("problem", "doc_id").agg(F.count("*").alias("n"))
    twice = documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("problem"), "doc_id", "n")
    return found.unionByName(twice)
