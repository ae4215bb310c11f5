"""Two-pass external shuffle into shards, with built-in functions only.

Pass one scatters whole rows over buckets by a seeded hash of each row's number; a bucket holds BUCKET bytes of text at
most on average, so that it fits in a task's memory whatever the table's size. Pass two takes each bucket by itself,
orders it by the hashes (so that what arrived first doesn't matter), permutes it by Spark's shuffle(), which is the
Fisher-Yates algorithm with a seed, and writes it. The buckets laid end to end are a random permutation of all rows.

What all buckets have to know of one another is one count for each: shards are equal stretches of the permutation, so a
bucket's rows belong to one or two of them, and shards are written from the buckets without moving rows again.

A row's hash takes its number and not its id, so rows of a frequent id, or of equal texts, are spread like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import saved
from quire.scratch import sized

#: Bytes of text that a bucket holds on average at most.
BUCKET = 64 << 20
SHARDS, SEED = 16, 20240901


def buckets_for(docs: DataFrame, most: int, text: str = "text") -> int:
    """Buckets of `most` bytes for the texts, and no fewer than the session's shuffle partitions, so that all tasks have work."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(-(-total // most), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def permuted(docs: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """(bucket, place, row) with all columns of docs in row: the rows of each bucket in random order, written to the shared folder."""
    key = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    rows = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    dealt = rows.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")).repartitionById(buckets, "bucket")
    by_key: Column = F.array_sort(F.collect_list(F.struct("key", "row")), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    mixed = dealt.groupBy("bucket").agg(by_key.alias("rows")).select("bucket", F.shuffle("rows", seed).alias("rows"))
    return saved(mixed.select("bucket", F.posexplode("rows").alias("place", "held")).select("bucket", "place", "held.row"))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, most: int = BUCKET, text: str = "text") -> DataFrame:
    """docs with shard (from 0) and slot: a random permutation of all rows cut into shards whose row counts are at most one apart, slots gapless from 0.

    Rows count one by one, whatever their ids: repeated rows and null ids are rows like others, and rows of equal texts
    are spread over shards. Null texts have no bytes. Columns of docs named shard or slot are replaced. No rows, no
    shards; with fewer rows than shards some shards are empty. The order follows from seed and from how docs is dealt to
    partitions: give it rows as files or saved tables have them, so that a task that runs again numbers them alike.
    """
    made = permuted(docs, buckets_for(docs, most, text), seed)
    counts = made.groupBy("bucket").agg(F.count("*").alias("n"))
    over = Window.orderBy("bucket")  # one row for each bucket
    base = sized(counts.select("bucket", (F.sum("n").over(over) - F.col("n")).alias("base")))
    total = made.count()
    placed = made.join(base, "bucket").select("row", (F.col("base") + F.col("place")).alias("at"))
    placed = placed.withColumn("part", F.expr(f"at * {shards} div {max(total, 1)}"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*kept, F.col("part").cast("int").alias("shard"), F.expr(f"at - (part * {total} + {shards - 1}) div {shards}").alias("slot"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Writes docs as Parquet, a folder for each shard with its rows in files of one bucket; returns what was written."""
    sharded(docs, shards, seed).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def digest(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row, computed from the sharded texts.

    The law is `rows`: counts at most one apart; so grown_shard is null. Repeated rows and null ids: a row for each.
    """
    text = F.coalesce("text", F.lit(""))
    return sharded(documents.select("doc_id", "text"), shards).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
