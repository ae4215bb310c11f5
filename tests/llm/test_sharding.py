"""Shards: every row once, the law, gapless slots, and a shuffle that has no order left."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import sharding

ODD = [None, "", " ", "é" * 50, "a" * 5000, "x y", "x y", "🙂"]


@pytest.mark.parametrize(("copies", "most"), [(1, sharding.BUCKET), (40, 1000), (40, sharding.BUCKET)])
def test_rows(spark, copies, most):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD * copies)] + [(7, "hot")] * (4 * copies)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumn("shard", F.lit("in")).withColumn("bucket", F.lit(3)).withColumn("map", F.create_map(F.lit("a"), F.lit(1)))
    out = sharding.sharded(docs, 16, most=most)
    assert out.columns == ["doc_id", "text", "bucket", "map", "shard", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.bucket) for r in got) == Counter((i, t, 3) for i, t in rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) <= set(range(16)) and max(sizes.values()) - min([sizes[s] for s in range(16)]) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_digest(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = sharding.digest(docs).collect()
    for r in got:
        text = (ODD[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)
    assert len(got) == len(ODD) and sharding.digest(docs.where("false")).count() == 0


def test_native(spark):
    plan = sharding.digest(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_order_is_random_and_repeatable(spark):
    docs = spark.range(0, 4000, 1, 5).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    order = lambda **k: [r.doc_id for r in sharding.sharded(docs, 4, most=3000, **k).orderBy("shard", "slot").collect()]
    one = order()
    assert one == order() and one != order(seed=9)
    rises = sum(a < b for a, b in zip(one, one[1:], strict=False)) / len(one)
    near = sum(abs(a - b) < 40 for a, b in zip(one, one[1:], strict=False)) / len(one)
    assert 0.45 < rises < 0.55 and near < 0.05
    quarter = Counter((i * 4 // 4000, v * 4 // 4000) for i, v in enumerate(one))
    assert all(150 < n < 350 for n in quarter.values()) and len(quarter) == 16


def test_write(spark, tmp_path):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    back = sharding.write(docs, f"{tmp_path}/out", 8)
    assert sorted(r.doc_id for r in back.collect()) == list(range(1000))
    assert {r["count"] for r in back.groupBy("shard").count().collect()} == {125}
