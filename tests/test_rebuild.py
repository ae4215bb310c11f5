"""An index kept by batches against a plain history of each document."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quire.streaming import rebuild as rb

SCHEMA = "doc_id long, text string, modified long, deleted boolean"
CHUNKS = "k int, piece string"


def cut(texts):
    return texts.select("doc_id", "version", F.posexplode(F.split("text", " ")).alias("k", "piece"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def state(spark, root):
    return sorted((r.doc_id, r.version, r.status, r.batch) for r in rb.versions(spark, root).collect())


def pieces(spark, root, archived=False):
    return sorted((r.doc_id, r.version, r.k, r.piece, r.batch) for r in rb.chunks(spark, root, CHUNKS, archived).collect())


def test_batches_by_history(spark, tmp_path):
    r, root = random.Random(3), f"{tmp_path}/index"
    now, seen, made = {}, {}, {}
    for number in range(5):
        rows = [(r.randrange(12), r.choice(["one two", "three", "four five six", "", None]), r.randrange(3), r.random() < 0.2) for _ in range(14)] + [(None, "x", 1, False)]
        rb.absorb(spark.createDataFrame(rows, SCHEMA).repartition(3), number, root, cut)
        last = {}
        for i, text, modified, deleted in rows:
            if i is not None:
                last[i] = max(last.get(i, (-1,)), (modified, text or "", deleted))
        for i, (_, text, deleted) in last.items():
            if deleted:
                now.pop(i, None)
            elif now.get(i) != sha(text):
                now[i] = sha(text)
                seen[i, sha(text)] = number
                made.setdefault((i, sha(text)), (number, text))
        assert state(spark, root) == sorted((i, v, "active" if now.get(i) == v else "archived", b) for (i, v), b in seen.items())
        every = sorted((i, v, k, p, b) for (i, v), (b, text) in made.items() for k, p in enumerate(text.split(" ")))
        assert pieces(spark, root, True) == every and pieces(spark, root) == [x for x in every if now.get(x[0]) == x[1]]


def test_failed_batch_is_not_seen(spark, tmp_path):
    root = f"{tmp_path}/index"
    one = spark.createDataFrame([(1, "a b", 1, None), (2, "c", 1, None)], SCHEMA)
    two = spark.createDataFrame([(1, "a BAD", 2, None), (3, "d", 2, None)], SCHEMA)
    bad = lambda made: made.where("piece = 'BAD'")
    assert rb.published(spark, root) == -1 and state(spark, root) == [] and pieces(spark, root) == []
    rb.absorb(one, 0, root, cut, bad)
    before = state(spark, root), pieces(spark, root)
    with pytest.raises(ValueError, match="not published"):
        rb.absorb(two, 1, root, cut, bad)
    assert (state(spark, root), pieces(spark, root)) == before and rb.published(spark, root) == 0
    rb.absorb(two, 1, root, cut)
    after = state(spark, root), pieces(spark, root)
    rb.absorb(two, 1, root, cut)  # done again, as after a failure behind its publication
    assert (state(spark, root), pieces(spark, root)) == after
    assert after[0] == sorted([(1, sha("a BAD"), "active", 1), (1, sha("a b"), "archived", 0), (2, sha("c"), "active", 0), (3, sha("d"), "active", 1)])


def test_stream(spark, tmp_path):
    landing, root = f"{tmp_path}/in", f"{tmp_path}/index"
    go = lambda: rb.rebuild(spark, landing, root, f"{tmp_path}/cp", cut, files=1).awaitTermination()
    spark.createDataFrame([(1, "a b", 1, None), (2, "c", 1, None)], SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    go()
    spark.createDataFrame([(1, "a b", 2, None), (2, "c d", 2, None)], SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    go()
    go()  # nothing new
    assert state(spark, root) == sorted([(1, sha("a b"), "active", 0), (2, sha("c"), "archived", 0), (2, sha("c d"), "active", 1)])
    assert [x[3:] for x in pieces(spark, root)] == [("a", 0), ("b", 0), ("c", 1), ("d", 1)]
