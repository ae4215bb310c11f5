"""Queries over the benchmark's passages against brute force."""

import random

import pyarrow.parquet as pq
import pytest

from quire.operators import mentions as mn
from quire.plans import asked

DATA = "/root/testdata/sf0.001"


def whole(folder):
    docs, passages = (pq.read_table(f"{folder}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    return sorted((p["item_id"], d["doc_id"]) for p in passages if p["text"] for d in docs if p["text"] in (d["text"] or ""))


def test_excerpts_hold_whole_passages(spark):
    got = asked.excerpts(spark, DATA).collect()
    assert sorted((r.item_id, r.doc_id) for r in got) == whole(DATA)


@pytest.mark.parametrize("most", [20_000, 7])
def test_holding(spark, most):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("ab é\n") for _ in range(n))
    texts = [(i, word(r.randint(0, 400)) if i % 9 else None) for i in range(80)]
    needles = [(k % 25, word(r.choice([0, 1, 3, 6, 9]))) for k in range(40)] + [(50 + k, t[5 : 5 + 30 * (k % 4)]) for k, (_, t) in enumerate(texts) if t] + [(7, None)]
    got = mn.holding(spark.createDataFrame(texts, "key long, text string").repartition(3), spark.createDataFrame(needles, "item long, needle string"), most).collect()
    want = {(k, i) for k, n in needles if n for i, t in texts if t and n in t}
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == want and len(want) > 100


def test_excerpts_of_short_passages(spark, tmp_path):
    docs = [(1, "Ask the buyer first. Then order it at once."), (2, "Ask the buyer first. Then wait for a reply."), (3, "reorder")]
    passages = [(1, "Ask the buyer first. Then wait"), (2, "order"), (3, "buyer first"), (4, "r first. T")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.item_id, r.doc_id) for r in asked.excerpts(spark, str(tmp_path)).collect())
    assert got == [(1, 2), (2, 1), (2, 3), (3, 1), (3, 2), (4, 1), (4, 2)] == whole(str(tmp_path))
