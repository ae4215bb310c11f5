"""Vector codes against plain loops over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import codes


def by_loops(rows, entries=256, rounds=4):
    """rows: (vec_id, vector, label), ids distinct. All distances, in Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    kept = [(i, [max(-(1 << 28), min(1 << 28, x)) for x in v] + [0] * (width - len(v)), g) for i, v, g in kept]
    w = width // 4
    cut = [[v[p * w : (p + 1) * w] for p in range(4)] for _, v, _ in kept]
    first = [c for _, c in sorted(((i, c) for (i, _, _), c in zip(kept, cut, strict=True) if i is not None), key=lambda x: x[0])[:entries]]
    books = [[list(c[p]) for c in first] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds if first else 0):
        for p in range(4):
            of = [nearest(c[p], books[p])[1] for c in cut]
            for k in set(of):
                own = [c[p] for c, o in zip(cut, of, strict=True) if o == k]
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    if not first:
        return []
    found = [[nearest(c[p], books[p]) for p in range(4)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = {}
    for (_, _, g), e in zip(kept, errors, strict=True):
        sums[g] = sums.get(g, 0) + e
    return [(i, "".join(f"{k:02x}" for _, k in f), e, sums[g], digest) for (i, _, g), f, e in zip(kept, found, errors, strict=True)]


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


def result(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=key)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, v string").repartition(3)


@pytest.mark.parametrize("entries", [256, 5])
def test_codes(spark, entries):
    r = random.Random(1)
    single = lambda x: float(np.float32(x))
    rows = [(i * 3 - 20, [single(r.gauss(0, 0.3)) for _ in range(12)], r.choice([0, 1, 2, None])) for i in range(300)]
    rows += [(2000 + i, rows[i][1], 1) for i in range(40)]  # equal vectors
    rows += [(3000 + i, [single(r.choice([-0.5, 0, 0.5])) for _ in range(12)], 7) for i in range(60)]  # ties
    rows += [(-1000, [float("nan")] * 12, 1), (-999, None, 1), (-998, [None] * 12, 1), (-997, [float("inf")] + [0.0] * 11, 1), (5000, [0.5, -0.25], 2), (5001, [], 2), (None, [0.25] * 12, None), (5002, [1e30, -1e30] * 6, 1)]
    assert result(codes.encoded(frame(spark, rows), entries)) == sorted(by_loops(rows, entries), key=key)


def test_width_and_few_rows(spark):
    rows = [(1, [0.1, 0.2, 0.3, 0.4, 0.5], None), (2, [0.9] * 7, None)]
    assert result(codes.digest(frame(spark, rows))) == sorted(by_loops(rows), key=key)
    for none in ([], [(None, [1.0] * 4, 1)], [(1, None, 1)]):
        assert codes.digest(frame(spark, [*none, (1, None, None)])).count() == 0
    assert [len(r.code) for r in codes.digest(frame(spark, [(1, [], 3)])).collect()] == [8]  # no components: one entry of width 0


def test_repeated_rows(spark):
    rows = [(1, [0.5] * 4, 0), (1, [0.5] * 4, 0), (2, [0.1] * 4, 0)]
    got = result(codes.digest(frame(spark, rows)))
    assert [g[0] for g in got] == [1, 1, 2] and got[0] == got[1] and got[0][1] != got[2][1]


def test_every_nearest_entry_is_a_candidate():
    rng = np.random.default_rng(3)
    for most in (40, 1 << 26):
        x, e = rng.integers(-most, most, (400, 16)), rng.integers(-most, most, (200, 16))
        e[::7] = e[0]
        f = codes.Filter(e)
        i, j = f.candidates(x)
        assert len(i) < 0.5 * len(x) * len(e) if most > 40 else True
        index, least = f.nearest(x)
        d = ((x[:, None] - e[None]) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (least == d.min(1)).all()


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_ROWS", 10)
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 40, "00", i) for i in range(600)], "vec_id long, label int, code string, error long")
    want = {}
    for i in range(600):
        g = None if i % 3 == 0 else i % 40
        want[g] = want.get(g, 0) + i
    got = codes.label_sums(rows).collect()
    assert len(got) == 600 and all(r.label_error == want[r.label] for r in got)
    assert set(codes.label_sums(rows).columns) == {"vec_id", "label", "code", "error", "label_error"}
    assert codes.label_sums(rows.where(F.lit(False))).count() == 0
