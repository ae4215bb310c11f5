"""The quality score against plain loops over passages and words."""

import math
import random

import numpy as np
import pytest

from quire.llm import quality

DATA = "/root/testdata/sf0.001"
KINDS = [b" \t\n\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!?", b"|", b"#$%&*@^~=<>_\\{}[]+/"]


def kind(byte):
    return next((k for k, own in enumerate(KINDS) if byte in own), 9 if byte >= 128 else 8)


def words_of(raw):
    """(start, end) of the runs of bytes that aren't white space."""
    out, start = [], None
    for i, b in enumerate(raw + b" "):
        if kind(b) and start is None:
            start = i
        elif not kind(b) and start is not None:
            out.append((start, i))
            start = None
    return out


def passages(text):
    """The features of each passage, word by word."""
    raw = (text or "").encode()
    words = words_of(raw)
    if not words:
        return [[0.0] * 20]
    out = []
    for k in range(0, len(words), 64):
        own = words[k : k + 64]
        end = words[k + 64][0] if k + 64 < len(words) else len(raw) + 1
        body = (raw + b" ")[own[0][0] : end]
        row = [sum(kind(b) == c for b in body) / len(body) for c in range(10)]
        n, lengths = len(own), [e - s for s, e in own]
        mean = sum(lengths) / n
        share = lambda test, own=own, n=n: sum(test(raw[s:e]) for s, e in own) / n
        letters = lambda w: sum(kind(b) in (1, 2, 9) for b in w)
        alike = {(sum(b * b for b in raw[s:e]) * 64 + min(e - s, 63)) % (1 << 40) for s, e in own}
        row += [
            min(mean, 40) / 10, min(math.sqrt(max(sum(x * x for x in lengths) / n - mean * mean, 0)), 40) / 10, share(lambda w: kind(w[0]) == 2), share(lambda w: kind(w[-1]) == 4), share(lambda w: kind(w[-1]) == 5),
            share(lambda w: kind(w[-1]) == 7), share(lambda w: w == b"|"), share(lambda w: letters(w) >= len(w) - 1), body.count(b"\n") / n, len(alike) / n,
        ]
        out.append(row)
    return out


def score_of(text, w):
    """Codes, gated attention, weighted mean and score of one text, in Python's floats."""
    squash = lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))
    codes, gates = [], []
    for row in passages(text):
        z = [max(-6, min(6, (v - m) / s)) for v, m, s in zip(row, w["mean"], w["scale"], strict=True)]
        h = [math.tanh(sum(a * w["E"][i][j] for i, a in enumerate(z)) + w["e"][j]) for j in range(len(w["e"]))]
        v = [math.tanh(sum(a * w["V"][i][j] for i, a in enumerate(h))) for j in range(len(w["w"]))]
        u = [squash(sum(a * w["U"][i][j] for i, a in enumerate(h))) for j in range(len(w["w"]))]
        codes.append(h)
        gates.append(sum(a * b * c for a, b, c in zip(v, u, w["w"], strict=True)))
    top = max(gates)
    share = [math.exp(g - top) for g in gates]
    mean = [sum(s * h[j] for s, h in zip(share, codes, strict=True)) / sum(share) for j in range(len(w["c"]))]
    return squash(sum(m * c for m, c in zip(mean, w["c"], strict=True)) + w["b"][0])


def texts(n=60):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcXYZ019.,!?|#$é中-") for _ in range(r.randint(1, 9)))
    made = ["", " ", "\n\n", None, "|", "a", "  lead", "tail \n\n", "é" * 70, "x" * 500]
    return made + [r.choice(["", "\n", "  "]) + "".join(word() + r.choice([" ", "\n", "  ", "\t"]) for _ in range(r.choice([3, 63, 64, 65, 200]))) for _ in range(n)]


def test_describe_by_loops():
    own = texts()
    for order in (own, own[::-1], sorted(own, key=str)):
        x, count = quality.together(order)
        want = [passages(t) for t in order]
        assert count.tolist() == [len(p) for p in want]
        assert np.abs(x - np.array([row for p in want for row in p])).max() < 1e-9


def test_neighbours_do_not_matter():
    own = texts(20)
    alone = [quality.together([t])[0] for t in own]
    x, count = quality.together(own)
    for part, one in zip(np.split(x, np.cumsum(count)[:-1]), alone, strict=True):
        assert (part == one).all()


@pytest.fixture(scope="module")
def weights(spark):
    return quality.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))


def test_scores_by_loops(spark, weights):
    own = texts(20) + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in quality.score(rows, weights).collect()}
    plain = {k: v.tolist() for k, v in weights.items()}
    assert max(abs(got[i] - score_of(t, plain)) for i, t in enumerate(own)) < 1e-9


def test_digest_by_loops(spark, weights):
    import zlib

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    plain = {k: v.tolist() for k, v in weights.items()}
    own = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.digest(docs, labels).orderBy("doc_id").limit(60).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert abs(r.score - score_of(own[r.doc_id], plain)) < 1e-9 and r.predicted == int(r.score >= 0.3)
