"""A quality score by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is described by shares of character and word classes and
encoded by a learned layer; gated attention (tanh times sigmoid) weighs the passages, and the weighted mean of their
codes is scored. Weights are learned from document labels alone, by Adam over whole bags, on a bounded sample of
labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import add_columns

PASSAGE = 64
#: Labelled documents that training uses at most, and the characters of the longest of them. All others are scored.
SAMPLE, LONGEST = 5000, 10_000
CODES, ATTENTION, STEPS, RATE, DECAY, SEED = 10, 6, 150, 0.03, 1e-4, 7
#: Documents are described together, as many as have this many bytes.
TOGETHER = 1 << 20

#: Classes of bytes: white space, lower and upper case, digit, full stop and comma, ! and ?, bar, symbols, other ASCII, within other scripts.
CLASS = np.full(256, 8, np.uint8)
for members, number in ((b" \t\n\r\x0b\x0c", 0), (b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b".,", 4), (b"!?", 5), (b"|", 6), (b"#$%&*@^~=<>_\\{}[]+/", 7), (bytes(range(128, 256)), 9)):
    CLASS[list(members)] = number
CLASSES = 10
FEATURES = CLASSES + 10


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of the texts, one after another, and how many passages each text has (one at least)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    kind = CLASS[data]
    inside = kind > 0
    first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    last = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False])))
    doc = np.searchsorted(begin, first, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    count = np.maximum(1, -(-words // PASSAGE))
    base = np.cumsum(count) - count
    bag = base[doc] + (np.arange(len(first)) - (np.cumsum(words) - words)[doc]) // PASSAGE
    total = int(count.sum())
    x = np.zeros((total, FEATURES))
    if not len(first):
        return x, count
    until = np.minimum(np.append(first[1:], len(data)), (begin + size + 1)[doc])  # a word's bytes go to the next one, or to one space behind its own text
    own = until - first
    place = np.repeat(first - np.cumsum(own) + own, own) + np.arange(own.sum())
    owner, body = np.repeat(bag, own), data[place]
    n_bytes = np.bincount(owner, minlength=total)
    x[:, :CLASSES] = np.bincount(owner * CLASSES + kind[place], minlength=total * CLASSES).reshape(total, CLASSES)
    x[:, :CLASSES] /= np.maximum(n_bytes, 1)[:, None]
    n = np.bincount(bag, minlength=total)
    share = lambda of: np.bincount(bag, of, total) / np.maximum(n, 1)
    length = last - first + 1
    head, tail = kind[first], kind[last]
    letters = np.concatenate(([0], np.cumsum((kind == 1) | (kind == 2) | (kind == 9))))
    lines = np.bincount(owner, body == 10, total)
    sums = np.concatenate(([0], np.cumsum(data.astype(np.int64) ** 2)))
    code = (bag.astype(np.int64) << 40) | ((sums[last + 1] - sums[first]) * 64 + np.minimum(length, 63)) & ((1 << 40) - 1)
    x[:, CLASSES:] = np.stack(
        (
            np.minimum(share(length), 40) / 10, np.minimum(np.sqrt(np.maximum(share(length**2) - share(length) ** 2, 0)), 40) / 10,
            share(head == 2), share(tail == 4), share(tail == 5), share(tail == 7), share((kind[first] == 6) & (length == 1)),
            share(letters[last + 1] - letters[first] >= length - 1), lines / np.maximum(n, 1), np.bincount(np.unique(code) >> 40, minlength=total) / np.maximum(n, 1),
        ),
        axis=1,
    )
    return x, count


def together(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """As describe, for any number of texts; null is empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    made, some, size = [], [], 0
    for t in raw:
        some.append(t)
        size += len(t)
        if size > TOGETHER:
            made.append(describe(some))
            some, size = [], 0
    if some or not made:
        made.append(describe(some) if some else (np.zeros((0, FEATURES)), np.zeros(0, np.int64)))
    return np.concatenate([x for x, _ in made]), np.concatenate([n for _, n in made])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(x: np.ndarray, count: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Codes, attention and scores. count: the passages of each document, none of them 0."""
    at = np.cumsum(count) - count
    z = np.clip((x - w["mean"]) / w["scale"], -6, 6)
    h = np.tanh(z @ w["E"] + w["e"])
    v, u = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
    s = (v * u) @ w["w"]
    a = np.exp(s - np.repeat(np.maximum.reduceat(s, at), count))
    a /= np.repeat(np.add.reduceat(a, at), count)
    m = np.add.reduceat(a[:, None] * h, at)
    return {"z": z, "h": h, "v": v, "u": u, "a": a, "m": m, "score": sigmoid(m @ w["c"] + w["b"])}


def gradient(x: np.ndarray, count: np.ndarray, label: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The gradient of the mean log loss by each learned weight."""
    at = np.cumsum(count) - count
    f = forward(x, count, w)
    d = (f["score"] - label) / len(label)
    g = {"c": f["m"].T @ d, "b": d.sum(keepdims=True)}
    dm = np.repeat(d[:, None] * w["c"], count, 0)
    da = (dm * f["h"]).sum(1)
    ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at), count))
    g["w"] = (f["v"] * f["u"]).T @ ds
    dv, du = ds[:, None] * w["w"] * f["u"] * (1 - f["v"] ** 2), ds[:, None] * w["w"] * f["v"] * f["u"] * (1 - f["u"])
    g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
    dh = (f["a"][:, None] * dm + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
    g["E"], g["e"] = f["z"].T @ dh, dh.sum(0)
    return g


def fit(x: np.ndarray, count: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Weights from bags and their labels. Without bags: weights that score every document 0.5."""
    rng = np.random.default_rng(SEED)
    w = {
        "E": rng.standard_normal((FEATURES, CODES)) / FEATURES**0.5, "e": np.zeros(CODES), "V": rng.standard_normal((CODES, ATTENTION)) / CODES**0.5,
        "U": rng.standard_normal((CODES, ATTENTION)) / CODES**0.5, "w": rng.standard_normal(ATTENTION) * 0.1, "c": np.zeros(CODES), "b": np.zeros(1),
    }
    fixed = {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES)}
    if not len(count):
        return w | fixed
    spread = x.std(0)
    fixed = {"mean": x.mean(0), "scale": np.where(spread > 1e-3, spread, 1)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, STEPS + 1):
        g = gradient(x, count, label, w | fixed)
        for k in w:
            one, two = moment[k]
            g[k] = g[k] + DECAY * w[k]
            one += 0.1 * (g[k] - one)
            two += 0.001 * (g[k] ** 2 - two)
            w[k] -= RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return w | fixed


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of a row's id, as text, is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Weights from labels.quality of rows that aren't held out: of the SAMPLE first by a hash of the id, those up to LONGEST.

    Null labels and ids are left out; of rows that share an id the least text counts; without labelled rows the weights
    score 0.5.
    """
    chosen = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where("doc_id is not null and label is not null").where(~held_out())
    chosen = chosen.dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= LONGEST)
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # SAMPLE rows at most
    make = lambda texts: [bags(*together(texts))]
    got = add_columns(rows, "text", [T.StructField("bag", T.ArrayType(T.FloatType()))], make).drop("text").toPandas()
    got = got.assign(key=[tuple(b[:FEATURES]) for b in got.bag]).sort_values(["doc_id", "label", "key"], kind="stable")
    bag = [np.asarray(b, np.float64).reshape(-1, FEATURES) for b in got.bag]
    x = np.concatenate(bag) if bag else np.zeros((0, FEATURES))
    return fit(x, np.fromiter(map(len, bag), np.int64, len(bag)), got.label.to_numpy(float))


def bags(x: np.ndarray, count: np.ndarray) -> pa.Array:
    """Each document's passages as one list of numbers."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count * FEATURES))), pa.int32()), pa.array(x.ravel().astype(np.float32), pa.float32()))


def score(df: DataFrame, weights: dict[str, np.ndarray], text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of each row's whole text, 0 to 1; null counts as empty, which has one passage without words.

    Equal texts get equal scores. Other columns stay; one named like `out` is replaced.
    """

    def make(texts: list) -> list:
        got, some, size = [], [], 0
        for t in [*texts, None]:
            size += len(t or "")
            some.append(t)
            if size > TOGETHER:
                got.append(forward(*together(some), weights)["score"])
                some, size = [], 0
        if some:
            got.append(forward(*together(some), weights)["score"])
        return [pa.array(np.concatenate(got)[: len(texts)])]

    return add_columns(df, text, [T.StructField(out, T.DoubleType())], make)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """For each document its score, and whether the score is at least 0.3."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels)).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
