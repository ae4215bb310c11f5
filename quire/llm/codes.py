"""Vector codes by four codebooks, whose nearest entries are found through a filter of quantised coordinates.

A vector's integer components are cut into PARTS equal parts, and each part is replaced by the index of the nearest of
up to ENTRIES entries of its position's codebook. Codebooks come from ROUNDS rounds of assigning all parts and taking
the floors of the means, over the whole table; only codebooks and sums by entry leave the tasks.

The nearest entries are found as in a VA-file. Each coordinate of the entries is quantised to one of CELLS cells, which
are as wide as the entries in them. For a query, lookup tables hold the least and greatest squared distance from its
coordinate to each cell; their sums over an entry's cells (taken for all entries at once, as a product with the matrix
that says which entry lies in which cell) bound the distance to the entry. Only entries whose lower bound doesn't exceed
the least upper bound are refined, with exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import forget, saved
from quire.llm.topk import dense
from quire.scratch import BROADCAST_ROWS

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Cells of a coordinate, a number of 4 bits; rows whose tables a task holds at once.
CELLS, ROWS = 16, 1024
#: Components beyond this are held at it, so that squared distances and their sums stay exact.
MOST = 1 << 28
#: Bounds are sums of floats; this share more than covers their rounding.
SLACK = 1e-5


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors with v, the floors of scale * x as longs, row by row, without rows whose embedding is null or holds null, NaN or infinite components."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & F.coalesce(whole, F.lit(True)))
    return kept.withColumn("v", F.transform(x, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * scale)))))


class Filter:
    """The entries of one codebook with the cells of their coordinates."""

    def __init__(self, entries: np.ndarray) -> None:
        k, w = entries.shape
        self.entries = entries
        cuts = np.sort(entries, axis=0)[np.arange(1, CELLS) * k // CELLS]
        cell = (entries[None] > cuts[:, None]).sum(0) if w else np.zeros((k, 0), np.int64)
        at = np.arange(w) * CELLS + cell
        self.low, self.high = np.full(w * CELLS, MOST), np.full(w * CELLS, -MOST)
        np.minimum.at(self.low, at, entries), np.maximum.at(self.high, at, entries)
        self.high = np.maximum(self.low, self.high)  # cells without entries: any interval, no entry looks there
        self.where = np.zeros((w * CELLS, k), np.float32)
        self.where[at, np.arange(k)[:, None]] = 1

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x with the entries that may be nearest to them, in order: every nearest entry, ties too, is among them."""
        most = max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0))
        kind = np.float32 if most < 1 << 22 else np.float64  # both hold the differences exactly
        each = np.repeat(x.astype(kind), CELLS, axis=1)
        under, over = self.low.astype(kind) - each, each - self.high.astype(kind)
        where = self.where.astype(kind, copy=False)
        lower = np.square(np.maximum(np.maximum(under, over), 0)) @ where
        upper = np.square(np.minimum(under, over)) @ where
        return np.nonzero(lower * (1 - SLACK) <= upper.min(1, keepdims=True) * (1 + SLACK))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each row's nearest entry, of equals the least, and the squared distance."""
        index, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x), ROWS):
            some = x[a : a + ROWS]
            i, j = self.candidates(some)
            d = np.square(some[i] - self.entries[j]).sum(1)
            first = np.searchsorted(i, np.arange(len(some)))
            low = np.minimum.reduceat(d, first)
            hit = np.flatnonzero(d == low[i])
            hit = hit[np.append(True, i[hit][1:] != i[hit][:-1])]
            index[a : a + len(some)], least[a : a + len(some)] = j[hit], low
        return index, least


def parts_of(lists: pa.Array, width: int) -> list[np.ndarray]:
    whole = dense(lists, width)
    return [whole[:, p * width // PARTS : (p + 1) * width // PARTS] for p in range(PARTS)]


def summed(books: list[np.ndarray], width: int) -> Callable:
    """For each part and entry of what a task reads: how many parts it is nearest to, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Filter(b) for b in books]
        n = np.zeros((PARTS, len(books[0])), np.int64)
        total = np.zeros((PARTS, len(books[0]), width // PARTS), np.int64)
        for batch in batches:
            for p, x in enumerate(parts_of(batch.column("v"), width)):
                index, _ = filters[p].nearest(x)
                n[p] += np.bincount(index, minlength=len(books[p]))
                order = np.argsort(index, kind="stable")
                found = np.flatnonzero(np.bincount(index, minlength=len(books[p])))
                if len(found):
                    total[p, found] += np.add.reduceat(x[order], np.searchsorted(index[order], found))
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    return run


def coded(books: list[np.ndarray], width: int, carry: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Filter(b) for b in books]
        for batch in batches:
            made = [f.nearest(x) for f, x in zip(filters, parts_of(batch.column("v"), width), strict=True)]
            code = np.stack([i for i, _ in made], 1).astype(np.uint8)
            text = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(text, pa.string()), pa.array(sum(d for _, d in made), pa.int64())], names=[*carry, "code", "error"])

    return run


def learned(vectors: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position after some rounds over all rows (vec_id, v) of vectors."""
    ids = [r.vec_id for r in vectors.select("vec_id").where("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    begin = vectors.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id")  # vectors of a few ids move
    first = np.zeros((0, width), np.int64)
    for r in begin.collect():
        first = np.vstack([first, np.pad(np.array(r.v, np.int64), (0, width - len(r.v)))])
    books = [first[:, p * width // PARTS : (p + 1) * width // PARTS].copy() for p in range(PARTS)]
    for _ in range(rounds if len(first) else 0):
        sums = vectors.select("v").mapInArrow(summed(books, width), "part long, entry long, n long, total array<long>")
        at = [F.sum(F.element_at("total", i + 1)) for i in range(width // PARTS)]
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*at).alias("total")).collect():  # PARTS * entries rows at most
            books[r.part][r.entry] = [t // r.n for t in r.total]
    return books


def books_hash(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def label_sums(rows: DataFrame) -> DataFrame:
    """rows with label_error, the sum of error over the rows with an equal label, nulls together.

    Sums are made before anything meets. They are broadcast where they are few, else those of labels with more than one
    in BROADCAST_ROWS of all rows, which are no more than that; the rows of the other labels meet their sums by hash.
    """
    sums = saved(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    few = sums
    if sums.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        few = sums.where(F.col("n") > sums.agg(F.sum("n")).first()[0] / BROADCAST_ROWS)
    few = F.broadcast(few.select(F.col("label").alias("of"), "label_error", F.lit(True).alias("found")))
    met = rows.join(few, rows["label"].eqNullSafe(few["of"]), "left").drop("of")
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return met.drop("found")
    rest = met.where("found is null").drop("label_error")
    many = sums.select(F.col("label").alias("of"), "label_error")
    rest = rest.join(many, rest["label"].eqNullSafe(many["of"]))
    return met.where("found").drop("found").unionByName(rest.drop("of", "found"))


def encoded(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """For each vector: vec_id, label, code (two hex digits for each part), error, label_error and codebooks_sha256.

    Rows whose embedding is null or holds null, NaN or infinite components are left out. The width is that of the longest
    vector, up to a multiple of PARTS; shorter ones count as if they ended in zeros. Repeated rows are coded one by one;
    of rows with one vec_id, the least vector can begin a codebook. A null vec_id is coded and begins none; codebooks have
    fewer entries where there are fewer ids, and where there is none at all no row has a code and the result is empty.
    Components beyond 2**28 are held there. Other columns are not used.
    """
    kept = saved(quantised(vectors.select("vec_id", "embedding", "label")).select("vec_id", "label", "v"))
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-width // PARTS) * PARTS
    books = learned(kept, width, entries, rounds)
    if not len(books[0]):
        kept = kept.where("false")
    fields = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    rows = saved(kept.mapInArrow(coded(books, width, ["vec_id", "label"]), f"vec_id {fields['vec_id']}, label {fields['label']}, code string, error long"))
    forget(kept)
    return label_sums(rows).select("vec_id", "label", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))


def digest(vectors: DataFrame) -> DataFrame:
    return encoded(vectors).drop("label")
