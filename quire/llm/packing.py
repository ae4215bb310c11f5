"""Packing along a space-filling curve.

Each document's token counts are hashed to a short vector, projected to three dimensions by a fixed random matrix and
given a Hilbert key there, so that documents with similar words lie close on the curve. Documents are range-sorted by
that key and laid end to end; a document's first position is the number of tokens before it on the whole curve, and
sequences are the consecutive stretches of `length` positions. Every sequence but the very last one is full.

Positions need only keys and lengths (the ids themselves are moved once, to meet their position). Range sorting by
(key, doc_id, row) splits even a run of equal keys over many tasks; what is known of all partitions together is one
total for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import bpe
from quire.llm.common import add_columns, saved

BUCKETS, BITS, SEED = 128, 10, 20240607


def projection(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and sign of each id, and the matrix from buckets to three dimensions. Fixed by SEED."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, BUCKETS, size), rng.choice([-1.0, 1.0], size), rng.standard_normal((BUCKETS, 3))


def cells(vectors: np.ndarray) -> np.ndarray:
    """Grid coordinates of unit vectors' projections, which are near normal with variance 1: by a logistic curve close to its distribution."""
    share = 1 / (1 + np.exp(-1.702 * np.clip(vectors, -8, 8)))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position on the Hilbert curve of each row of grid coordinates: Gray-coded, axes exchanged and inverted bit by bit."""
    x = [points[:, i].astype(np.int64).copy() for i in range(points.shape[1])]
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            up = (x[i] >> b) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> b) & 1 == 1, turn ^ ((1 << b) - 1), turn)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | ((x[i] ^ turn) >> b) & 1
    return key


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """docs with n, the number of ids with the closing id 1; curve, the Hilbert key; ids, little-endian in 2 bytes, or 4 where the vocabulary is larger."""

    def make(texts: list) -> list:
        _, inner, last, special = bpe.word_vocabulary(path)
        size = 1 + max(*bpe.word_vocabulary(path)[0].token.tolist(), *inner.tolist(), *last.tolist(), *special.values())
        bucket, sign, matrix = projection(size)
        ids, n = bpe.encode_words(texts, path)
        ends = np.cumsum(n)
        vectors, out = np.zeros((len(n), BUCKETS)), []
        kind = "<u2" if size <= 1 << 16 else "<u4"
        for i, own in enumerate(np.split(ids, ends[:-1]) if len(n) else ()):
            if len(own):
                vectors[i] = np.bincount(bucket[own], sign[own], BUCKETS)
            out.append(np.append(own, 1).astype(kind).tobytes())
        length = np.linalg.norm(vectors, axis=1)
        at = vectors / np.where(length > 0, length, 1)[:, None] @ matrix
        return [pa.array(n + 1), pa.array(hilbert(cells(at))), out]

    fields = [T.StructField("n", T.LongType()), T.StructField("curve", T.LongType()), T.StructField("ids", T.BinaryType())]
    return add_columns(docs, "text", fields, make).drop("text")


def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows with its number and the sum of n before each row."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(np.full(len(n), part)), pa.array(before + np.cumsum(n) - n)], names=["row", "part", "within"]
        )
        before += int(n.sum())


def pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, n = batch.column("position").to_numpy(), batch.column("n").to_numpy()
            count = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.where(k == 0, first[row], (first[row] // length + k) * length)
            end = np.minimum((begin // length + 1) * length, first[row] + n[row])
            start = begin - first[row]
            crc, of, ids = [], -1, np.zeros(0, "<u4")
            blobs = batch.column("ids")
            for i, a, b in zip(row.tolist(), start.tolist(), (end - first[row]).tolist(), strict=True):
                if i != of:
                    raw = blobs[i].as_buffer()
                    ids, of = np.frombuffer(raw, "<u2" if len(raw) == 2 * n[i] else "<u4").astype("<u4"), i
                crc.append(zlib.crc32(ids[a:b]))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take), pa.array(start), pa.array(end - begin), pa.array(crc, pa.int64()),
                    pa.array(n[row]), pa.array(begin // length), pa.array(begin % length), batch.column("curve").take(take),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve"],
            )

    return run


def pack(docs: DataFrame, length: int = 2048, path: str | None = None) -> DataFrame:
    """The pieces into which documents (doc_id, text) are cut to fill sequences of `length` tokens, each id in exactly one piece.

    A null or empty text counts as the closing id alone. Repeated rows are documents of their own. Other columns of docs
    are not used. No documents: no pieces. The last sequence is the only one that may be shorter than `length`.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    made = saved(tokenised(docs.select("doc_id", "text"), path).withColumn("row", F.monotonically_increasing_id()))
    sort = ["curve", "doc_id", "row"]
    ordered = made.select("row", "n", *sort[:2]).repartitionByRange(*sort).sortWithinPartitions(*sort)
    laid = saved(ordered.mapInArrow(offsets, "row long, part long, within long").join(made.select("row", "n"), "row"))
    totals = laid.groupBy("part").agg(F.sum("n").alias("total"))  # as many rows as partitions
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = laid.join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("within")).alias("position"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long"
    return made.join(placed.hint("shuffle_hash"), "row").mapInArrow(pieces(length), schema)
