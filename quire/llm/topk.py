"""Exact top-k inner products by block-at-a-time pruning.

Vectors are quantised to integers and range-sorted by a code of signs of random projections, so that rows in a range
look alike. Ranges of BLOCK rows are blocks: forward indexes (a dense matrix with ids) with the greatest and least
value of each term; SHARD blocks are a shard, with its own maxima. A query's score with any row of a block or shard is
at most the sum of its terms with those maxima, and at most that with the block's centre and the query's length times
the block's radius more. The kth score starts at that within the query's own block.

Queries, in groups, meet the shards' maxima first, and each is sent to the FIRST shards with the highest bounds. With
the kth score found there they meet the maxima again, and are sent to the others whose bound still reaches it; these
pairs are not kept. Only queries move. In a shard, a query's blocks are scored in the order of their bounds until these
fall below the kth score.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import saved

#: Rows in a block, blocks in a shard, queries in a group.
BLOCK, SHARD, GROUP = 256, 16, 4096
#: Shards that each query is sent to before its kth score is raised.
FIRST = 2
SIGNS, SEED = 10, 3
LOWEST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v the floors of scale * x, as longs, row by row. Rows without an id are left out, and vectors that are null or hold null, NaN or infinite components."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(whole, F.lit(True)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda x: F.floor(x * scale)).alias("v"))


def dense(lists: pa.Array, width: int = 0) -> np.ndarray:
    """A matrix from lists of longs; shorter ones end in zeros."""
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
    return out


@functools.cache
def side(part: int) -> np.ndarray:
    """The directions that codes take the signs of, in 256 components from 256 * part on."""
    return np.random.default_rng((SEED, part)).standard_normal((256, SIGNS))


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = dense(batch.column("v")).astype(float)
        along = np.zeros((len(v), SIGNS))
        for j in range(0, v.shape[1], 256):
            along += v[:, j : j + 256] @ side(j // 256)[: v.shape[1] - j]
        code = ((along > 0) << np.arange(SIGNS)).sum(1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int64())], names=["vec_id", "v", "code"])


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of q and d: in floats where all sums are integers that these hold, else in longs."""
    width = min(q.shape[1], d.shape[1])
    q, d = q[:, :width], d[:, :width]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(width, 1)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (q.astype(kind) @ d.astype(kind).T).astype(np.int64)


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The kth score of each row, LOWEST where there are fewer."""
    return np.full(len(scores), LOWEST) if scores.shape[1] < k else -np.partition(-scores, k - 1, axis=1)[:, k - 1]


QUERY = "struct<row: long, query_id: long, low: long, v: binary, width: int>"
SHARDS = f"shard long, width int, ids binary, rows binary, data binary, top binary, least binary, centre binary, radius double, queries array<{QUERY}>"
ASKED = pa.list_(pa.struct([("row", pa.int64()), ("query_id", pa.int64()), ("low", pa.int64()), ("v", pa.binary()), ("width", pa.int32())]))


def ball(v: np.ndarray) -> tuple[np.ndarray, float]:
    """A centre of integers and how far from it the rows of v are at most."""
    centre = np.round(v.mean(0)).astype(np.int64)
    return centre, float(np.sqrt(((v - centre).astype(float) ** 2).sum(1).max(initial=0)))


def bounds(q: np.ndarray, top: np.ndarray, least: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The most that each row of q can score in each block: by the sum of term maxima, or by the block's centre and radius, whichever is less."""
    by_terms = products(np.maximum(q, 0), top) + products(np.minimum(q, 0), least)
    apart = np.sqrt((q.astype(float) ** 2).sum(1))[:, None] * radius[None, :]
    return np.minimum(by_terms, products(q, centre) + np.ceil(apart * (1 + 1e-9)).astype(np.int64) + 1)


def sharded(every: int, k: int, block: int, shard: int):
    """Shards from rows sorted by code, and each shard's queries with the kth score in their own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, None

        def out(table: pa.Table) -> pa.RecordBatch:
            ids, rows = (table.column(c).to_numpy() for c in ("vec_id", "row"))
            v = dense(table.column("v").combine_chunks())
            queries = []
            for b in range(0, len(ids), block):
                own, at = ids[b : b + block], v[b : b + block]
                asked = np.flatnonzero(own % every == 0)
                if not len(asked):
                    continue
                s = products(at[asked], at)
                s[np.arange(len(asked)), asked] = LOWEST + 1
                low = kth(s, k) if len(own) > k else np.full(len(asked), LOWEST)
                queries += [{"row": int(rows[b + i]), "query_id": int(own[i]), "low": x, "v": at[i].tobytes(), "width": v.shape[1]} for i, x in zip(asked.tolist(), low.tolist(), strict=True)]
            centre, radius = ball(v)
            blobs = (pa.array([x.tobytes()], pa.binary()) for x in (ids, rows, v, v.max(0), v.min(0), centre))
            one = [pa.array([part << 32 | made]), pa.array([v.shape[1]], pa.int32()), *blobs, pa.array([radius]), pa.array([queries], ASKED)]
            return pa.RecordBatch.from_arrays(one, names=["shard", "width", "ids", "rows", "data", "top", "least", "centre", "radius", "queries"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= block * shard:
                yield out(held.slice(0, block * shard))
                made += 1
                held = held.slice(block * shard)
        if held is not None and held.num_rows:
            yield out(held)

    return run


def matrix(asked: list[dict], width: int) -> np.ndarray:
    """The vectors of queries, as wide as the widest, or as width."""
    out = np.zeros((len(asked), max([width, *(x["width"] for x in asked)])), np.int64)
    for i, x in enumerate(asked):
        out[i, : x["width"]] = np.frombuffer(x["v"], np.int64)
    return out


def bounded(most: int | None):
    """Of rows with a group of queries and a group of shards' maxima the pairs (row, shard, bound) whose bound reaches the kth score; of each query the `most` with the highest bounds, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, shards = batch.column("asked")[i].as_py(), batch.column("maxima")[i].as_py()
                width = max(x["width"] for x in shards)
                top, least, centre = (np.zeros((len(shards), width), np.int64) for _ in range(3))
                for j, x in enumerate(shards):
                    for whole, name in ((top, "top"), (least, "least"), (centre, "centre")):
                        whole[j, : x["width"]] = np.frombuffer(x[name], np.int64)
                q = matrix(asked, width)
                bound = bounds(q, top, least, centre, np.array([x["radius"] for x in shards]))
                reaches = bound >= np.array([x["low"] for x in asked])[:, None]
                if most is not None:
                    reaches &= bound >= kth(bound, most)[:, None]
                a, b = np.nonzero(reaches)
                row, shard = np.array([x["row"] for x in asked])[a], np.array([x["shard"] for x in shards])[b]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, shard, bound[a, b])], names=["row", "shard", "bound"])

    return run


def searched(k: int, block: int):
    """The k best of each shard for each query of a group that asks for it."""

    def one(ids: np.ndarray, rows: np.ndarray, data: np.ndarray, asked: list[dict]) -> list[np.ndarray]:
        q, own_row = matrix(asked, data.shape[1]), np.array([x["row"] for x in asked])
        low = np.array([x["low"] for x in asked])
        parts = [data[b : b + block] for b in range(0, len(ids), block)]
        balls = [ball(x) for x in parts]
        bound = bounds(q, np.stack([x.max(0) for x in parts]), np.stack([x.min(0) for x in parts]), np.stack([c for c, _ in balls]), np.array([r for _, r in balls]))
        order = np.argsort(-bound, axis=1, kind="stable")
        best = [np.zeros(0, np.int64)] * 3
        for r in range(order.shape[1]):
            active = np.flatnonzero(bound[np.arange(len(q)), order[:, r]] >= low)
            if not len(active):
                break
            found = [best]
            for b in np.unique(order[active, r]).tolist():
                who = active[order[active, r] == b]
                cut = slice(b * block, (b + 1) * block)
                s = products(q[who], data[cut])
                i, j = np.nonzero((s >= low[who, None]) & (rows[cut][None, :] != own_row[who, None]))
                found.append([who[i], ids[cut][j], s[i, j]])
            who, vec, score = (np.concatenate(x) for x in zip(*found, strict=True))
            sort = np.lexsort((vec, -score, who))
            who, vec, score = who[sort], vec[sort], score[sort]
            first = np.concatenate(([True], who[1:] != who[:-1])) if len(who) else np.zeros(0, bool)
            i = np.arange(len(who))
            rank = i - np.maximum.accumulate(np.where(first, i, 0)) if len(who) else i
            full = rank == k - 1
            low[who[full]] = np.maximum(low[who[full]], score[full])
            best = [x[rank < k] for x in (who, vec, score)]
        return [own_row[best[0]], np.array([x["query_id"] for x in asked])[best[0]], best[1], best[2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows, data = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("ids", "rows", "data"))
                made = one(ids, rows, data.reshape(len(ids), batch.column("width")[i].as_py()), batch.column("asked")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["row", "query_id", "vec_id", "score"])

    return run


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every`, the k other rows with the highest scores, ties to the smaller vec_id.

    Vectors as quantised() keeps them; shorter ones count as if they ended in zeros. Rows count one by one: of rows with
    one vec_id, each is a candidate of all others, and each a query of its own. A table without queries or candidates
    gives no rows. Scores of components beyond 2**31 may leave the range of a long.
    """
    rows = saved(quantised(vectors).mapInArrow(coded, "vec_id long, v array<long>, code long").withColumn("row", F.monotonically_increasing_id()))
    ordered = rows.repartitionByRange("code", "vec_id", "row").sortWithinPartitions("code", "vec_id", "row")
    shards = saved(ordered.mapInArrow(sharded(every, k, block, shard), SHARDS))
    asked = shards.select(F.explode("queries").alias("q")).select("q.*")
    n_asked, n_shards = asked.count(), shards.count()
    groups, parts = max(1, -(-n_asked // group)), max(1, -(-n_shards // group))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    listed = lambda: F.collect_list(F.struct("row", "query_id", "low", "v", "width"))
    maxima = shards.groupBy(dealt("shard", parts).alias("part")).agg(F.collect_list(F.struct("shard", "width", "top", "least", "centre", "radius")).alias("maxima"))

    def pairs(queries: DataFrame, most: int | None) -> DataFrame:
        grouped = queries.groupBy(dealt("row", groups).alias("group")).agg(listed().alias("asked"))
        met = grouped.withColumn("part", every_of(parts)).join(maxima, "part").select("asked", "maxima").repartition(max(1, groups * parts))
        return met.mapInArrow(bounded(most), "row long, shard long, bound long")

    def scored(wanted: DataFrame, queries: DataFrame) -> DataFrame:
        sent = wanted.select("row", "shard").join(queries, "row")
        sent = sent.groupBy("shard", dealt("row", groups).alias("group")).agg(listed().alias("asked"))
        data = shards.select("shard", "width", "ids", "rows", "data").join(sent, "shard")
        return data.select("width", "ids", "rows", "data", "asked").mapInArrow(searched(k, block), "row long, query_id long, vec_id long, score long")

    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("bound"), "shard"))
    chosen = saved(pairs(asked, FIRST).withColumn("nth", nth).where(F.col("nth") <= FIRST).select("row", "shard"))
    first = saved(best(scored(chosen, asked), k))
    raised = asked.join(first.where(F.col("rank") == k).select("row", F.col("score").alias("kth")), "row", "left").withColumn("low", F.greatest("low", "kth")).drop("kth")
    others = pairs(raised, None).join(chosen, ["row", "shard"], "left_anti")
    found = first.drop("rank").unionByName(scored(others, raised))
    return best(found, k).select("query_id", "rank", "vec_id", "score")
