"""Near-duplicate documents: MinHash bands for candidates, sequential Bayesian comparison, exact verification.

1. One pass makes each text's set of hashed 5-word shingles, a signature of 320 minima and 40 band keys of 8 minima.
   Texts with equal sets become one class, by aggregation.
2. Classes are range-sorted by (band key, row), so that even one bucket with a third of all rows is spread over tasks.
   Neighbours in a bucket are the first candidates: about as many as rows, however large a bucket is.
3. Pairs are compared in batches of 32 minima. After each batch a pair goes when the posterior probability (uniform
   prior) that its similarity reaches the threshold is below MISS. Of the rest, each class's best pair is verified on
   the full sets, then those that the components of these links leave apart.
4. Buckets that still hold several components are searched wholly: their members outside the largest component against
   all others of other components, in tiles of two blocks of about 256 members. What the same comparison leaves joins
   components to clusters; a tile emits no more than one row for each of its members. Within clusters the search is
   done again with the full sets at hand, and each tile gives the links it finds as stars. Pairs within a component
   need no look; no link between different components is left out.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import add_columns, blocks, forget, saved
from quire.llm.components import components, roots

WORDS = 5
BANDS, ROWS, SEED = 40, 8, 11
#: A link: 100 * intersection >= PERCENT * union, unless a caller gives another percentage. The bands suit 80 and more.
PERCENT = 85
#: Posterior probability of a link below which a pair is dropped, and minima compared at a time.
MISS, BATCH = 1e-9, 32
BLOCK = 256
#: Bytes of text whose sets a task makes at once.
TOGETHER = 2 << 20
#: Parts into which each key's rows are dealt where they meet what is known of the key.
SALTS = 32
#: Distinct words whose hashes a task remembers; others are hashed again.
REMEMBERED = 200_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U = np.uint64


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


HASHES = Hashes()
FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, WORDS, dtype=U) | U(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles: of five words, or of all words where there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(HASHES.__getitem__, words), U, len(words))
    k = min(WORDS, len(h))
    s = np.full(len(h) - k + 1, k, U)
    for i in range(k):
        s += (h[i : len(h) - k + 1 + i] ^ (h[i : len(h) - k + 1 + i] >> U(32))) * FACTORS[i]
    s = (s ^ (s >> U(31))) * U(0x9E3779B97F4A7C15)
    return np.unique(s ^ (s >> U(29)))


def minima(own: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of affine hashes of a set."""
    rng = np.random.default_rng(SEED + 1)
    a, b = rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
    h, least = (own >> U(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(least, (h[None, i : i + 1024] * (a | np.uint32(1)) + b).min(1), out=least)
    return least


def set_hash(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame) -> DataFrame:
    """docs with n_shingles, the hash of the set, the keys of its bands and a byte of each of its minima. Null where there are no words."""
    mix = np.random.default_rng(SEED + 2).integers(1, 1 << 63, (BANDS, ROWS), dtype=U) | U(1)

    def make(texts: list) -> list:
        n, same, keys, sig = [], [], [], []
        for t in texts:
            own = shingles(t)
            n.append(len(own))
            if not len(own):
                same.append(None), keys.append(None), sig.append(None)
                continue
            least = minima(own)
            key = (least.reshape(BANDS, ROWS).astype(U) * mix).sum(1) + np.arange(BANDS, dtype=U)
            key = (key ^ (key >> U(33))) * U(0xFF51AFD7ED558CCD)
            same.append(set_hash(own))
            keys.append((key ^ (key >> U(29))).astype(np.int64))
            sig.append(least.astype(np.uint8).tobytes())
        return [n, same, keys, sig]

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
    return add_columns(docs, "text", fields, make, TOGETHER).drop("text")


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, row) those whose key has another row, with the next row of the key.

    A partition's first and last rows come anyway, numbered, to be matched with the neighbouring partitions' ones.
    """
    part = TaskContext.get().partitionId()
    names = ["key", "row", "next", "edge"]
    kinds = [pa.int64()] * 4

    def some(key, row, nxt, edge) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip((key, row, nxt, edge), kinds, strict=True)], names=names)

    last = None  # the row that waits for its successor: key, row, whether its key came before, whether it is the first
    for batch in batches:
        key, row = batch.column("key").to_numpy(), batch.column("row").to_numpy()
        if not len(key):
            continue
        if last is None:
            key0, row0, before = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
            yield some([int(key[0])], [int(row[0])], [None], [2 * part])
        else:
            key0, row0, before = (np.array([x]) for x in last)
        key, row = np.concatenate((key0, key)), np.concatenate((row0, row))
        follows = key[1:] == key[:-1]
        again = np.concatenate((before, [False] if not len(before) else [], follows)).astype(bool)
        keep = follows | again[:-1]
        nxt = pa.array(row[1:][keep], pa.int64(), mask=~follows[keep])
        yield some(key[:-1][keep], row[:-1][keep], nxt, pa.nulls(int(keep.sum()), pa.int64()))
        last = (key[-1], row[-1], again[-1])
    if last is not None:
        yield some([int(last[0])], [int(last[1])], [None], [2 * part + 1])


@functools.cache
def least_matches(percent: int) -> list[int]:
    """For each number of batches the matches below which a pair is dropped: P(similarity >= threshold | matches) < MISS."""
    t = percent / 100 + (1 - percent / 100) / 256  # bytes of different minima agree now and then
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        p, m = 0.0, -1
        while p < MISS:
            m += 1
            p += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs of signature rows x[i], y[i] of sets with n[i] and m[i] members stay, and their matches."""
    left = np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    matches = np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches(percent)):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (x[left, cut] == y[left, cut]).sum(1)
        stay = matches >= least
        left, matches = left[stay], matches[stay]
    return left, matches


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stay, matches = alike(matrix(batch.column("sig_a")), matrix(batch.column("sig_b")), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
        rows = pa.array(stay)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows), pa.array(matches, pa.int64())], names=["a", "b", "matches"])


def apart_within(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one tile, block i against block j or i with itself: what pairs of different components stay, as stars.

    With the column `set` a pair stays if it is a link, else if its signatures may be of a link. A star has one row for
    each row but the least of those that its pairs connect.
    """
    row, comp, n, block = (group.column(c).to_numpy() for c in ("row", "comp", "n", "block"))
    sig = matrix(group.column("sig").combine_chunks())
    x, y = (np.flatnonzero(block == group.column(c)[0].as_py()) for c in ("i", "j"))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for some in np.array_split(x, max(1, len(x) * len(y) >> 14)):
        p, q = np.repeat(some, len(y)), np.tile(y, len(some))
        other = (comp[p] != comp[q]) & ((p < q) | (block[p] != block[q]))
        p, q = p[other], q[other]
        stay, _ = alike(sig[p], sig[q], n[p], n[q], percent)
        a.append(p[stay]), b.append(q[stay])
    p, q = np.concatenate(a), np.concatenate(b)
    if "set" in group.column_names and len(p):
        sets = [np.frombuffer(v, U) for v in group.column("set").to_pylist()]
        both = np.fromiter((len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(p.tolist(), q.tolist(), strict=True)), np.int64, len(p))
        stay = 100 * both >= percent * (n[p] + n[q] - both)
        p, q = p[stay], q[stay]
    return roots(row[p], row[q]) if len(p) else (row[:0], row[:0])


def across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """apart_within() for each tile of rows sorted by (key, i, j)."""

    def flush(table: pa.Table) -> pa.RecordBatch:
        key = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        made = [apart_within(table.slice(a, b - a), percent) for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, table.num_rows).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*made, strict=True)], names=["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = [held.column(c)[held.num_rows - 1].as_py() for c in ("key", "i", "j")]
        same = np.logical_and.reduce([held.column(c).to_numpy() == v for c, v in zip(("key", "i", "j"), last, strict=True)])
        whole = int(np.flatnonzero(same)[0])
        if whole:
            yield flush(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None and held.num_rows:
        yield flush(held)


def tiled(held: DataFrame, size: int) -> DataFrame:
    """(key, i, j, block, row, comp): rows (key, row, comp) of keys with several components, dealt to tiles of two blocks.

    The largest component's rows have blocks of their own, which meet the others' blocks and not one another.
    """
    sizes = held.groupBy("key", "comp").agg(F.count("*").alias("n"))
    kinds = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("total"), F.max(F.struct("n", "comp")).alias("major")).where("comps > 1")
    blocks_of = lambda n: F.ceil(n / size)
    known = kinds.select("key", F.col("major.comp").alias("major"), blocks_of(F.col("major.n")).alias("n_major"), blocks_of(F.col("total") - F.col("major.n")).alias("n_other"))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))  # a cluster may hold a third of all rows
    cut = held.withColumn("salt", F.pmod(F.xxhash64("row", F.lit(SALTS)), F.lit(SALTS))).join(salted, ["key", "salt"])
    pick = lambda n: F.pmod(F.xxhash64("row"), n).cast("long")
    cut = cut.withColumn("block", F.when(F.col("comp") == F.col("major"), pick(F.col("n_major"))).otherwise(F.col("n_major") + pick(F.col("n_other"))))
    others = F.sequence(F.col("n_major"), F.col("n_major") + F.col("n_other") - 1)
    against = F.when(F.col("block") < F.col("n_major"), others).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n_major") + F.col("n_other") - 1))
    return cut.withColumn("with", F.explode(against)).select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "row", "comp")


def sets_of(need: DataFrame, documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(row, set) for the classes in need (row), made again from one text of each class."""
    texts = documents.join(classes.select("row", "doc_id", "same").join(need, "row"), "doc_id").select("row", "same", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", TOGETHER):
            rows, sets = [], []
            for row, same, text in zip(*(batch.column(c).to_pylist() for c in ("row", "same", "text")), strict=True):
                own = shingles(text)
                if set_hash(own) == same:  # else another text with this doc_id
                    rows.append(row), sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sets, pa.binary())], names=["row", "set"])

    return texts.mapInArrow(make, "row long, set binary")


def verified(pairs: DataFrame, documents: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked, by their full sets."""
    need = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(100 * both >= percent * (len(x) + len(y) - both))
            at = pa.array(np.flatnonzero(yes))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    sets = sets_of(need, documents, classes)
    both = pairs.select("a", "b").join(sets.select(F.col("row").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("set").alias("y")), "b")
    return saved(both.select("a", "b", "x", "y").mapInArrow(linked, "a long, b long"))


def labelled(documents: DataFrame, percent: int) -> DataFrame:
    """near_duplicates() for rows (row, doc_id, text), with their row numbers and whether a row is the first of its component's least doc_id, or has no words."""
    made = saved(sketch(documents.select("row", "doc_id", "text")))
    documents = documents.select("doc_id", "text")
    first = [F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("lead"), *(F.any_value(c).alias(c) for c in ("n_shingles", "keys", "sig"))]
    classes = saved(made.where("n_shingles > 0").groupBy("same").agg(*first))
    rows = classes.where("doc_id is not null").select(F.explode("keys").alias("key"), "row")
    members = saved(rows.repartitionByRange("key", "row").sortWithinPartitions("key", "row").mapInArrow(neighbours, "key long, row long, next long, edge long"))
    edges = members.where("edge is not null")  # two rows of each partition
    over = Window.orderBy("edge")
    beside = edges.select("row", "key", F.lead("row").over(over).alias("next"), F.lead("key").over(over).alias("next_key")).where("key = next_key and row < next")
    chain = members.where("next is not null").select(F.col("row").alias("a"), F.col("next").alias("b")).unionByName(beside.select(F.col("row").alias("a"), F.col("next").alias("b"))).distinct()
    sig = classes.select("row", F.col("n_shingles").alias("n"), "sig")
    named = lambda x: sig.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    likely = saved(chain.join(named("a"), "a").join(named("b"), "b").mapInArrow(functools.partial(compared, percent=percent), "a long, b long, matches long"))
    best = saved(likely.groupBy("b").agg(F.max(F.struct("matches", "a")).alias("best")).select("best.a", "b"))
    links = verified(best, documents, classes, percent)
    label = components(links)
    of = lambda x: label.select(F.col("x").alias(x), F.col("root").alias(f"root_{x}"))
    apart = likely.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    apart = saved(apart.join(best, ["a", "b"], "left_anti"))
    links = links.unionByName(verified(apart, documents, classes, percent))
    label = components(links)

    comp = F.coalesce("root", "row").alias("comp")
    held = saved(members.select("key", "row").distinct().join(label.withColumnRenamed("x", "row"), "row", "left").select("key", "row", comp))
    tiles = lambda t: t.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(functools.partial(across, percent=percent), "a long, b long")
    maybe = saved(tiles(tiled(held, BLOCK).join(sig, "row")).distinct())
    if not maybe.isEmpty():
        cluster = components(maybe.unionByName(label.select(F.col("x").alias("a"), F.col("root").alias("b"))))
        touched = maybe.select(F.col("a").alias("row")).unionByName(maybe.select(F.col("b").alias("row"))).join(cluster.withColumnRenamed("x", "row"), "row", "left")
        touched = touched.select(F.coalesce("root", "row").alias("root")).distinct()
        inside = cluster.select(F.col("x").alias("row"), "root").unionByName(touched.select(F.col("root").alias("row"), "root")).join(touched, "root", "left_semi").withColumnRenamed("root", "key")
        inside = saved(inside.join(label.withColumnRenamed("x", "row"), "row", "left").select("key", "row", comp))
        sets = sets_of(inside.select("row").distinct(), documents, classes)
        more = saved(tiles(tiled(inside, 2 * BLOCK).join(sig, "row").join(sets, "row")))
        label = components(links.unionByName(more))
        forget(inside)

    rooted = classes.select("row", "lead", "same").join(label.withColumnRenamed("x", "row"), "row", "left").select("lead", "same", F.coalesce("root", "row").alias("root"))
    least = rooted.groupBy("root").agg(F.min("lead").alias("lead")).select("root", F.col("lead.doc_id").alias("component_id"), F.col("lead.row").alias("keeper"))
    of = saved(rooted.select("root", "same").join(least, "root").select("same", "component_id", "keeper"))
    out = made.select("row", "doc_id", "n_shingles", "same").join(of, "same", "left")
    for t in (members, held, likely, best, apart, maybe):
        forget(t)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    first = (F.col("n_shingles") == 0) | (F.col("row") == F.col("keeper"))
    return out.select("row", "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), first.alias("first"))


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each row of documents (doc_id, text): doc_id, n_shingles, component_id and kept.

    kept says that doc_id is component_id, the least doc_id of the component; so it is true for each of repeated rows, of
    which dedup() keeps one. Texts without words, null ones included, are linked with nothing and kept. Rows with a null
    doc_id are linked only with equal texts, and have the least doc_id of their component, or null, which counts as equal
    to it. Repeated rows are copies. Other columns are not used.
    """
    return labelled(documents.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), percent).drop("row", "first")


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, by near_duplicates(): rows are numbered once and decided one by one, whatever their doc_id."""
    row = "row" + "_" * max(map(len, docs.columns))  # no column of docs has this name
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = labelled(numbered.select(F.col(row).alias("row"), "doc_id", "text"), percent).where("not first").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*(f"`{c}`" for c in docs.columns))
