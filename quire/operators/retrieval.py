"""Ranking of many questions at once: postings, BM25, cosine, rank fusion, recall, budgeted passages."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.scratch import saved, sized

K1, B = 1.5, 0.75


#: Digits after the point to which scores are compared, so that sums of the same numbers in another order tie.
TIES = 9


#: Distinct terms of all questions up to which they are a set in the plan, met in each document's row.
TERMS = 20_000


def quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def run_ends(words: str) -> Column:
    """The places, from 1, at which the runs of equal words end in a column of sorted words."""
    ends = f"filter(sequence(1, size({words})), i -> i = size({words}) or get({words}, i - 1) <> get({words}, i))"
    return F.when(F.size(words) > 0, F.expr(ends)).otherwise(F.array().cast("array<int>"))


def frequencies(docs: DataFrame, keep: tuple[str, ...] = (), **lists: tuple[Column, DataFrame]) -> DataFrame:
    """(doc_id, the columns of keep, and for each name: name, an array of (term, f), and name_len): how often each document has the terms of questions.

    lists: by name the documents' tokens and the questions (q_id, term, times). A document's tokens stand in its row, so
    its terms are counted there: those that no question has go, the rest is sorted and its runs are measured. Nothing
    moves, and what is written has a row for each document with the questions' terms in it. Where the questions have
    more than TERMS terms, tokens meet them by a join instead.
    """
    terms = {name: [r.term for r in asked.select("term").distinct().limit(TERMS + 1).collect()] for name, (_, asked) in lists.items()}
    out = docs.select("doc_id", *keep, *(c.alias(name) for name, (c, _) in lists.items()))
    out = out.withColumns({f"{name}_len": F.when(F.col(name).isNotNull(), F.size(name)) for name in lists})
    for name, (_, asked) in lists.items():
        if len(terms[name]) > TERMS:
            out = joined_frequencies(out, name, asked)
            continue
        inside = f"filter({name}, w -> w in ({', '.join(map(quoted, terms[name]))}))" if terms[name] else f"filter({name}, w -> false)"
        out = out.withColumn(name, F.sort_array(F.coalesce(F.expr(inside), F.array().cast("array<string>")))).withColumn("ends", run_ends(name))
        counts = F.expr(f"transform(ends, (e, k) -> struct(get({name}, e - 1) as term, cast(e - coalesce(get(ends, k - 1), 0) as bigint) as f))")
        out = out.withColumn(name, counts).drop("ends")
    return saved(out)


def joined_frequencies(docs: DataFrame, name: str, asked: DataFrame) -> DataFrame:
    """docs with the column of tokens replaced by the (term, f) of those that questions have; a shuffle by document."""
    row = docs.withColumn("row", F.monotonically_increasing_id())
    row = saved(row)
    words = row.select("row", F.explode(name).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    counts = words.groupBy("row", "term").agg(F.count("*").alias("f")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("term", "f"))).alias("counts"))
    none = F.array().cast("array<struct<term:string,f:bigint>>")
    return row.join(counts, "row", "left").withColumn(name, F.coalesce("counts", none)).drop("row", "counts")


#: Pairs of a document and a question that one task sums up.
PAIRS = 1_000_000


def spread(counted: DataFrame, pairs: int, most: int | None = None) -> DataFrame:
    """Documents dealt by id to so many partitions that none has more than about `most` (PAIRS) of the pairs that come of them.

    A document's row is small and its pairs are many, so the number follows from the pairs and not from the rows' bytes.
    """
    parts = max(counted.sparkSession.sparkContext.defaultParallelism, -(-pairs // (most or PAIRS)))
    return counted.repartition(parts, "doc_id")


def pairs_of(counted: DataFrame, queries: DataFrame) -> int:
    """The most pairs that documents and questions can make."""
    return counted.count() * queries.select("q_id").distinct().count()


def postings(counted: DataFrame, pairs: int) -> DataFrame:
    """(doc_id, len, term, f) of documents (doc_id, len, tf), with all rows of a document in one partition; pairs as in spread()."""
    return spread(counted, pairs).select("doc_id", "len", F.explode("tf").alias("x")).select("doc_id", "len", "x.term", "x.f")


def bm25(counted: DataFrame, queries: DataFrame, floor: float | None = None) -> DataFrame:
    """(q_id, doc_id, score) for documents (doc_id, len, tf) and queries (q_id, term, times): only documents with a term of the query.

    Documents' counts move once, a row for each document; then they meet the terms' weights and the questions where they
    are, and are summed there, a bounded number of pairs in each task. Terms, frequencies and questions are broadcast up to a counted number of rows.
    """
    totals = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))  # one row
    df = counted.select(F.explode("tf").alias("x")).groupBy("x.term").agg(F.count("*").alias("df"))
    average = F.greatest(F.col("avg"), F.lit(floor)) if floor is not None else F.col("avg")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = sized(queries.join(sized(df), "term").crossJoin(F.broadcast(totals)).select("q_id", "term", "times", "df", "n", idf.alias("idf"), average.alias("average")))
    most = weighed.agg(F.coalesce(F.least(F.sum("df"), F.max("n") * F.count_distinct("q_id")), F.lit(0)).alias("pairs")).first().pairs
    weight = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("average")))
    hits = postings(counted, most).join(weighed.drop("df", "n"), "term")
    return hits.groupBy("doc_id", "q_id").agg(F.round(F.sum(weight * F.col("times")), TIES).alias("score")).select("q_id", "doc_id", "score")


#: Weights of a full-text index's fields, and the constants of its ranking.
FIELDS = {"title": 0.1, "text": 1.0}
FIELD_K1, FIELD_B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Letters with marks, and the letters that a full-text index reads in their place.
MARKED = [c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and c == c.lower()]
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)


def index_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, letters without their marks."""
    return F.regexp_extract_all(F.translate(F.lower(text), "".join(MARKED), PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fielded(chunks: DataFrame, queries: DataFrame, allowed: Column, most: int = 10) -> DataFrame:
    """(q_id, doc_id, score, rank): the chunks (doc_id, kind, title, text, and what allowed needs) with all of a query's first twenty words, the best `most` of 1 to 100.

    Bodies and tables come before other kinds, short ones last, then by BM25 over both fields, whose words count with the
    field's weight; ties by doc_id. Frequencies are those of all chunks, allowed or not, as an index has them. Counts,
    kinds and the scope come from one pass over the texts.
    """
    words = queries.select("q_id", F.slice(index_terms(F.col("question")), 1, 20).alias("words"))
    asked = words.select("q_id", F.size(F.array_distinct("words")).alias("need"), F.explode("words").alias("term")).groupBy("q_id", "need", "term").agg(F.count("*").alias("times"))
    plain = F.length(F.regexp_replace("text", r"^\s+|\s+$", ""))
    marked = chunks.withColumns({"late": (~F.col("kind").isin("body", "table")).cast("int"), "brief": (plain < 120).cast("int"), "seen": F.coalesce(allowed, F.lit(False))})
    counts = frequencies(marked, ("late", "brief", "seen"), **{name: (index_terms(F.col(name)), asked) for name in FIELDS})
    size = reduce(Column.__add__, (F.coalesce(f"{name}_len", F.lit(0)) for name in FIELDS))
    totals = counts.agg(F.count("*").alias("n"), F.avg(size).alias("avg"))  # one row
    weighed = F.concat(*(F.expr(f"transform({name}, x -> struct(x.term as term, x.f * {w}D as f))") for name, w in FIELDS.items()))
    rows = spread(counts, pairs_of(counts, asked)).select("doc_id", "late", "brief", "seen", size.alias("len"), F.explode(weighed).alias("x"))
    rows = rows.groupBy("doc_id", "late", "brief", "seen", "len", "x.term").agg(F.sum("x.f").alias("f"))  # where they are
    df = sized(counts.select(F.explode(F.array_distinct(F.concat(*(F.transform(name, lambda x: x["term"]) for name in FIELDS)))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    terms = sized(asked.join(df, "term").crossJoin(F.broadcast(totals)).select("q_id", "need", "term", "times", idf.alias("idf"), "avg"))
    part = F.col("times") * F.col("idf") * F.col("f") * (FIELD_K1 + 1) / (F.col("f") + FIELD_K1 * (1 - FIELD_B + FIELD_B * F.col("len") / F.col("avg")))
    found = rows.where("seen").join(terms, "term").groupBy("doc_id", "q_id", "need", "late", "brief").agg(F.count("*").alias("have"), F.round(F.sum(part), TIES).alias("score"))
    order = Window.partitionBy("q_id").orderBy("late", "brief", F.desc("score"), "doc_id")
    best = found.where("have = need").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(max(most, 1), 100))
    return best.select("q_id", "doc_id", "score", "rank")


def top(scores: DataFrame, k: int, score: str = "score", key: str = "q_id", tie: str = "doc_id") -> DataFrame:
    """The k best of each key with their rank from 1, ties by `tie`."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(F.col(a), F.col(b)) / (F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b))))


#: Clusters of vectors, which a task compares each vector and question with, and by how much bounds are wider than their sums.
CLUSTERS, SLACK = 1024, 1e-7


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Unit vectors, shorter ones with zeros behind them."""
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = lists.flatten().to_numpy()
    return out / np.sqrt((out**2).sum(1))[:, None]


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def units(rows: DataFrame, key: str) -> DataFrame:
    """(key, v) as doubles, without rows whose vector is null or has no length."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select(key, F.transform("v", lambda x: x.cast("double")).alias("v")).where(length > 0)


def clustered(rows: DataFrame, width: int, centres: np.ndarray) -> DataFrame:
    """(doc_id, v, cluster, angle): the centre that each row is nearest to, and its angle from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = angles(matrix(batch.column("v"), width), centres)
                nearest = apart.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32()), pa.array(apart[np.arange(len(nearest)), nearest])], names=["doc_id", "v", "cluster", "angle"])

    return rows.mapInArrow(run, "doc_id long, v array<double>, cluster int, angle double")


def bounds(asked: DataFrame, width: int, centres: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int, least: float) -> DataFrame:
    """(q_id, cluster, bound, first): of each question the clusters that may hold a cosine of `least`, and the most that it can be there.

    No vector within a radius of a centre is nearer than the centre's angle less the radius. first marks those with the
    highest bounds that together have more than k rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            most = np.cos(np.clip(angles(matrix(batch.column("v"), width), centres) - radii, 0, np.pi)) + SLACK
            order = np.argsort(-most, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            first = np.zeros(most.shape, bool)
            np.put_along_axis(first, order, before <= k, axis=1)
            i, j = np.nonzero((most >= least) & (sizes > 0))
            yield pa.RecordBatch.from_arrays([batch.column("q_id").take(pa.array(i)), pa.array(j, pa.int32()), pa.array(most[i, j]), pa.array(first[i, j])], names=["q_id", "cluster", "bound", "first"])

    return asked.mapInArrow(run, "q_id long, cluster int, bound double, first boolean")


def met(pairs: DataFrame, asked: DataFrame, pieces: DataFrame, width: int, k: int, least: float, block: int) -> DataFrame:
    """(q_id, doc_id, score): of each pair of a question and a cluster the k best rows of each of the cluster's pieces.

    Questions are sent to the clusters that they have to see, in groups of about `block`.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, ask = batch.column("rows")[i].values, batch.column("asked")[i].values
                score = np.round(matrix(ask.field("v"), width) @ matrix(own.field("v"), width).T, TIES)
                ids, q_ids = own.field("doc_id").to_numpy(), ask.field("q_id").to_numpy()
                score[(q_ids[:, None] == ids[None, :]) | (score < least)] = -2
                low = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] > k else np.full(len(q_ids), -2.0)
                a, b = np.nonzero((score >= low[:, None]) & (score > -2))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(ids[b]), pa.array(score[a, b])], names=["q_id", "doc_id", "score"])

    groups = pairs.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("groups"))
    sent = pairs.select("q_id", "cluster").join(F.broadcast(groups), "cluster")  # a row for each cluster at most
    sent = sent.join(asked, "q_id")
    sent = sent.groupBy("cluster", F.pmod(F.xxhash64("q_id"), F.col("groups")).alias("group")).agg(F.collect_list(F.struct("q_id", "v")).alias("asked"))
    return pieces.join(sent, "cluster").select("rows", "asked").mapInArrow(best, "q_id long, doc_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0, block: int = 2048, clusters: int = CLUSTERS) -> DataFrame:
    """(q_id, doc_id, score, rank): for queries (q_id, v) the k rows (doc_id, v) with the greatest cosine of at least `least`, ties by doc_id; no row with its own id.

    Exact. Rows are dealt to clusters around some of them, chosen by a hash, and large clusters to pieces of about
    `block` rows; a question sees the clusters that the triangle inequality doesn't rule out: first those with the
    highest bounds, then, with the kth score that they gave, the others that still reach it. Only questions are copied.
    A row without a vector, or whose vector has no length, takes no part.
    """
    rows, asked = saved(units(vectors, "doc_id")), saved(units(queries, "q_id"))
    n, widths = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first(), asked.agg(F.max(F.size("v"))).first()[0]
    width = max(n.w or 0, widths or 0)
    number = min(clusters, math.isqrt(n.n) + 1) if n.n > block else 1
    chosen = rows.select("v", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(number).select("v").collect()
    if not chosen:
        return rows.select(F.lit(0).cast("long").alias("q_id"), "doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    centres = matrix(pa.array([r.v for r in chosen], pa.list_(pa.float64())), width)
    placed = saved(clustered(rows, width, centres))
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in placed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():  # a row for each cluster
        sizes[r.cluster], radii[r.cluster] = r.n, r.r
    parts = F.element_at(F.array(*(F.lit(max(1, -(-int(x) // block))) for x in sizes)), F.col("cluster") + 1)
    pieces = saved(placed.groupBy("cluster", F.pmod(F.xxhash64("doc_id"), parts).alias("piece")).agg(F.collect_list(F.struct("doc_id", "v")).alias("rows")))
    if number == 1:
        return top(met(asked.select("q_id", F.lit(0).alias("cluster")), asked, pieces, width, k, least, block), k)
    pairs = saved(bounds(asked, width, centres, sizes, radii, k, least))
    found = saved(top(met(pairs.where("first"), asked, pieces, width, k, least, block), k))
    low = found.where(F.col("rank") == k).select("q_id", F.col("score").alias("low"))
    others = pairs.where("not first").join(low, "q_id", "left").where("low is null or bound >= low")
    return top(found.drop("rank").unionByName(met(saved(others.select("q_id", "cluster")), asked, pieces, width, k, least, block)), k)


def fuse(lists: list[DataFrame], offset: int, ties: str) -> DataFrame:
    """(q_id, doc_id, score): sums of 1 / (60 + rank + offset) over ranked lists (q_id, doc_id, rank from 1).

    offset 0 counts ranks from 1, -1 from 0. ties: "first" for the earliest list and rank, "id" for the doc_id; they are
    in the column tie.
    """
    all_ = None
    for i, x in enumerate(lists):
        part = x.select("q_id", "doc_id", "rank", F.lit(i).alias("list"))
        all_ = part if all_ is None else all_.unionByName(part)
    out = all_.groupBy("q_id", "doc_id").agg(F.round(F.sum(1 / (60 + F.col("rank") + offset)), TIES).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    tie = F.col("first.list") * 1_000_000 + F.col("first.rank") if ties == "first" else F.col("doc_id")
    return out.withColumn("tie", tie.cast("long")).drop("first")


def passages(ranked: DataFrame, most: int = 4, budget: int = 24_000, each: int = 12_000, least: int = 500) -> DataFrame:
    """(q_id, picks, used): of ranked (q_id, rank, doc_id, n_chars) in order, as many as fit, each cut to `each`; none when less than `least` is left."""
    start = F.struct(F.array().cast("array<struct<doc_id:bigint,taken:bigint>>").alias("picks"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, x: Column) -> Column:
        taken = F.least(x["n_chars"], F.lit(each).cast("long"), F.lit(budget).cast("long") - s["used"])
        go = (F.size(s["picks"]) < most) & (F.lit(budget) - s["used"] >= least) & (taken > 0)
        return F.when(go, F.struct(F.concat(s["picks"], F.array(F.struct(x["doc_id"].alias("doc_id"), taken.alias("taken")))).alias("picks"), (s["used"] + taken).alias("used"))).otherwise(s)

    rows = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "n_chars")))  # ranked lists have a fixed length
    return ranked.groupBy("q_id").agg(F.aggregate(rows, start, step).alias("s")).select("q_id", "s.picks", "s.used")
