"""Edit-aware token counts.

A document's text is cut at pre-token boundaries into leaves of LEAF chunks. A segment tree over the leaves keeps the
sums of their characters and of their tokens. An edit finds its leaves by descending the tree, cuts again from the
start of the first leaf that the edit's left context can change until a cut meets an old leaf boundary behind the
edit, encodes those chunks only, and adds the differences along the paths to the root. The tree's shape stays.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import bpe
from quire.llm.common import add_columns, blocks

LEAF = 32
#: Characters behind a chunk that its end can depend on, in "white space but the last of it, before a word".
AHEAD = 2


def pattern(text: str):
    return regex.compile(public_tokenizers.PATTERN) if bpe.ODD.search(text) else bpe.CHUNK


def tree(leaves: np.ndarray) -> np.ndarray:
    """Sums in complete binary trees, one for each row of leaves: node i has the children 2i and 2i + 1, the leaves are the second half."""
    half = 1 << max(0, leaves.shape[1] - 1).bit_length()
    out = np.zeros((len(leaves), 2 * half), np.int64)
    out[:, half : half + leaves.shape[1]] = leaves
    while half > 1:
        np.add(out[:, half : 2 * half : 2], out[:, half + 1 : 2 * half : 2], out=out[:, half // 2 : half])
        half //= 2
    return out


#: Characters from which on a chunk's tokens are counted by merge replay, whose cost doesn't grow with the square of a word.
LONG = 64


@functools.cache
def library(path: str) -> tiktoken.Encoding:
    ranks = {t: r for r, t in enumerate(bpe.token_bytes(path)) if t}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunk_tokens(chunks: list[str], path: str) -> np.ndarray:
    """The number of tokens of each chunk."""
    encode = library(path).encode_ordinary
    n = np.fromiter((len(encode(c)) if len(c) < LONG else 0 for c in chunks), np.int64, len(chunks))
    long = [i for i, c in enumerate(chunks) if len(c) >= LONG]
    n[long] = bpe.encode_block([chunks[i] for i in long], path, public_tokenizers.PATTERN)[1]
    return n


class Planted:
    """The trees of a block of texts, and the number of tokens of each chunk seen so far."""

    def __init__(self, texts: list[str], path: str, trees: bool = True) -> None:
        self.path, self.numbers, self.n = path, bpe.fresh(), np.zeros(0, np.int64)
        docs = bpe.numbered(texts, public_tokenizers.PATTERN, self.numbers) if trees else []
        self.learn()
        size = np.fromiter(map(len, self.numbers), np.int64, len(self.numbers))
        both = np.stack((size, self.n))
        self.chars, self.tokens = [], []
        for d in docs:
            a, b = tree(np.add.reduceat(both[:, d], np.arange(0, len(d), LEAF), 1) if len(d) else np.zeros((2, 1), np.int64))
            self.chars.append(a), self.tokens.append(b)

    def learn(self) -> None:
        """Encodes the chunks that were numbered since the last time."""
        if len(self.numbers) > len(self.n):
            self.n = np.append(self.n, chunk_tokens(list(islice(self.numbers, len(self.n), None)), self.path))

    def edit(self, texts: list[str], chars: list[list[int]], tokens: list[list[int]], edits: list[list[dict | None]]) -> list[int]:
        """Applies each text's edits in place, the kth ones of all texts together; how many chunks each text had encoded again."""
        again = [0] * len(texts)
        for k in range(max(map(len, edits), default=0)):
            plans = []
            for i, own in enumerate(edits):
                if k < len(own) and own[k] is not None:
                    start = min(max(own[k]["start"] or 0, 0), len(texts[i]))
                    end = min(max(own[k]["end"] or 0, start), len(texts[i]))
                    plan = Plan(texts[i], chars[i], start, end, own[k]["new"] or "")
                    plans.append((i, plan, [*map(self.numbers.__getitem__, plan.chunks)]))
            self.learn()
            n = self.n.tolist()
            for i, plan, own in plans:
                plan.apply(chars[i], tokens[i], [n[c] for c in own])
                texts[i], again[i] = plan.text, again[i] + len(own)
        return again


def leaf_at(chars: list[int], position: int) -> tuple[int, int]:
    """The first leaf that ends behind a position, and its start; the last leaf for a position at the end."""
    half, node, start = len(chars) // 2, 1, 0
    if position >= chars[1]:
        return half - 1, chars[1] - chars[-1]
    while node < half:
        node *= 2
        if position >= start + chars[node]:
            start += chars[node]
            node += 1
    return node - half, start


def put(sums: list[int], leaf: int, value: int) -> None:
    node = leaf + len(sums) // 2
    change = value - sums[node]
    while node and change:
        sums[node] += change
        node //= 2


class Plan:
    """What one edit of one document asks to be encoded: the chunks, and the leaves that they fill anew."""

    def __init__(self, text: str, chars: list[int], start: int, end: int, new: str) -> None:
        self.text = text[:start] + new + text[end:]
        half = len(chars) // 2
        self.first, begin = leaf_at(chars, max(0, start - AHEAD))
        leaf, edge = leaf_at(chars, max(end - 1, begin))
        edge += chars[half + leaf]
        shift = len(self.text) - len(text)
        chunks, at = [], begin
        for m in pattern(self.text).finditer(self.text, begin):
            while edge + shift < at and leaf < half - 1:
                leaf += 1
                edge += chars[half + leaf]
            if at == edge + shift and at >= start + len(new):
                break
            chunks.append(m[0])
            at = m.end()
        else:
            leaf = half - 1
        self.last, self.chunks = max(leaf, self.first), chunks

    def apply(self, chars: list[int], tokens: list[int], n: list[int]) -> None:
        """Deals the chunks to the leaves first to last, evenly, and corrects the sums above them."""
        leaves = self.last - self.first + 1
        for i in range(leaves):
            a, b = len(n) * i // leaves, len(n) * (i + 1) // leaves
            put(chars, self.first + i, sum(map(len, self.chunks[a:b])))
            put(tokens, self.first + i, sum(n[a:b]))


LONGS = T.ArrayType(T.LongType())
#: Bytes of text that a task indexes or edits at once.
BLOCK = bpe.BLOCK


def longs(lists: list) -> pa.Array:
    """Arrays or lists of longs as one Arrow array."""
    ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat, pa.int64()))


def index(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with the trees of its texts: chars and tokens, whose second item is the total. Null counts as empty."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make(texts: list) -> list:
        made = Planted([t or "" for t in texts], path)
        return [longs(made.chars), longs(made.tokens)]

    return add_columns(df, text, [T.StructField("chars", LONGS), T.StructField("tokens", LONGS)], make, BLOCK)


def edit(df: DataFrame, path: str | None = None) -> DataFrame:
    """df with its texts and trees after the edits in its column `edits` (array of start, end, new, in code points), one after another.

    Adds n_before, the tokens before, and reencoded, the chunks that had to be encoded again. Positions beyond a text
    count as its end, an end before its start as that start, null or no edits as none. Needs text; chars and tokens as
    index() makes them are read where df has them, else the texts are indexed in the same pass.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    new = {"text": T.StringType(), "chars": LONGS, "tokens": LONGS, "n_before": T.LongType(), "reencoded": T.LongType()}
    keep = [f for f in df.schema.fields if f.name not in new]
    given = {"chars", "tokens"} <= set(df.columns)
    names = [f.name for f in keep] + list(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            made = Planted(texts, path, not given)
            chars, tokens = ([x.tolist() for x in made.chars], [x.tolist() for x in made.tokens]) if not given else (batch.column(c).to_pylist() for c in ("chars", "tokens"))
            before = [t[1] for t in tokens]
            again = made.edit(texts, chars, tokens, [e or [] for e in batch.column("edits").to_pylist()])
            arrays = [pa.array(texts, pa.string()), longs(chars), longs(tokens), pa.array(before, pa.int64()), pa.array(again, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *arrays], names=names)

    read = [*keep, *(f for f in df.schema.fields if f.name == "text" or given and f.name in ("chars", "tokens"))]
    return df.select(*(f"`{f.name}`" for f in read)).mapInArrow(run, T.StructType(keep + [T.StructField(c, t) for c, t in new.items()]))


def sample_edits(n: int = 3):
    """Edits of a document that follow from its id and length: replacements, insertions and deletions at hashed places."""
    h = lambda k: F.xxhash64("doc_id", F.lit(k))
    length = F.length("text").cast("long")
    new = F.array(*map(F.lit, ("", " and so on", "42", "\n", "'ll", "  ", "É")))
    one = lambda k: F.struct(
        F.pmod(h(3 * k), length + 1).alias("start"), (F.pmod(h(3 * k), length + 1) + F.pmod(h(3 * k + 1), F.lit(24))).alias("end"), F.element_at(new, (F.pmod(h(3 * k + 2), F.lit(7)) + 1).cast("int")).alias("new")
    )
    return F.array(*(one(k) for k in range(n)))


def digest(documents: DataFrame) -> DataFrame:
    """For each document its tokens before and after three edits, the chunks encoded again for them, and the new text's hash."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = edit(docs.withColumn("edits", sample_edits()))
    return made.select("doc_id", F.col("n_before").alias("n_tokens_before"), F.col("tokens")[1].alias("n_tokens"), "reencoded", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
