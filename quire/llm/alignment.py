"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked id pairs.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece model; both see a text with a space before it,
and cover the same bytes. Where both have a token's end they cut the text into groups; an A and a B token are linked if
they share a byte. All of a block's links come from one array of bytes in which both kinds of ends are marked.

1. Tokenising is done once; ids are written to the shared folder, in two bytes each.
2. A link's id pair is one int64, B's id above A's. A partition's pairs are counted by np.unique, block by block.
3. Partial counts are range-partitioned and sorted by the pair; a task sums runs of equal pairs and writes a count shard:
   sorted pairs and counts as plain int64 files. As pairs are B-major, each B id's highest count falls out there.
4. Documents are read again, block by block; the shards are memory-mapped, and a block's distinct pairs are looked up by
   searchsorted.

A pair has one partial count for each partition (and each HELD distinct pairs of it), so a frequent pair is no hot key.
What all tasks read, the shards, grows with the number of different pairs, which the two vocabularies bound, and is
mapped, not loaded; the driver gets a line for each shard and the highest count of each B id.
"""

from __future__ import annotations

import functools
import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bpe import gather
from quire.llm.common import add_columns, blocks, forget, saved
from quire.scratch import remove, scratch_dir

#: Bytes of text that a task tokenises at once, and distinct pairs that it holds before it passes their counts on.
BLOCK, HELD = 1 << 20, 2 << 20
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


@functools.cache
def byte_level(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder of a byte-level BPE file and the bytes of each id.

    In such a file an id's order is that of its merge, so that the ids are the ranks that tiktoken merges by, with the
    same result as the tokenizers library's, sooner.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    made = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
    encoder = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in made.items()}, special_tokens={})
    return encoder, [made.get(i, b"") for i in range(max(made) + 1)]


@functools.cache
def pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """A sentencepiece model and the bytes of each id: U+2581 is a space, a byte piece its byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    made = [model.IdToPiece(i) for i in range(model.GetPieceSize())]
    return model, [bytes([int(p[3:-1], 16)]) if model.IsByte(i) else p.replace("▁", " ").encode() for i, p in enumerate(made)]


def table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings' bytes, where each begins, and how many it has."""
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(n) - n, n


@functools.cache
def tables(path_a: str, path_b: str) -> tuple:
    """table() of A's and of B's tokens, and of the decimal ids with each of the marks , | ; behind them."""
    a, b = byte_level(path_a)[1], pieces(path_b)[1]
    return table(a), table(b), table([f"{i}{mark}".encode() for i in range(max(len(a), len(b))) for mark in ",|;"])


@dataclass
class Links:
    """The links of some texts' tokens, in the texts' order. upto_links[i], upto_groups[i]: how many the texts before i have."""

    key: np.ndarray
    upto_links: np.ndarray
    upto_groups: np.ndarray
    end_a: np.ndarray  # of A's and B's tokens: whether they end a group
    end_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def linked(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Links:
    """a, b: the ids of all texts, n_a: how many ids of A each text has, size_a, size_b: how many bytes each id has."""
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    mark = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, np.uint8)
    mark[ends_a] = 1
    mark[ends_b] |= 2
    ends = np.flatnonzero(mark)
    kind = mark[ends]
    is_a, is_b, both = kind & 1 > 0, kind & 2 > 0, kind == 3
    before = lambda x: np.cumsum(x) - x
    key = b[before(is_b)].astype(np.int64) << 32 | a[before(is_a)]
    group = before(both)
    of_text = np.append(0, ends_a)[np.append(0, np.cumsum(n_a))]
    upto = np.searchsorted(ends, of_text, "right")
    return Links(key, upto, np.append(0, np.cumsum(both))[upto], both[is_a], both[is_b], group[is_a], group[is_b])


def written(a: np.ndarray, b: np.ndarray, links: Links, digits: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all groups as a1,a2|b1;a3|b2,b3; and how many each token of either kind has, in that order."""
    groups = int(links.end_a.sum())
    in_a, in_b = (np.bincount(g, minlength=groups) for g in (links.group_a, links.group_b))
    which = np.empty(len(a) + len(b), np.int64)
    which[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[links.group_a]] = 3 * a.astype(np.int64) + links.end_a
    which[np.arange(len(b)) + np.cumsum(in_a)[links.group_b]] = 3 * b.astype(np.int64) + 2 * links.end_b
    return gather(*digits, which), digits[2][which]


def tokenise(texts: list[str | None], path_a: str, path_b: str) -> list:
    """For each text A's and B's ids as bytes, how many there are, the groups and links, and the groups' hash. Nothing where A or B doesn't give the text's bytes."""
    encoder, model = byte_level(path_a)[0], pieces(path_b)[0]
    of_a, of_b, digits = tables(path_a, path_b)
    some = [i for i, t in enumerate(texts) if t]
    ids_a = [np.asarray(encoder.encode_ordinary(" " + texts[i]), np.int64) for i in some]
    ids_b = [np.asarray(x, np.int64) for x in model.encode([texts[i] for i in some], num_threads=1)]
    good = []
    for i, x, y in zip(some, ids_a, ids_b, strict=True):
        whole = (" " + texts[i]).encode()
        good.append(all(int(t[2][ids].sum()) == len(whole) and gather(*t, ids).tobytes() == whole for t, ids in ((of_a, x), (of_b, y))))
    some, ids_a, ids_b = ([x for x, g in zip(xs, good, strict=True) if g] for xs in (some, ids_a, ids_b))
    n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([np.zeros(0, np.int64), *ids]) for ids in (ids_a, ids_b))
    links = linked(a, b, n_a, of_a[2], of_b[2])
    data, sizes = written(a, b, links, digits)
    cut = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(n_a + n_b))].tolist()
    out = [[b""] * len(texts), [b""] * len(texts), *([0] * len(texts) for _ in COUNTS), [""] * len(texts)]
    made = zip(some, ids_a, ids_b, np.diff(links.upto_groups).tolist(), np.diff(links.upto_links).tolist(), cut[:-1], cut[1:], strict=True)
    for i, x, y, groups, n_links, lo, hi in made:
        row = (x.astype("<u2").tobytes(), y.astype("<u2").tobytes(), len(x), len(y), groups, n_links, hashlib.sha256(data[lo : hi - 1]).hexdigest())
        for column, v in zip(out, row, strict=True):
            column[i] = v
    return out


def tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    fields = [T.StructField(c, T.BinaryType()) for c in ("a", "b")] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("groups_sha256", T.StringType())]
    if max(len(byte_level(path_a)[1]), len(pieces(path_b)[1])) > 1 << 16:
        raise ValueError("ids are kept in two bytes each; these vocabularies have more")
    return add_columns(docs, "text", fields, lambda texts: tokenise(texts, path_a, path_b), BLOCK)


def links_of(batch: pa.RecordBatch, path_a: str, path_b: str) -> Links:
    a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").astype(np.int64) for c in ("a", "b"))
    of_a, of_b, _ = tables(path_a, path_b)
    return linked(a, b, batch.column("n_a").to_numpy(), of_a[2], of_b[2])


def summed_runs(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys each once, with the sum of n over its run."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n[:0]


def counted(path_a: str, path_b: str, held: int):
    """The distinct pairs of what a task reads, with their counts; in several parts where they are more than held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda key, n: pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])
        key, n = np.zeros((2, 0), np.int64)
        for block in blocks(batches, "a", BLOCK):
            new, times = np.unique(links_of(block, path_a, path_b).key, return_counts=True)
            both = np.concatenate((key, new))
            order = np.argsort(both, kind="stable")  # two sorted runs
            key, n = summed_runs(both[order], np.concatenate((n, times))[order])
            if len(key) > held:
                yield out(key, n)
                key, n = np.zeros((2, 0), np.int64)
        if len(key):
            yield out(key, n)

    return run


def sharded(folder: str):
    """Writes the runs of a partition sorted by key as two files of int64; gives its first key, its length, and the highest count of each B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"  # of this attempt alone
        first, rows, best = None, 0, {}
        held = np.zeros((2, 0), np.int64)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{name}.keys") as keys, store.open_output_stream(f"{name}.counts") as counts:

            def put(key: np.ndarray, n: np.ndarray) -> None:
                keys.write(key.astype("<i8").tobytes()), counts.write(n.astype("<i8").tobytes())
                b, at = np.unique(key >> 32, return_index=True)
                for x, most in zip(b.tolist(), np.maximum.reduceat(n, at).tolist(), strict=True):
                    best[x] = max(best.get(x, 0), most)

            for batch in batches:
                if not batch.num_rows:
                    continue
                key, n = (np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, ("key", "n"), strict=True))
                key, n = summed_runs(key, n)
                first = int(key[0]) if first is None else first
                held = np.stack((key[-1:], n[-1:]))  # the run may go on
                if len(key) > 1:
                    put(key[:-1], n[:-1])
                    rows += len(key) - 1
            if held.shape[1]:
                put(*held)
                rows += 1
        if rows:
            b, most = np.fromiter(best, np.int64, len(best)), np.fromiter(best.values(), np.int64, len(best))
            made = [pa.array([x]) for x in (name.rpartition("/")[2], first, rows)] + [pa.array([x.tobytes()], pa.binary()) for x in (b, most)]
            yield pa.RecordBatch.from_arrays(made, names=["name", "first", "n", "b", "most"])

    return run


@functools.lru_cache(4096)
def mapped(folder: str, name: str, n: int) -> np.ndarray:
    """A file of n int64, mapped; one in a store that isn't a file system is copied first, to a file that goes with this process."""
    store, root = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", "<i8", "r", shape=(n,))
    with tempfile.TemporaryFile() as copy, store.open_input_stream(f"{root}/{name}") as data:
        while part := data.read(1 << 20):
            copy.write(part)
        copy.flush()
        return np.memmap(copy, "<i8", "r", shape=(n,))


def lookup(keys: np.ndarray, folder: str, shards: list[tuple[str, int, int]]) -> np.ndarray:
    """The counts of sorted keys, all of which are in the shards (name, first key, length), themselves in order."""
    out = np.zeros(len(keys), np.int64)
    cuts = np.append(np.searchsorted(keys, [first for _, first, _ in shards]), len(keys)).tolist()
    for (name, _, n), lo, hi in zip(shards, cuts[:-1], cuts[1:], strict=True):
        if lo < hi:
            at = np.searchsorted(mapped(folder, f"{name}.keys", n), keys[lo:hi])
            out[lo:hi] = mapped(folder, f"{name}.counts", n)[at]
    return out


def scored(folder: str, shards: list[tuple[str, int, int]], best: np.ndarray, carry: list[str], path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "a", BLOCK):
            links = links_of(block, path_a, path_b)
            keys, where = np.unique(links.key, return_inverse=True)
            counts = lookup(keys, folder, shards)
            sums = [np.append(0, np.cumsum(x[where])) for x in (counts == best[keys >> 32], counts)]
            made = [pa.array(np.diff(x[links.upto_links])) for x in sums]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in carry), *made], names=[*carry, "n_best", "count_sum"])

    return run


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, held: int = HELD) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Null and empty texts, and those whose tokens' bytes are not the text's with a space before it, have no tokens: zeros,
    and an empty hash. Repeated rows and rows with a null doc_id count as any other. Other columns are not used; an empty
    table gives no rows. Both vocabularies have at most 65,536 ids.
    """
    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    made = saved(tokens(docs.select("doc_id", "text"), path_a, path_b).drop("text"), "zstd")
    partial = saved(made.where("n_links > 0").select("a", "b", "n_a").mapInArrow(counted(path_a, path_b, held), "key long, n long"), "zstd")
    folder = scratch_dir(spark)
    sorted_ = partial.repartitionByRange("key").sortWithinPartitions("key")
    rows = sorted_.mapInArrow(sharded(folder), "name string, first long, n long, b binary, most binary").collect()  # a row for each shard
    best = np.zeros(1 << 16, np.int64)
    for r in rows:
        b = np.frombuffer(r.b, np.int64)
        best[b] = np.maximum(best[b], np.frombuffer(r.most, np.int64))
    shards = sorted(((r.name, r.first, r.n) for r in rows), key=lambda r: r[1])
    carry = ["doc_id", *COUNTS, "groups_sha256"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields if f.name in carry)
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    out = saved(made.mapInArrow(scored(folder, shards, best, names, path_a, path_b), f"{fields}, n_best long, count_sum long"))
    forget(made, partial)
    remove(spark, folder)
    return out.select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")


def digest(documents: DataFrame) -> DataFrame:
    return aligned(documents)
