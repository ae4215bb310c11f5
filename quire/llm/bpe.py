"""Byte-level BPE by merge replay over the distinct words of a block of documents.

The words' symbols stand in one array, linked to their neighbours. An inverted index leads from each token pair (by
the rank of its merge) to the positions where it stands; merges are applied in rank order to all their positions at
once, and only the pairs at the two touched neighbours are looked up again and indexed anew. The cost follows the
number of merges in distinct words, also in one word of a million characters.
"""

from __future__ import annotations

import base64
import functools
import gc
import heapq
import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import add_columns

NONE = np.iinfo(np.int64).max
#: Bytes of text or ids that a task encodes or decodes at once; two workers of an executor hold a block each, several times over.
BLOCK = 4 << 20


class Merges:
    """Sorted pair keys with the rank and the resulting token of each merge."""

    def __init__(self, pairs: array) -> None:
        """pairs: left, right, rank and resulting token of each merge, one after another."""
        made = np.frombuffer(pairs, np.int64).reshape(-1, 4)
        key = made[:, 0] << 32 | made[:, 1]
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], made[order, 2]
        self.token = np.zeros(int(made[:, 2].max(initial=0)) + 1, np.int64)
        self.token[made[:, 2]] = made[:, 3]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE where there is none."""
        if not len(self.key):
            return np.full(len(left), NONE)
        key = left << 32 | right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], NONE)


def replay(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of words given by their symbols one after another, and how many ids each word has."""
    n = len(symbols)
    if not n:
        return symbols, np.zeros(len(lengths), np.int64)
    sym = symbols.astype(np.int64)
    ends = np.cumsum(lengths)
    last = np.zeros(n + 1, bool)
    last[ends[lengths > 0] - 1] = True
    after = np.arange(1, n + 2)  # n: no neighbour
    after[:n][last[:n]] = n
    before = np.arange(-1, n)
    before[1:][last[:n]] = n
    before[0] = before[n] = n
    rank = np.full(n + 1, NONE)
    inner = np.flatnonzero(~last[:n])
    rank[inner] = merges.ranks(sym[inner], sym[inner + 1])
    sym = np.append(sym, -1)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def post(where: np.ndarray, ranks: np.ndarray) -> None:
        if len(where) == 1:
            groups = [where]
            heads = ranks.tolist()
        else:
            order = np.argsort(ranks, kind="stable")
            where, ranks = where[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            heads = ranks[np.append(0, cuts)].tolist()
            groups = np.split(where, cuts) if len(cuts) else [where]
        for r, g in zip(heads, groups, strict=True):
            if r in index:
                index[r].append(g)
            else:
                index[r] = [g]
                heapq.heappush(heap, r)

    first = inner[rank[inner] < NONE]
    if len(first):
        post(first, rank[first])
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if not len(at):
            continue
        right = after[at]
        if len(at) > 1 and sym[at[0]] == sym[right[0]]:  # one symbol twice: of a run, every other position merges
            at.sort()
            right = after[at]
            start = np.append(True, right[:-1] != at[1:])
            i = np.arange(len(at))
            at = at[(i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0]
            right = after[at]
        sym[at] = merges.token[r]
        far = after[right]
        after[at] = far
        before[far] = at
        before[n] = n
        rank[right] = NONE
        sym[right] = -1
        left = before[at]
        touched = np.concatenate((at, left[left < n]))
        if len(at) > 1:
            touched = np.unique(touched)
        now = np.full(len(touched), NONE)
        has = after[touched] < n
        some = touched[has]
        if len(some):
            now[has] = merges.ranks(sym[some], sym[after[some]])
        rank[touched] = now
        live = now < NONE
        if live.any():
            post(touched[live], now[live])
    alive = sym[:n] >= 0
    kept = np.concatenate(([0], np.cumsum(alive)))
    return sym[:n][alive], kept[ends] - kept[ends - lengths]


def uncollected(f):
    """Without Python's cycle collector, which would walk millions of strings again and again; these functions make no cycles."""

    @functools.wraps(f)
    def run(*args):
        gc.disable()
        try:
            return f(*args)
        finally:
            gc.enable()

    return run


def gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The slices of ids that which names, one after another."""
    n = lengths[which]
    total = int(n.sum())
    if not total:
        return ids[:0]
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    at = np.repeat((starts[which] - np.cumsum(n) + n).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return ids[at]


# ---- ranks of a tiktoken file ------------------------------------------------------------------------------------

#: Chunks that no match of the pre-token pattern leaves: an optional space with what stands up to the next white space,
#: or white space. The pattern itself is applied to distinct chunks only.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space to Python but not to the pattern.
ODD = re.compile("[\x1c-\x1f]")


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; empty for an id that the file doesn't have."""
    with open(path, "rb") as f:
        rank = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [rank.get(i, b"") for i in range(max(rank) + 1)]


@functools.cache
def byte_vocabulary(path: str) -> tuple[Merges, np.ndarray, dict[bytes, int]]:
    """The merges, the id of each single byte, and the id of each token."""
    rank = {t: r for r, t in enumerate(token_bytes(path)) if t}
    pairs = array("q")
    for t, r in rank.items():
        for i in range(1, len(t)):
            if t[:i] in rank and t[i:] in rank:
                pairs.extend((rank[t[:i]], rank[t[i:]], r, r))
    return Merges(pairs), np.array([rank[bytes([i])] for i in range(256)], np.int64), rank


def numbered(texts: list[str | None], pattern: str, numbers: defaultdict[str, int]) -> list[np.ndarray]:
    """The numbers of each text's chunks; those not in numbers yet get the next ones."""
    split, number = regex.compile(pattern).findall, numbers.__getitem__
    return [np.fromiter(map(number, (split(t) if ODD.search(t) else CHUNK.findall(t)) if t else ()), np.int32) for t in texts]


def fresh() -> defaultdict[str, int]:
    return defaultdict(count().__next__)


def words_of(chunks: Iterable[str], pattern: str) -> tuple[list[tuple[int, ...]], list[bytes]]:
    """The numbers of each chunk's words, and the distinct words."""
    split, parts = regex.compile(pattern).findall, fresh()
    part = parts.__getitem__
    of_chunk = []
    for c in chunks:  # nearly all are a word, or a word and a mark; what isalpha() says is \p{L} for each character
        if c.isalpha() or c[0] == " " and c[1:].isalpha():
            of_chunk.append((part(c),))
        elif c[-1] in ".," and c[1 if c[0] == " " else 0 : -1].isalpha():
            of_chunk.append((part(c[:-1]), part(c[-1])))
        else:
            of_chunk.append(tuple(map(part, split(c))))
    return of_chunk, [p.encode("utf-8", "surrogatepass") for p in parts]


def replayed(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, one after another, and how many each has."""
    merges, single, _ = byte_vocabulary(path)
    return replay(single[np.frombuffer(b"".join(words), np.uint8)], np.fromiter(map(len, words), np.int64, len(words)), merges)


def coded(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """As replayed, where words that are a token need no merge."""
    whole = byte_vocabulary(path)[2]
    known = np.fromiter((whole.get(w, -1) for w in words), np.int64, len(words))
    ids, n = replayed([w for w, k in zip(words, known.tolist(), strict=True) if k < 0], path)
    lengths = np.ones(len(words), np.int64)
    lengths[known < 0] = n
    flat = np.zeros(int(lengths.sum()), np.int64)
    flat[(np.cumsum(lengths) - lengths)[known >= 0]] = known[known >= 0]
    flat[np.repeat(known < 0, lengths)] = ids
    return flat, lengths


@uncollected
def encode_block(texts: list[str | None], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another, and how many each has."""
    numbers = fresh()
    docs = numbered(texts, pattern, numbers)
    of_chunk, words = words_of(numbers, pattern)
    flat, lengths = coded(words, path)
    return by_chunk(flat, np.cumsum(lengths) - lengths, lengths, of_chunk, docs)


def by_chunk(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, of_chunk: list[tuple[int, ...]], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """From ids by word to ids by chunk to ids by document."""
    sizes = np.fromiter(map(len, of_chunk), np.int64, len(of_chunk))
    which = np.fromiter((p for c in of_chunk for p in c), np.int64, int(sizes.sum()))
    ids = gather(flat, starts, lengths, which).astype(np.int32)
    ends = np.concatenate(([0], np.cumsum(lengths[which]) if len(which) else which))
    upto = np.concatenate(([0], np.cumsum(sizes)))
    begin, stop = ends[upto[:-1]], ends[upto[1:]]
    n = stop - begin
    out = [gather(ids, begin, n, d) for d in docs]
    return (np.concatenate(out) if out else ids), np.fromiter(map(len, out), np.int64, len(out))


def id_lists(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of bytes from all of them together and the item of data at which each ends."""
    offsets = (np.append(0, ends) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with the token ids of a text column by the ranks in a tiktoken file, without special tokens.

    A null or empty text has no ids. Rows, repeated ones included, keep their other columns; one named like ids is
    replaced. No shuffle: the index spans the distinct words of a block of a partition.
    """
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    field = T.StructField(ids, T.ArrayType(T.IntegerType()))
    return add_columns(df, text, [field], lambda texts: [id_lists(*encode_block(texts, path, pattern))], BLOCK)


@functools.cache
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids, one after another, where each begins, and how many it has."""
    n = np.fromiter(map(len, token_bytes(path)), np.int64)
    return np.frombuffer(b"".join(token_bytes(path)), np.uint8), np.cumsum(n) - n, n


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the bytes that a column of token ids stands for. Null ids: null; none: no bytes."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make(lists: pa.Array) -> list:
        data, starts, lengths = token_table(path)
        which = lists.flatten().to_numpy(zero_copy_only=False)
        upto = np.append(0, np.cumsum(lengths[which]))
        ends = upto[np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]
        made = binaries(gather(data, starts, lengths, which), ends)
        return [pc.if_else(lists.is_valid(), made, None) if lists.null_count else made]

    return add_columns(df, ids, [T.StructField(out, T.BinaryType())], make, BLOCK, arrow=True)


def digest(documents: DataFrame) -> DataFrame:
    """For each document the number of ids and the hashes of the ids in decimal and of the bytes decoded from them."""
    done = decode(encode(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).drop("text"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# ---- a tokenizers file: lower case, white space dropped, word ends -----------------------------------------------

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@functools.cache
def word_vocabulary(path: str) -> tuple[Merges, np.ndarray, np.ndarray, dict[str, int]]:
    """The merges, the id of each byte within a word and at its end, and the special tokens."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    vocab = made["model"]["vocab"]
    pairs = array("q")
    for r, m in enumerate(made["model"]["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs.extend((vocab[a], vocab[b], r, vocab[a + b]))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    rest = count(256)
    mark = [chr(i) if i in set(plain) else chr(next(rest)) for i in range(256)]
    inner, last = (np.array([vocab[c + s] for c in mark], np.int64) for s in ("", "</w>"))
    return Merges(pairs), inner, last, {t["content"]: t["id"] for t in made["added_tokens"]}


def lower(text: str) -> str:
    """Lower case by single characters, as the file's normaliser has it: no final sigma."""
    low = text.lower()
    return low if "ς" not in low and "Σ" not in text else "".join(map(str.lower, text))


@uncollected
def encode_words(texts: list[str | None] | pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """As encode_block, by the vocabulary and the rules of word_bpe_49k.json.

    Splitting at white space and numbering the distinct chunks is left to Arrow; so are chunks of Latin letters, also
    with a full stop or comma behind them. The rules' expression is applied to the other distinct chunks.
    """
    merges, inner, last, special = word_vocabulary(path)
    marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    chunk, each = coded.dictionary, pc.list_value_length(lists).to_numpy()
    low = pc.utf8_lower(chunk)
    plain = pc.match_substring_regex(chunk, r"^[\x{0}-\x{12f}\x{131}-\x{2ff}]*$")
    cut, end = pc.utf8_slice_codeunits(low, 0, -1), pc.utf8_slice_codeunits(low, -1)
    whole = pc.and_(plain, pc.utf8_is_alpha(low)).to_numpy(zero_copy_only=False)
    marked = pc.and_(pc.and_(plain, pc.utf8_is_alpha(cut)), pc.is_in(end, pa.array([".", ","]))).to_numpy(zero_copy_only=False) & ~whole
    other = np.flatnonzero(~(whole | marked))
    found: list[list[str]] = []
    for c in chunk.take(pa.array(other)).to_pylist():
        own: list[str] = []
        for piece in marks.split(c) if "<|" in c else (c,):
            if piece in special:
                own.append(piece)
            elif piece:
                own += WORDS.findall(lower(piece if piece.isascii() else unicodedata.normalize("NFC", piece)))
        found.append(own)
    sizes = np.where(whole, 1, 2)
    sizes[other] = np.fromiter(map(len, found), np.int64, len(found))
    upto = np.concatenate(([0], np.cumsum(sizes)))
    one, two = pa.array(whole), pa.array(marked)
    parts = pa.concat_arrays([low.filter(one), cut.filter(two), end.filter(two), pa.array([w for own in found for w in own], pa.string())]).dictionary_encode()
    number = parts.indices.to_numpy()
    which = np.empty(upto[-1], np.int64)
    places = [upto[:-1][whole], upto[:-1][marked], upto[:-1][marked] + 1, gather(np.arange(upto[-1]), upto[:-1], sizes, other)]
    which[np.concatenate(places)] = number
    word = parts.dictionary
    known = pc.index_in(word, pa.array(list(special))).fill_null(-1).to_numpy()
    known = np.append(np.array(list(special.values()), np.int64), -1)[known]
    rest = word.filter(pa.array(known < 0)).cast(pa.binary())
    n = pc.binary_length(rest).to_numpy().astype(np.int64)
    joined = np.frombuffer(rest.buffers()[2] or b"", np.uint8)[np.frombuffer(rest.buffers()[1], np.int32)[rest.offset] if len(rest) else 0 :][: int(n.sum())]
    symbols = inner[joined]
    if len(n):
        symbols[np.cumsum(n) - 1] = last[joined[np.cumsum(n) - 1]]
    ids, n = replay(symbols, n, merges)
    lengths = np.ones(len(word), np.int64)
    lengths[known < 0] = n
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.int32)
    flat[starts[known >= 0]] = known[known >= 0]
    flat[np.repeat(known < 0, lengths)] = ids
    flat = gather(flat, starts, lengths, which)  # by chunk
    ends = np.concatenate(([0], np.cumsum(lengths[which])))
    begin, n = ends[upto[:-1]], ends[upto[1:]] - ends[upto[:-1]]
    used = coded.indices.to_numpy()
    total = np.concatenate(([0], np.cumsum(n[used])))
    at = np.concatenate(([0], np.cumsum(each)))
    return gather(flat, begin, n, used), np.diff(total[at])
