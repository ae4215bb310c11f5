"""Mentions of names in texts: whole-word aliases by one table of hashes, over owned ranges of sections, with their evidence.

Aliases that are few enough, after they were counted, go to all tasks as one table, so that texts don't move; of more, each
text meets those whose first two words it has, or whose only one. A stretch of texts is laid out as one array and looked up
by the hashes of its words, then of two words of which the first begins an alias, and so on; what it finds is compared
character by character. It reads letters and digits alone, so that "BUS-43" is found in "bus 43"; what it finds counts if it
begins and ends with words of the text and has breaks only where the alias has them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.structure import union_intervals
from quire.scratch import file_bytes, saved, sized

WORD = r"[\p{L}\p{N}]+"
#: Aliases of one table, and bytes of their file, up to which all tasks get them; a batch of texts with more is read in parts.
ALIASES, ALIAS_BYTES = 1_000_000, 48 << 20
#: Characters of texts that are laid out at once.
STRETCH = 1 << 18
#: Fixed odd numbers: the base of hashes, and what mixes their bits.
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


@functools.cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter or digit; its lower case, each for itself; that one's number in hashes."""
    every = range(0x110000)
    low = np.fromiter((ord(y) if len(y := chr(c).lower()) == 1 else c for c in every), np.uint32, len(every))
    return np.fromiter((chr(c).isalnum() for c in every), bool, len(every)), low, mixed((low.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


@functools.lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n, and their inverses, modulo 2**64."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))


class Laid:
    """Texts one after another: their words' places (a, b) in `whole` and (fa, fb) among the letters and digits alone, and which text each is of."""

    def __init__(self, texts: list[str]):
        letter, low, number = characters()
        self.whole = "\n" + "\n".join(texts) + "\n"
        self.points = np.frombuffer(self.whole.encode("utf-32-le"), np.uint32)
        lettered = letter[self.points]
        edges = np.flatnonzero(lettered[1:] != lettered[:-1]) + 1
        self.a, self.b = edges[::2], edges[1::2]
        self.begin = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.a, [*self.begin, len(self.whole)])))
        self.flat = low[self.points[lettered]]
        self.fb = np.cumsum(self.b - self.a)
        self.fa = self.fb - (self.b - self.a)
        up, self.down = powers(max(2 * STRETCH, 1 << len(self.flat).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(number[self.flat] * up[: len(self.flat)])])

    def hashes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the words from i to j, joined."""
        return mixed((self.sums[self.fb[j]] - self.sums[self.fa[i]]) * self.down[self.fa[i]])


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, count of them, for each."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


class Names:
    """Aliases by rank: the longest goes first, of equally long ones the one with the least target. Found by the hashes of their first words, joined."""

    def __init__(self, pairs: set[tuple]):
        ranked = sorted(pairs, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0, x[1]))
        self.targets, self.aliases = pa.array([t for t, _ in ranked], pa.int64()), pa.array([x for _, x in ranked], pa.string())
        laid = Laid([x for _, x in ranked])
        bounds = np.searchsorted(laid.text, np.arange(len(ranked) + 1))
        start = bounds[:-1][laid.text]  # of each word the first one of its alias
        ends = np.arange(1, len(start) + 1) == bounds[1:][laid.text]
        self.hashes, place = np.unique(laid.hashes(start, np.arange(len(start))), return_inverse=True)
        self.longer = np.zeros(len(self.hashes), bool)
        self.longer[place[~ends]] = True
        by_hash = np.argsort(place[ends], kind="stable")
        self.ranks = laid.text[ends][by_hash]
        self.first = np.searchsorted(place[ends][by_hash], np.arange(len(self.hashes) + 1))
        self.letters, self.at, self.size = laid.flat, np.zeros(len(ranked), np.int64), np.zeros(len(ranked), np.int64)
        self.at[laid.text[ends]] = laid.fa[start[ends]]
        self.size[laid.text[ends]] = laid.fb[ends] - laid.fa[start[ends]]
        self.cuts = (laid.text[~ends] << 32) + laid.fb[~ends] - laid.fa[start[~ends]]
        bits = max(1, len(self.hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes in the table, -1 for those that aren't there."""
        out = np.full(len(hashes), -1)
        top = (hashes >> self.shift).astype(np.int64)
        at, end = self.slot[top], self.slot[top + 1]
        left = np.flatnonzero(at < end)
        at, end, hashes = at[left], end[left], hashes[left]
        while len(left):
            same = self.hashes[at] == hashes
            out[left[same]] = at[same]
            go = ~same & (at + 1 < end)
            left, at, end, hashes = left[go], at[go] + 1, end[go], hashes[go]
        return out

    def places(self, laid: Laid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank, i, j): aliases that stand from word i to word j, all of them."""
        clear = laid.points != ord("_")
        i, out = np.flatnonzero(clear[laid.a - 1]), []
        for more in range(len(laid.a)):
            at = self.known(laid.hashes(i, i + more))
            i, at = i[at >= 0], at[at >= 0]
            count = np.where(clear[laid.b[i + more]], self.first[at + 1] - self.first[at], 0)
            out.append((self.ranks[spread(self.first[at], count)], k := np.repeat(i, count), k + more))
            i = i[self.longer[at] & (i + more + 1 < len(laid.a))]
            i = i[laid.text[i + more + 1] == laid.text[i]]
            if not len(i):
                break
        return tuple(map(np.concatenate, zip(*map(lambda x: self.same(laid, *x), out), strict=True))) if out else (np.zeros(0, np.int64),) * 3

    def same(self, laid: Laid, rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose hashes an alias has: those that have its letters and digits, and breaks only where it has them."""
        good = self.size[rank] == laid.fb[j] - laid.fa[i]
        size = np.where(good, self.size[rank], 0)
        unlike = laid.flat[spread(laid.fa[i], size)] != self.letters[spread(self.at[rank], size)]
        if unlike.any():
            good[np.repeat(np.arange(len(size)), size)[unlike]] = False
        for k in range(int((j - i).max(initial=0))):  # all have equally many words
            key = (rank << 32) + laid.fb[i + k] - laid.fa[i]
            at = np.minimum(np.searchsorted(self.cuts, key), len(self.cuts) - 1)
            good &= self.cuts[at] == key if len(self.cuts) else False
        return rank[good], i[good], j[good]

    def chosen(self, texts: list[str]) -> tuple[Laid, np.ndarray, np.ndarray, np.ndarray]:
        """The texts laid out, and (rank, i, j) of the aliases in them; none overlaps another's place, those of higher rank go first."""
        laid = Laid(texts)
        rank, i, j = self.places(laid)
        order = np.argsort(i, kind="stable")
        rank, i, j = rank[order], i[order], j[order]
        starts = np.ones(len(i), bool)  # of groups that overlap
        starts[1:] = i[1:] > np.maximum.accumulate(j)[:-1]
        alone = starts & np.append(starts[1:], True)
        shared = np.flatnonzero(~alone)
        shared = shared[np.lexsort((i[shared], rank[shared]))]
        taken, last, free = bytearray(len(laid.a)), -1, 0
        for at, own, x, y in zip(shared.tolist(), rank[shared].tolist(), i[shared].tolist(), (j[shared] + 1).tolist(), strict=True):
            if own == last and x < free:
                continue
            last, free = own, y
            if 1 not in taken[x:y]:
                taken[x:y] = b"\1" * (y - x)
                alone[at] = True
        return laid, rank[alone], i[alone], j[alone]

    def read(self, keys: pa.Array, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        """What mentions() returns, for texts and their keys, a stretch at a time."""
        upto = 0
        while upto < len(texts):
            at, size = upto, 0
            while upto < len(texts) and (upto == at or size < STRETCH):
                size += len(texts[upto] or "")
                upto += 1
            laid, rank, i, j = self.chosen([t or "" for t in texts[at:upto]])
            own, a, b = laid.text[i], laid.a[i], laid.b[j]
            quotes = pa.array([laid.whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.string())
            places = [pa.array((x - laid.begin[own]).astype(np.int32)) for x in (a, b)]
            if len(own):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(own + at)), self.targets.take(pa.array(rank)), self.aliases.take(pa.array(rank)), *places, quotes], names=["key", "target", "alias", "start", "end", "quote"])


def automaton_of(aliases: list[tuple]) -> Names:
    """The table of (target, alias) pairs."""
    return Names(set(aliases))


def found_in(text: str, names: Names) -> list[tuple]:
    """(target, alias, start, end) of the aliases in a text, from its beginning on."""
    rows = (r for b in names.read(pa.array([0]), [text]) for r in b.to_pylist())
    return [(r["target"], r["alias"], r["start"], r["end"]) for r in rows]


def reading(names: Names) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts (key, text) read by one table of aliases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from names.read(batch.column("key"), batch.column("text").to_pylist())

    return run


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (key, text, aliases) read by the aliases of their batch."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        wanted = [[(x["target"], x["alias"]) for x in own] for own in batch.column("aliases").to_pylist()]
        at = 0
        while at < len(texts):
            some, upto = set(wanted[at]), at + 1
            while upto < len(texts) and len(some) < ALIASES:
                some.update(wanted[upto])
                upto += 1
            yield from automaton_of(list(some)).read(batch.column("key").slice(at, upto - at), texts[at:upto])
            at = upto


#: Hashes of beginnings, and bytes of their file, up to which they are broadcast, after they were counted.
KEYS, KEY_BYTES = 4_000_000, 48 << 20


def words_of(text: str) -> Column:
    """The words of a text in lower case; none for null."""
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower), F.array().cast("array<string>"))


def beginnings(parts: str) -> Column:
    """What a text that has an alias of these words has of it: its one word, or its first two, each of which may join several of the alias's."""
    n = F.size(parts)
    joined = lambda a, b: F.array_join(F.slice(parts, a, b - a + 1), "")
    two = lambda k: F.transform(F.sequence(k + 1, n), lambda m: F.concat_ws(" ", joined(F.lit(1), k), joined(k + 1, m)))
    pairs = F.flatten(F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), two))
    return F.concat(F.array(joined(F.lit(1), n)), pairs)


def candidates(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, aliases): the aliases (target, alias) whose beginning a text has, for texts that have one."""
    named = aliases.withColumn("parts", words_of("alias")).where("size(parts) > 0")
    named = saved(named.select(F.col("target").cast("long").alias("target"), "alias", F.explode(F.array_distinct(F.transform(beginnings("parts"), lambda x: F.xxhash64(x)))).alias("begin")))
    known = sized(named.select("begin").distinct(), KEYS, KEY_BYTES)
    own = texts.select("key", words_of("text").alias("words"))
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    begins = own.select("key", F.explode(F.array_distinct(F.transform(F.concat("words", pairs), lambda x: F.xxhash64(x)))).alias("begin"))
    held = begins.join(known, "begin", "left_semi").join(sized(named), "begin")
    return held.groupBy("key").agg(F.collect_set(F.struct("target", "alias")).alias("aliases"))


def mentions(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, target, alias, start, end, quote): every place of whole-word aliases (target, alias) in texts (key, text), from 0, the end exclusive, as it stands there.

    Between an alias's words a text may have any characters but letters and digits, or none. Where aliases overlap the
    longer one has the place, of equally long ones the one with the least target. Aliases without letters and digits and
    null texts give nothing. An alias in a batch that another text brought in is looked for in all of the batch's texts:
    whoever has it has its beginning, so nothing more is found. Texts meet aliases by hashes of beginnings; those that no
    alias has go before anything moves. Up to ALIASES of them, which are counted, are one table for all tasks, and no text moves.
    """
    kind = texts.schema["key"].dataType.simpleString()
    out = f"key {kind}, target long, alias string, start int, end int, quote string"
    known = saved(aliases.select(F.col("target").cast("long").alias("target"), "alias").where("alias is not null").distinct())
    if known.count() <= ALIASES and file_bytes(known) <= ALIAS_BYTES:
        pairs = known.toArrow()
        return texts.select("key", "text").mapInArrow(reading(automaton_of(list(zip(*(c.to_pylist() for c in pairs.columns), strict=True)))), out)
    met = texts.select("key", "text").join(candidates(texts, known), "key").select("key", "text", "aliases")
    return met.mapInArrow(scanned, out)


#: Needles that a pass over the texts looks for, and characters of each that stand in the automaton.
NEEDLES, PROBE = 20_000, 24


def holding(texts: DataFrame, needles: DataFrame, most: int = NEEDLES) -> DataFrame:
    """(item, key): which texts (key, text) hold which needles (item, needle), character by character.

    The needles are a stated set that meets all texts, in blocks of about `most`: a block's middle pieces are one
    automaton, which each text passes once, and what it finds is looked up whole. Texts don't move. Null and empty
    needles are in no text.
    """
    known = saved(needles.where("needle <> ''").select(F.col("item").cast("long").alias("item"), "needle"))
    blocks = max(1, -(-known.count() // most))
    kind, out = texts.schema["key"].dataType.simpleString(), None

    def passed(own: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces: dict[str, list[tuple[int, str]]] = {}
            for item, needle in own:
                at = max(0, (len(needle) - PROBE) // 2)
                pieces.setdefault(needle[at : at + PROBE], []).append((item, needle))
            machine = ahocorasick.Automaton()
            for piece, whole in pieces.items():
                machine.add_word(piece, whole)
            machine.make_automaton()
            for batch in batches:
                rows, items = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    seen: dict[tuple[int, str], bool] = {}
                    for _, whole in machine.iter(text) if text and own else ():
                        for x in whole:
                            if x not in seen:
                                seen[x] = x[1] in text
                    found = {item for (item, _), yes in seen.items() if yes}
                    rows += [i] * len(found)
                    items += found
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), batch.column("key").take(pa.array(rows, pa.int64()))], names=["item", "key"])

        return run

    for b in range(blocks):
        own = [(r.item, r.needle) for r in known.where(F.pmod(F.xxhash64("item", "needle"), F.lit(blocks)) == b).collect()]
        part = texts.select("key", "text").mapInArrow(passed(own), f"item long, key {kind}")
        out = part if out is None else out.unionByName(part)
    return out.distinct() if blocks > 1 else out


def owned_pieces(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(section, owner, at, text): the parts of sections (section, owner, text) that their own chunks (section, start, end) cover, merged where these overlap or touch."""
    ranges = union_intervals(chunks.select(F.col("section").alias("key"), "start", "end")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    pieces = F.transform("ranges", lambda r: F.struct(r["start"].alias("at"), F.substring("text", r["start"] + 1, r["end"] - r["start"]).alias("text")))
    return sections.join(ranges.hint("shuffle_hash"), sections["section"] == ranges["key"]).select("section", "owner", F.explode(pieces).alias("p")).select("section", "owner", "p.*")


def edge_id(*parts: str) -> Column:
    """edge: and 24 digits of the hash of the parts, joined by colons."""
    return F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws(":", *(F.col(p).cast("string") for p in parts)).cast("binary"), 256), 1, 24))


def references(sections: DataFrame, chunks: DataFrame, aliases: DataFrame) -> DataFrame:
    """(edge_id, source, target, relation, start, end, quote): what sections (section, owner, text) name in the ranges that their chunks own.

    A document's mentions of itself (owner = target) take their places and give no edge. start and end count from the
    section's first character. Each range is looked at by itself, so no mention spans two of them.
    """
    pieces = owned_pieces(sections, chunks).withColumn("key", F.struct("section", "owner", "at"))
    found = mentions(pieces.select("key", "text"), aliases).where(~F.col("key.owner").eqNullSafe(F.col("target")))
    out = found.select(F.col("key.section").alias("source"), "target", F.lit("references").alias("relation"), (F.col("key.at") + F.col("start")).alias("start"), (F.col("key.at") + F.col("end")).alias("end"), "quote")
    return out.select(edge_id("source", "target", "relation", "source", "start", "end").alias("edge_id"), "*")


def link_references(spans: DataFrame, blocks: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, target, label, start, end): links to http(s) addresses with the places of their labels in sections.

    spans: the stretch (section, block, start, source_start, source_end) of each block that a section holds; blocks:
    (block, text); links: (block, label, target); chunks: (section, start, end). A label counts if it stands once in its
    block, white space apart, within the span, and inside one of the section's chunks.
    """
    trimmed = F.regexp_replace("label", r"^\s+|\s+$", "")
    words = F.transform(F.split(trimmed, r"\s+"), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    good = links.where(F.col("target").rlike("(?i)^https?:") & (trimmed != "")).select("block", "label", "target", F.array_join(words, r"\s+").alias("pattern"))
    own = good.join(blocks.select("block", "text"), "block")
    placed = own.select("block", "label", "target", F.expr("split(text, pattern, -1)").alias("rest"), F.expr("regexp_extract_all(text, pattern, 0)").alias("hits")).where("size(hits) = 1")
    placed = placed.select("block", "label", "target", F.length(F.col("rest")[0]).alias("a"), F.length(F.col("hits")[0]).alias("n"))
    inside = placed.join(spans, "block").where("a >= source_start and (source_end is null or a + n <= source_end)")
    inside = inside.select(F.col("section").alias("source"), "target", "label", (F.col("start") + F.col("a") - F.col("source_start")).alias("start"), (F.col("start") + F.col("a") + F.col("n") - F.col("source_start")).alias("end"))
    held = chunks.select(F.col("section").alias("source"), F.col("start").alias("x"), F.col("end").alias("y"))
    return inside.join(held, (inside["source"] == held["source"]) & (held["x"] <= inside["start"]) & (held["y"] >= inside["end"]), "left_semi")
