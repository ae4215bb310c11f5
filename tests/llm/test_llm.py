"""The operators against brute force, round trips and held-out labels, with odd inputs."""

import base64
import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe, chat, counts, media, minhash, packing, pii, quality, topk, urls
from quire.llm.components import components, roots

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a" * 3000, "é" * 50, "x y", "x y", "İ Σς 🙂 <|endoftext|> \x1c\x1d z", "don't 'll 42  7\t\r\n", "“quotes” — dash"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 5 else None, t, "kept") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, letters, longest, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(n)]


# ---- 9


def test_byte_bpe(spark, odd, empty, reference):
    texts = [t or "" for t in ODD] + random_texts(500, "abcAB 'sdtrelm09\n\t é中Σ!-", 60)
    ids, n = bpe.encode_block(texts, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for t, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert own.tolist() == reference.encode_ordinary(t)
    rows = bpe.decode(bpe.encode(odd)).collect()
    assert Counter((r.text or "").encode() for r in rows) == Counter(bytes(r.decoded) for r in rows)
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.digest(odd).collect()}
    for i, t in enumerate(ODD):
        want = reference.encode_ordinary(t or "")
        assert (i if i % 5 else None, hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(want)) in got
    assert bpe.digest(empty).count() == 0
    clash = bpe.encode(odd.withColumn("block", F.lit(3)).unionByName(odd.withColumn("block", F.lit(3))))  # repeated rows, an input column `ids`
    assert clash.columns == ["doc_id", "text", "block", "ids"] and clash.count() == 2 * len(ODD)


def test_byte_bpe_words_of_many_blocks(spark, reference):
    texts = random_texts(300, "abcdeABé 'stm09\n", 80, 5) + ["qwzx" * 20_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    assert all(got[i] == reference.encode_ordinary(t) for i, t in enumerate(texts[:300]))
    assert reference.decode(got[300]) == texts[300]
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: t.encode() for i, t in enumerate(texts)}


def test_word_bpe():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t or "" for t in ODD] + random_texts(500, "abcAB 'sdtrelm09\n\t éfiΣ!-", 60, 2)
    ids, n = bpe.encode_words(texts, public_tokenizers.path("word_bpe_49k.json"))
    for t, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert own.tolist() == library.encode(t, add_special_tokens=False).ids


# ---- 6


def test_hilbert_curve():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = points[np.argsort(packing.hilbert(points, 3))]
    assert sorted(packing.hilbert(points, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("length", [2048, 16])
def test_packing(spark, odd, empty, length):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 3)], "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, length).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, t in enumerate(ODD * 3):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += p.length
        assert at == len(ids)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    fill = []
    for s in sorted(used):
        at = 0
        for o, n in sorted(used[s]):
            assert o == at
            at += n
        fill.append(at)
    assert all(f == length for f in fill[:-1]) and 0 < fill[-1] <= length
    assert packing.pack(empty).count() == 0


# ---- 4


def base_by_regex(x):
    out = []
    for kind, p in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m[0])
            digits = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
            if (kind != "ip" or all(int(y) <= 255 for y in m[0].split("."))) and (kind != "card" or (13 <= len(d) <= 19 and sum(digits) % 10 == 0)) and (kind != "phone" or 9 <= len(d) <= 15):
                out.append((kind, *m.span()))
    return out


def test_pii_base(spark, odd, empty):
    texts = random_texts(3000, "ab@..-+12340  ()%9", 80) + ["4539 1488 0343 6467", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1 (988) 555-2485"]
    for t in texts:
        assert pii.base(t) == base_by_regex(t)
        kept = {(k, s, e) for k, s, e, base in pii.spans(t) if base}
        assert kept == set(pii.base(t))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:200])], "doc_id long, text string")
    for r in pii.digest(docs).collect():
        want = base_by_regex(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == w[0] for w in want) for k in pii.KINDS)
    assert pii.digest(odd).count() == len(ODD) and pii.digest(empty).count() == 0


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
        ("j [at] mail1 [dot] example [dot] com", "email", "j [at] mail1 [dot] example [dot] com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("to １９２.１６８.１.１ go", "ip", "１９２.１６８.１.１"),
        ("plus one four one five five five five two six seven one x", "phone", "plus one four one five five five five two six seven one"),
        ("card four five three nine one four eight eight zero three four three six four six seven", "card", "four five three nine one four eight eight zero three four three six four six seven"),
    ],
)
def test_pii_disguised(text, kind, span):
    assert (kind, text.index(span), text.index(span) + len(span), False) in pii.spans(text)
    assert span not in pii.masked(text)


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("to john@example[dot]com now", "email", "john@example[dot]com"),
        ("to john@example dot com now", "email", "john@example dot com"),
        ("to john dot doe@example.com now", "email", "john dot doe@example.com"),
        ("at 192 dot 168 dot 1 dot 20 there", "ip", "192 dot 168 dot 1 dot 20"),
        ("at 192[.]168[.]1[.]1 there", "ip", "192[.]168[.]1[.]1"),
        ("at 192(dot)168(dot)1(dot)1 there", "ip", "192(dot)168(dot)1(dot)1"),
        ("call +49 151 234 five six now", "phone", "+49 151 234 five six"),
        ("call +1 (988) 555-24 eight 5 now", "phone", "+1 (988) 555-24 eight 5"),
        ("card 4539 1488 0343 646 seven ok", "card", "4539 1488 0343 646 seven"),
        ("to john at exa\u200bmple dot com now", "email", "john at exa\u200bmple dot com"),
        ("to jоhn@exa\u200bmple[dot]com now", "email", "jоhn@exa\u200bmple[dot]com"),
        ("call +49 151 234 fi\u200bve six now", "phone", "+49 151 234 fi\u200bve six"),
        ("to " + "a" * 300 + " at example dot com", "email", "a" * 300 + " at example dot com"),
        ("reach jane.doe at example.ca today", "email", "jane.doe at example.ca"),
        ("my e-mail: jane at example.museum", "email", "jane at example.museum"),
        ("Contact jane at post.example.nz please", "email", "jane at post.example.nz"),
        ("courriel jane at example.ch", "email", "jane at example.ch"),
        ("jane at example.com", "email", "jane at example.com"),
    ],
)
def test_pii_disguised_each_alone(text, kind, span):
    assert (kind, text.index(span), text.index(span) + len(span), False) in pii.spans(text)
    assert span not in pii.masked(text)


def test_pii_undisguised_numbers():
    for text in ("plus 100 000 000 more", "1. 2. 3. 4 and 2 + 100 200 300", "In 1995, 1996, 1997, 1998 one of them", "items 1, 2, 3, 4 point 5", "a dot plot @ noon"):
        assert pii.spans(text) == []
    for text in ("[ " * 50_000, " " * 200_000 + "@", "a@" * 50_000 + " dot ", "a dot " * 30_000 + "@", "1 " * 100_000, "1(" * 50_000):
        began = time.monotonic()
        pii.spans(text)
        assert time.monotonic() - began < 5


def test_pii_clean(spark):
    for text in ("He arrived at noon.It was late", "look at page.html for more", "the mail came. We met at example.ca", "Stay at home.Then call", "left at 12.30 today"):
        assert pii.spans(text) == []
    assert pii.spans("We looked at it. At noon one or two came, the dot at the end was red; six of 12 at home.") == []
    docs = spark.createDataFrame([(1, "a@b.cd and 1.2.3.4", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert [tuple(r) for r in pii.redact(docs).orderBy("doc_id").collect()] == [(1, "<EMAIL> and <IP>", "s"), (2, None, "s")]


# ---- 3


def test_media(spark, odd, empty):
    for n in (0, 1, 63, 64, 65, 4096, 4097, 70_001):
        p = media.padded(bytes(i % 251 for i in range(n)))
        track = media.read(media.write(p))
        assert media.payload(media.write(p), track["offset"], track["size"]) == p
        assert len(p) % 64 == 0 and len(track["keyframes"]) == -(-len(p) // 4096) and track["duration"] == track["ticks"] == len(p)
    for r in media.digest(odd.withColumn("text", F.col("text"))).collect():
        assert r.payload_bytes == max(64, -(-r.n_bytes // 64) * 64)
    want = Counter(hashlib.sha256(media.padded((t or "").encode())).hexdigest() for t in ODD)
    assert Counter(r.payload_sha256 for r in media.digest(odd).collect()) == want
    bad = spark.createDataFrame([(b"\0\0\0\x09junkx",), (None,), (b"",)], "media binary")
    assert [(r.track is None, r.track is not None and r.track.error is not None) for r in media.probe(bad).collect()] == [(False, True), (True, False), (False, True)]
    assert media.digest(empty).count() == 0


# ---- 7


def near_by_force(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_minhash(spark, empty):
    r = random.Random(5)
    base = [[r.choice("abcdefghij") * r.randint(1, 3) + str(r.randint(0, 99)) for _ in range(r.randint(3, 120))] for _ in range(20)]
    docs = []
    for i in range(220):
        words = list(r.choice(base[:3] if i % 2 else base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            words[r.randrange(len(words))] = f"X{r.randint(0, 99)}"
        docs.append((i, " ".join(words) if i % 40 else [None, "", " \n"][i // 40 % 3]))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted(tuple(x) for x in got.collect()) == near_by_force(docs)
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_odd(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {x.component_id for x in got if x.doc_id in (6, 7)} == {6}
    kept = minhash.dedup(odd)
    assert kept.columns == odd.columns and 7 not in {x.doc_id for x in kept.collect()}


def test_dedup_by_row(spark):
    a, b, c = ("one two three four five six " + x for x in ("alpha", "beta gamma delta", "other words at the very end"))
    rows = [(1, a), (1, a), (2, a), (2, b), (None, c), (None, c), (None, a), (3, None), (3, None), (None, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row long")
    left = [tuple(r) for r in minhash.dedup(docs).collect()]
    assert Counter(r[:2] for r in left) == Counter([(1, a), (2, b), (None, c), (3, None), (3, None), (None, "")])
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (None, None, True), (None, None, True), (None, 1, False), (3, 3, True), (3, 3, True), (None, None, True)])
    near = spark.createDataFrame([(1, " ".join(map(str, range(100)))), (2, " ".join(map(str, [*range(98), "x", "y"])))], "doc_id long, text string")
    assert minhash.dedup(near).count() == 1 and minhash.dedup(near, 99).count() == 2


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1400)]
    x, root = roots(*np.array(edges).T)
    want = dict(zip(x.tolist(), root.tolist(), strict=True))
    got = {row.x: row.root for row in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == want and got[1400] == 1000


# ---- 5


def test_topk(spark):
    r = np.random.default_rng(0)
    rows = [(int(i), [float(v) for v in r.choice(centre) + r.normal(0, 0.1, 8)]) for i in range(900) for centre in [np.array([[1.0] * 8, [-1.0] * 8, [0.5] * 8])]]
    rows = [(i, v if i % 97 else rows[0][1]) for i, v in rows] + [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, [1.0] * 8)]
    got = sorted(tuple(x) for x in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect())
    ok = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows[:900]]
    ids, m = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = m @ m[i]
        want += [(int(ids[i]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate([j for j in np.lexsort((ids, -s)) if j != i][:5])]
    assert got == sorted(want)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.search(few).orderBy("rank").collect()] == [(0, 1, 1, 65536), (0, 2, 2, 0)]
    assert topk.search(few.where("false")).count() == 0


# ---- 8


def test_edits(reference):
    r = random.Random(3)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for _ in range(400):
        text = "".join(r.choice("ab c  \n'sl 1.,É") for _ in range(r.choice([0, 1, 5, 40, 2000])))
        made = counts.Planted([text], path)
        chars, tokens = made.chars[0].tolist(), made.tokens[0].tolist()
        for _ in range(3):
            start = r.randint(0, len(text))
            end = min(len(text), start + r.choice([0, 0, 1, 5, 50]))
            new = "".join(r.choice("a b\n'l") for _ in range(r.choice([0, 1, 20])))
            texts = [text]
            made.edit(texts, [chars], [tokens], [[{"start": start, "end": end, "new": new}]])
            text = text[:start] + new + text[end:]
            assert texts == [text]
            assert (chars[1], tokens[1]) == (len(text), len(reference.encode_ordinary(text)))
            for sums in (chars, tokens):
                assert all(sums[i] == sums[2 * i] + sums[2 * i + 1] for i in range(1, len(sums) // 2))


def test_counts(spark, odd, empty, reference):
    edits = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit(1).alias("start"), F.lit(10**6).alias("end"), F.lit(" new").alias("new")), F.lit(None)))
    clash = odd.select("doc_id", "text", F.lit("x").alias("reencoded"), F.lit("y").alias("n_before")).withColumn("edits", edits)
    clash = clash.unionByName(clash)  # repeated rows
    indexed, alone = counts.edit(counts.index(clash)), counts.edit(clash)
    rows = alone.collect()
    key = lambda r: (r.doc_id or -1, r.text, r.n_before, r.reencoded, tuple(r.chars), tuple(r.tokens))
    assert sorted(map(key, rows)) == sorted(map(key, indexed.collect())) and len(rows) == 2 * len(ODD)
    old = Counter(len(reference.encode_ordinary(t or "")) for t in ODD * 2)
    assert Counter(r.n_before for r in rows) == old
    for row in rows:
        assert row.tokens[1] == len(reference.encode_ordinary(row.text))
    assert counts.digest(odd).count() == len(ODD) and counts.digest(empty).count() == 0
    assert counts.edit(counts.index(empty).withColumn("edits", edits)).count() == 0


# ---- 10


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    weights = quality.train(docs.where("false"), labels)
    odd = quality.score(spark.createDataFrame([(t,) for t in ODD], "text string"), weights).collect()
    assert [r.score for r in odd] == [0.5] * len(ODD)


def test_attention_gradient():
    r = np.random.default_rng(2)
    x, count, y = r.normal(size=(40, quality.FEATURES)), np.array([1, 4, 10, 25]), np.array([0.0, 1, 1, 0])
    w = quality.fit(x, count, y)
    assert np.abs(quality.forward(x, count, w)["score"] - y).max() < 0.3
    alone = np.concatenate([quality.forward(part, np.array([len(part)]), w)["score"] for part in np.split(x, np.cumsum(count)[:-1])])
    assert np.allclose(alone, quality.forward(x, count, w)["score"])


# ---- 1


def test_urls(spark):
    cap = [(1, "http://u@A.b.C.com:80/x/y", "2024-03-05"), (2, "https://c.com", "2024-03-05"), (2, "https://c.com", "2024-03-05"), (3, None, "2024-03-05"), (4, "junk", "2024-03-05"), (5, "http://b.c.com/", None), (6, "http://b.c.com/", "2024-02-01")]
    entries = [("bad", "c.com", False, "2024-01-01", True), ("bad", "c.com", False, "2024-03-05", False), ("bad", "b.c.com", False, "2024-02-01", True), ("good", "a.b.c.com/x", True, "2024-03-05", True), ("bad", None, False, "2024-01-01", True), ("bad", "b.c.com", False, "2024-02-01", True)]
    captures = spark.createDataFrame(cap, "page_id long, url string, day string").withColumn("day", F.col("day").cast("date"))
    listed = spark.createDataFrame(entries, "list string, pattern string, allow boolean, day string, added boolean").withColumn("day", F.col("day").cast("date"))
    got = sorted((r.page_id, r.n_active, r.pattern, r.decision) for r in urls.evaluate(captures, listed).collect())
    assert got == [(1, 2, "a.b.c.com/x", "allow"), (2, 0, None, "none"), (2, 0, None, "none"), (3, 0, None, "none"), (4, 0, None, "none"), (5, 0, None, "none"), (6, 2, "b.c.com", "block")]
    assert urls.evaluate(captures, listed.where("false")).count() == len(cap)
    assert urls.evaluate(captures.where("false"), listed).count() == 0


# ---- 2


def viterbi(codes, w):
    v, back = w["start"] + w["emit"][:, codes[0]], []
    for c in codes[1:]:
        s = v[:, None] + w["move"]
        back.append(s.argmax(0))
        v = s.max(0) + w["emit"][:, c]
    best = v.max()
    out = [int(v.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return best, out[::-1]


def path_score(states, codes, w):
    return w["start"][states[0]] + sum(w["emit"][s, c] for s, c in zip(states, codes, strict=True)) + sum(w["move"][a, b] for a, b in zip(states, states[1:], strict=False))


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 7)  # many parts on three levels
    lines = chat.transcripts(spark.read.parquet(f"{DATA}/conversations.parquet"))
    w = chat.fit(lines)
    lines = lines.withColumn("conv_id", F.when(F.col("conv_id") % 3 == 0, 0).otherwise(F.col("conv_id"))).withColumn("turn", F.col("turn") + F.monotonically_increasing_id() * 10)
    rows = lines.select("*", chat.code(F.col("line")).alias("code")).orderBy("conv_id", "turn", "line_no").collect()
    given = spark.createDataFrame([(r.conv_id, r.turn, r.line_no, r.line) for r in rows], "conv_id long, turn long, line_no long, line string").repartition(3)
    got = {(r.conv_id, r.turn, r.line_no): r for r in chat.recover(given, w).collect()}
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append(r)
    for own in by.values():
        codes = [r.code for r in own]
        mine = [got[r.conv_id, r.turn, r.line_no] for r in own]
        states = [2 * chat.ROLES.index(m.role) + (not m.begins) for m in mine]
        states[0] = states[0] if mine[0].begins else states[0]
        best, want = viterbi(codes, w)
        alternatives = [states, [states[0] + 1, *states[1:]]]  # a transcript's first line begins a turn in either state
        assert max(path_score(s, codes, w) for s in alternatives if max(s) < chat.STATES) == best
    assert chat.recover(given.where("false"), w).count() == 0


def test_chat_accuracy(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    truth = chat.transcripts(conversations).where("line_no = 0").select("conv_id", "turn", F.col("role").alias("own"))
    got = chat.digest(conversations).where("line_no = 0").join(truth, ["conv_id", "turn"])
    assert got.where("role = own").count() / got.count() > 0.9


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sf = "/root/testdata/sf0.01"
    first = corpus_pipeline.keep_quality(spark, docs, sf).cache()
    assert first.columns == docs.columns and 0 < first.count() < docs.count()
    second = corpus_pipeline.one_of_near_copies(spark, first, sf).cache()
    want = [r for r in near_by_sets([(r.doc_id, r.text) for r in first.collect()])]
    assert sorted(r.doc_id for r in second.collect()) == want
    third = corpus_pipeline.without_personal_data(spark, second, sf).cache()
    assert third.count() == second.count() and not any(pii.base(r.text) for r in third.collect())
    pieces = corpus_pipeline.packed(spark, third, sf)
    assert pieces.select("doc_id").distinct().count() == third.count()


def near_by_sets(docs):
    """The least id of each component, by an index from shingle to documents."""
    sets = {i: frozenset(minhash.shingles(t).tolist()) for i, t in docs}
    index, both = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            for j in index[x]:
                both[j, i] += 1
            index[x].append(i)
    edges = [(a, b) for (a, b), n in both.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    gone = set(roots(*np.array(edges).T)[0].tolist())
    return sorted(set(sets) - gone)


# ---- odd tables


def test_media_corrupt(spark):
    nested = b""
    for _ in range(3000):
        nested = media.box(b"moov", nested)
    good = media.write(media.padded(b"x" * 5000))
    at = good.index(b"stsz") + 8
    many = good[:at] + b"\0\0\0\x01\xff\xff\xff\xff" + good[at + 8 :]
    at = good.index(b"stsc") + 16
    runs = good[:at] + b"\xff\xff\xff\xff" + good[at + 4 :]
    at = good.index(b"stco") + 12
    away = good[:at] + b"\xff\xff\xff\xff" + good[at + 4 :]
    rows = [(i, m) for i, m in enumerate((nested, many, runs, away, good))]
    got = {r.i: r.track for r in media.probe(spark.createDataFrame(rows, "i long, media binary")).collect()}
    assert all(got[i].error for i in range(4)) and got[4].error is None and got[4].samples == 79


def test_media_two_tracks():
    one = media.write(media.padded(b"a" * 9000))
    moov = one.index(b"moov") - 4
    size = struct.unpack_from(">I", one, moov)[0]
    trak = one.index(b"trak") - 4
    track = one[trak : trak + struct.unpack_from(">I", one, trak)[0]]
    bare = track.replace(b"stss", b"free")  # a track whose samples are all sync samples
    both = struct.pack(">I", size + len(track)) + one[moov + 4 : trak] + bare + track
    made = one[:moov] + both + one[moov + size :]
    assert len(media.read(made)["keyframes"]) == 141 and len(media.read(one)["keyframes"]) == 3


def test_chat_ties(spark):
    w = chat.fit(chat.transcripts(spark.read.parquet(f"{DATA}/conversations.parquet")))
    rows = [(1, 0, 0, "User: b?"), (1, 0, 0, "Assistant: a."), (1, 0, 0, "Assistant: a."), (None, 0, 0, None), (None, 0, 0, "User: x"), (2, None, None, "")]
    given = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, line_no long, line string, role string")
    runs = [sorted(map(str, chat.recover(given.repartition(n), w).collect())) for n in (1, 3, 4)]
    assert len(runs[0]) == len(rows) and runs[0] == runs[1] == runs[2]


def test_pii_merge_is_linear():
    text = "mail a@b.cd or x at example dot com, " * 6000
    began = time.monotonic()
    found = pii.spans(text)
    assert len(found) == 12000 and time.monotonic() - began < 10


@pytest.mark.parametrize("spread", [0.02, 0.6])
def test_topk_many_shards(spark, spread):
    """Brute force over fifty shards, ties across them among the rest; on vectors in clusters most shards are left out."""
    r = np.random.default_rng(8)
    centres = r.normal(0, 0.4, (40, 12))
    v = np.round(centres[r.integers(0, 40, 20_000)] + r.normal(0, spread, (20_000, 12)), 2)
    v[::37] = v[1]  # one vector many times, in more than one shard
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.search(rows, 200, 5, block=50, shard=8, group=30).collect()}
    m = np.floor(256 * v).astype(np.int64)
    for i in range(0, 20_000, 200):
        s = m @ m[i]
        order = [j for j in np.lexsort((np.arange(20_000), -s)) if j != i][:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, s[j]) for j in order]
    assert len(got) == 500


def test_topk_bounds_hold():
    r = np.random.default_rng(2)
    for scale in (3, 1 << 20):
        q, blocks = r.integers(-scale, scale, (30, 8)), [r.integers(-scale, scale, (20, 8)) // (1 + b) for b in range(12)]
        balls = [topk.ball(b) for b in blocks]
        bound = topk.bounds(q, np.stack([b.max(0) for b in blocks]), np.stack([b.min(0) for b in blocks]), np.stack([c for c, _ in balls]), np.array([x for _, x in balls]))
        assert (bound >= np.stack([(q @ b.T).max(1) for b in blocks], 1)).all()


def test_topk_repeated_ids(spark):
    r = np.random.default_rng(4)
    rows = [(int(i) % 40 * 5, [float(x) for x in r.normal(0, 1, 6)]) for i in range(300)]
    got = Counter(tuple(x) for x in topk.search(spark.createDataFrame([(*x, "v") for x in rows], "vec_id long, embedding array<double>, v string").repartition(3)).collect())
    ids, m = np.array([i for i, _ in rows]), np.stack([np.floor(256 * np.array(v)).astype(int) for _, v in rows])
    want = Counter()
    for i in np.flatnonzero(ids % 50 == 0):
        s = m @ m[i]
        want.update((int(ids[i]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate([j for j in np.lexsort((ids, -s)) if j != i][:5]))
    assert got == want


def test_tiles_are_bounded(spark):
    held = spark.range(6000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("row"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("comp"))
    most = minhash.tiled(held, minhash.BLOCK).groupBy("key", "i", "j").count().agg(F.max("count")).first()[0]
    assert most <= 2 * minhash.BLOCK * 1.3


def test_gradient_by_differences():
    r = np.random.default_rng(6)
    x, count, y = r.normal(size=(30, quality.FEATURES)), np.array([2, 8, 20]), np.array([1.0, 0, 1])
    w = quality.fit(x, count, y) | {"c": r.normal(size=quality.CODES), "w": r.normal(size=quality.ATTENTION)}
    g = quality.gradient(x, count, y, w)

    def loss(of):
        s = quality.forward(x, count, of)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name in g:
        for at in list(np.ndindex(w[name].shape))[:12]:
            up, down = ({**w, name: w[name].copy()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - g[name][at]) < 1e-6


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (2, 0, "x"), (None, 1, "x"), (3, None, "x")], "doc_id long, quality int, source string")
    twice = odd.unionByName(odd).withColumn("score", F.lit("own"))
    got = quality.digest(twice, labels).collect()
    assert len(got) == 2 * len(ODD) and len({r.score for r in got}) <= len(set(ODD)) and all(0 <= r.score <= 1 for r in got)
    assert quality.digest(empty, labels).count() == 0 and quality.digest(odd, labels.where("false")).count() == len(ODD)


def test_pipeline_odd(spark, tmp_path):
    import corpus_pipeline

    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = some.unionByName(some.limit(20)).unionByName(some.limit(5).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(some.limit(3).withColumn("text", F.lit(None).cast("string")))
    docs = docs.withColumn("row", F.lit("own")).withColumn("score", F.lit(0.1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, given, str(tmp_path)).collect(), given.schema)
        assert after.columns == docs.columns and 0 < after.count() <= given.count()
        given = after
    texts = [r.text for r in given.collect() if (r.text or "").split()]
    assert len(texts) == len(set(texts))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= given.count()
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
