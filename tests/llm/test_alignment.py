"""Alignment against plain loops over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  two  spaces ", "\n\n", "a" * 3000, "the cat sat on the mat.", "the cat sat on the mat.", "ﬁ İ Σς 🙂 <|endoftext|> </s> <unk> <0x41>", "under▁score", "▁",
    "don't 'll 42  7\t\r\n", "“quotes” — dash", "中文字符 и ещё", "x\x00y \x1c\x1d\u0085 z", "﻿bom", "é   nbsp",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def unmarked(token):
    """Bytes of a byte-level entry, by the rule of its alphabet."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return bytes(ord(c) if ord(c) in plain else others[ord(c) - 256] for c in token)


def spans(strings):
    at = 0
    for s in strings:
        yield at, at + len(s)
        at += len(s)


def by_loops(texts, libraries):
    """The rows that the operator should give, from every pair of tokens of each text."""
    a, b = libraries
    docs = []
    for t in texts:
        whole = (" " + (t or "")).encode()
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [unmarked(a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.IdToPiece(i)[3:5], 16)]) if b.IsByte(i) else b.IdToPiece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append(None)
            continue
        at_a, at_b = list(spans(bytes_a)), list(spans(bytes_b))
        links = [(i, j) for i, (s, e) in zip(ids_a, at_a, strict=True) for j, (u, v) in zip(ids_b, at_b, strict=True) if s < v and u < e] if len(t) < 500 else []
        ends = sorted({e for _, e in at_a} & {e for _, e in at_b})
        if len(t) >= 500:  # by the number of cuts, for texts too long for all pairs
            cuts = sorted({e for _, e in at_a} | {e for _, e in at_b})
            links = [(next(i for i, x in zip(ids_a, at_a, strict=True) if x[0] < c <= x[1]), next(j for j, x in zip(ids_b, at_b, strict=True) if x[0] < c <= x[1])) for c in cuts]
        groups = []
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            own = [",".join(str(i) for i, (_, e) in zip(ids, at, strict=True) if lo < e <= hi) for ids, at in ((ids_a, at_a), (ids_b, at_b))]
            groups.append("|".join(own))
        docs.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for d in docs if d for x in d[3])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(count[x] == best[x[1]] for x in d[3]), sum(count[x] for x in d[3]), d[4]) for d in docs]


def rows_of(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("held", [alignment.HELD, 8])
def test_alignment(spark, libraries, held):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("abc dEé,.\n 12the ing中") for _ in range(r.randint(0, 60))) for _ in range(150)]
    ids = [i if i % 7 else None for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, a string, n_a int").repartition(5)
    want = sorted((i is not None, i or 0, *row) for i, row in zip(ids, by_loops(texts, libraries), strict=True))
    assert rows_of(alignment.aligned(docs, held=held)) == want
    assert sum(row[2] > 0 for row in want) > 120 and any(row[2] == 0 for row in want)


def test_repeated_rows_and_empty(spark, libraries):
    docs = spark.createDataFrame([(3, "the cat"), (3, "the cat"), (4, "the cats")], "doc_id long, text string")
    want = by_loops(["the cat", "the cat", "the cats"], libraries)
    assert rows_of(alignment.digest(docs)) == sorted((True, i, *row) for i, row in zip([3, 3, 4], want, strict=True))
    assert alignment.digest(docs.where("false")).count() == 0
    assert rows_of(alignment.digest(docs.withColumn("text", F.lit(None).cast("string"))))[0] == (True, 3, 0, 0, 0, 0, 0, 0, "")


def test_same_ids_as_the_library(spark, libraries):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    r = random.Random(2)
    texts += ["".join(chr(r.choice((r.randint(32, 127), r.randint(1, 0x2FFF), r.randint(0x10000, 0x1FFFF)))) for _ in range(40)) for _ in range(400)]
    encoder, names = alignment.byte_level(A)
    for t in texts:
        assert encoder.encode_ordinary(" " + t) == libraries[0].encode(" " + t, add_special_tokens=False).ids
    assert all(names[i] == unmarked(libraries[0].id_to_token(i)) for i in range(0, 50_256, 97))


def test_shards_are_sorted_and_looked_up(spark, tmp_path):
    n = 5000
    keys = spark.range(n).selectExpr("id * 7 as key", "id % 13 + 1 as n")
    three = keys.unionByName(keys).unionByName(keys)
    folder = f"file://{tmp_path}/shards"
    rows = three.repartitionByRange(6, "key").sortWithinPartitions("key").mapInArrow(alignment.sharded(folder), "name string, first long, n long, b binary, most binary").collect()
    shards = sorted(((r.name, r.first, r.n) for r in rows), key=lambda r: r[1])
    assert len(shards) > 1 and sum(s[2] for s in shards) == n
    asked = np.arange(0, n, 3) * 7
    assert (alignment.lookup(asked, folder, shards) == 3 * (np.arange(0, n, 3) % 13 + 1)).all()
    assert all(type(alignment.mapped(folder, f"{name}.keys", size)) is np.memmap for name, _, size in shards)
