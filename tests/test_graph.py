"""Operators of the evidence graph against brute force."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from quire.operators import graph as gr
from quire.operators import retrieval as rt
from quire.operators import sections as se
from quire.operators import structure as st
from quire.plans import records

DATA = "/root/testdata/sf0.001"


def places(texts, aliases):
    """All places by a scan of every alias over every text, the longest alias first."""
    out = set()
    pattern = lambda a: re.compile(r"(?<!\w)" + r"[\W_]*".join(re.findall(r"[A-Za-z0-9]+", a)) + r"(?!\w)", re.I)
    ordered = sorted(aliases, key=lambda x: (-len(x[1]), *x))
    for doc, text in texts:
        taken = []
        for target, alias in ordered:
            for m in pattern(alias).finditer(text):
                if any(m.start() < e and m.end() > s for s, e in taken):
                    continue
                taken.append(m.span())
                if target != doc:
                    out.add((doc, target, alias, m.start() + 1))
    return out


def places_of_words(texts, aliases):
    """places() for aliases with any letters."""
    out = set()
    for doc, text in texts:
        taken = []
        for target, alias in sorted(aliases, key=lambda x: (-len(x[1]), *x)):
            pattern = re.compile(r"(?<!\w)" + r"[\W_]*".join(re.findall(r"[^\W_]+", alias)) + r"(?!\w)", re.I)
            for m in pattern.finditer(text):
                if not any(m.start() < e and m.end() > s for s, e in taken):
                    taken.append(m.span())
                    if target != doc:
                        out.add((doc, target, alias, m.start() + 1))
    return out


def test_alias_places(spark):
    aliases = [(1, "BUS-43"), (2, "BUS 43 Annex"), (3, "Annex"), (4, "travel policy"), (5, "policy"), (6, "(A.1)")]
    texts = [
        (1, "BUS-43 annex, then annex; bus43. BUS-430, _annex"),
        (2, "BUS43 Annex and BUS 43annex and BUS--43"),
        (4, "the Travel   Policy is a policy; TRAVEL_POLICY"),
        (7, "policy travel policy policy"),
        (8, "see a1, A 1, (a.1) and a.12"),
        (9, ""),
    ]
    t, a = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(aliases, "target long, alias string")
    want = places(texts, aliases)
    assert len(want) == 10
    assert {tuple(r) for r in gr.alias_references(t, a).collect()} == want


def test_alias_places_at_random(spark):
    r = random.Random(8)
    word = lambda: r.choice(["a", "b", "ab", "ba", "aa", "É", "é1", "1"])
    aliases = [(k, r.choice("- _").join(word() for _ in range(r.randint(1, 3)))) for k in range(40)]
    aliases = sorted({a: (k, a) for k, a in reversed(aliases)}.values())
    texts = [(100 + i % 3 if i % 3 else i % 40, "".join(word().upper() if r.random() < 0.3 else word() + r.choice(["", " ", " ", ", ", "_", "--"]) for _ in range(r.randint(0, 25)))) for i in range(300)]
    texts = [(i, t) for i, (_, t) in enumerate(texts)]
    got = gr.alias_references(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(aliases, "target long, alias string"))
    pattern = [(k, a) for k, a in aliases]
    assert {tuple(x) for x in got.collect()} == places_of_words(texts, pattern)


def test_long_text_once(spark):
    from quire.operators import mentions as mn

    machine = mn.automaton_of([(k, f"name {k}") for k in range(5000)])
    text = " ".join(f"name {k % 9000}" for k in range(100_000))
    began = time.monotonic()
    assert len(mn.found_in(text, machine)) > 50_000 and time.monotonic() - began < 10


def test_reference_edges_search_all_parts(spark):
    rows = [(r.p_partkey, f"{r.p_name} of {r.p_brand}, {r.p_type}", r.p_brand, r.p_type) for r in spark.read.parquet(f"{DATA}/part.parquet").collect()]
    first = {}
    for key, _, *names in rows:
        for kind, n in enumerate(names):
            first[kind, n] = min(key, first.get((kind, n), key))
    want = places([r[:2] for r in rows], [(key, n) for (_, n), key in first.items()])
    found = [tuple(r) for r in records.reference_edges(spark, DATA).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert len({x[0] for x in found}) > len(rows) / 2


def test_levels_without_bound(spark):
    chain = [(0, None)] + [(i, i - 1) for i in range(1, 45)]
    cycle = [(100, 102), (101, 100), (102, 101), (103, 102), (104, 104), (105, 103)]
    rows = chain + cycle + [(200, 999), (201, 200), (300, None), (301, 0)]
    got = dict(map(tuple, gr.levels(spark.createDataFrame(rows, "node long, parent long")).collect()))
    assert got == {i: i for i in range(45)} | dict.fromkeys([*range(100, 106), 200, 201]) | {300: 0, 301: 1}
    assert gr.levels(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_promoted_without_bound(spark):
    says = "The purchase limit applies to every department that orders goods."

    def line(first, n, top, text=says):
        """A chain of n sections without content below one with a title and a text."""
        return [(first, None, top, text, "body")] + [(i, i - 1, "ABC", "ABC", "body") for i in range(first + 1, first + n)]

    rows = line(0, 40, "ABC") + line(100, 40, "Revision history") + line(200, 40, "ABC", says * 300)
    rows += [(300, 301, "ABC", "ABC", "body"), (301, 300, "ABC", says, "body"), (302, 302, "ABC", "ABC", "body"), (303, 999, "ABC", "ABC", "body")]
    got = dict(map(tuple, se.promoted(spark.createDataFrame(rows, "section long, parent long, title string, text string, kind string")).collect()))
    want = dict.fromkeys(range(40), 0) | dict.fromkeys(range(100, 140)) | {200: 200} | dict.fromkeys(range(201, 240)) | {300: 301, 301: 301, 302: None, 303: None}
    assert got == want


def test_walk_of_many_hops(spark):
    edges = [(str(i), str(i + 1), "references") for i in range(12)] + [("0", "9", "overrides"), ("3", "0", "contains")]
    e = spark.createDataFrame(edges, "source string, target string, relation string")
    starts = spark.createDataFrame([("0",), ("absent",)], "node string")
    seen = gr.walk(starts, e, 10)
    assert {tuple(r) for r in seen.collect()} == {("0", str(i), i) for i in range(11)} | {("absent", "absent", 0)}
    assert {(r.source, r.target) for r in gr.walked_edges(seen, e, 10).collect()} == {x[:2] for x in edges[:10]} | {("3", "0")}
    assert gr.walk(starts, e, 0).count() == 2


def test_ranges_of_all_levels(spark):
    import random

    r = random.Random(3)
    heads = [(d, s, r.randint(1, 9)) for d in range(6) for s in sorted(r.sample(range(60), 15))]
    ends = spark.createDataFrame([(d, 60) for d in range(7)], "doc_id long, end int")
    ranges = st.section_ranges(spark.createDataFrame(heads, "doc_id long, start int, level int"), ends)
    by = {}
    for d, s, n in heads:
        by[d, s] = (n, min((t for e, t, m in heads if e == d and t > s and m <= n), default=60))
    assert {(x.doc_id, x.start): (x.level, x.end) for x in ranges.collect()} == by
    for x in st.parents(ranges).collect():
        around = [(m, -t) for (d, t), (m, e) in by.items() if d == x.doc_id and t <= x.start and e >= x.end and m < x.level]
        assert x.parent == (-max(around)[1] if around else None)
    for x in st.owners(ranges, ends).collect():
        inside = [(m, t) for (d, t), (m, e) in by.items() if d == x.doc_id and t <= x.a and e >= x.b]
        assert x.owner == (max(inside)[1] if inside else None)


def test_named_sources_take_the_longest(spark):
    aliases = [(1, "Travel Policy"), (2, "Travel"), (3, "BUS-43"), (4, "Policy on Gifts"), (5, "abc")]
    asked = [(1, "What does the travel policy on gifts say?"), (2, "bus 43 or travel, travel policy"), (3, "abc none"), (4, "Policy on gifts; BUS-43!")]
    got = se.named_sources(spark.createDataFrame(asked, "q_id long, question string"), spark.createDataFrame(aliases, "target long, alias string"))
    assert {r.q_id: r.targets for r in got.collect()} == {1: [2, 4], 2: [1, 2, 3], 4: [3, 4]}


def test_passages_by_a_loop(spark):
    import random

    r = random.Random(8)
    ranked = [(q, k, q * 100 + k, r.choice([0, 100, 600, 7000, 12_000, 30_000])) for q in range(40) for k in range(1, 9)]
    got = {x.q_id: ([(p.doc_id, p.taken) for p in x.picks], x.used) for x in rt.passages(spark.createDataFrame(ranked, "q_id long, rank long, doc_id long, n_chars long")).collect()}
    for q in range(40):
        picks, used = [], 0
        for _, _, doc, n in ranked[q * 8 : q * 8 + 8]:
            taken = min(n, 12_000, 24_000 - used)
            if len(picks) < 4 and 24_000 - used >= 500 and taken > 0:
                picks.append((doc, taken))
                used += taken
        assert got[q] == (picks, used)


def test_nearest_leaves_clusters_out(spark):
    r = np.random.default_rng(4)
    means = r.normal(size=(20, 16))
    m = np.round(means[np.arange(1500) % 20] + 0.05 * r.normal(size=(1500, 16)), 3)
    m[900:1000] = m[900]  # copies
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "doc_id long, v array<double>").repartition(3)
    asked = rows.where("doc_id % 25 = 0").withColumnRenamed("doc_id", "q_id")
    got = {(x.q_id, x.rank): (x.doc_id, x.score) for x in rt.nearest(rows, asked, 5, block=64).collect()}
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    kth = {}
    for q in range(0, 1500, 25):
        s = np.round(unit @ unit[q], 9)
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, s[i]) for i in order]
        kth[q] = s[order[-1]]
    assert len(got) == 5 * len(kth)
    centres = unit[:40]
    apart = rt.angles(unit, centres)
    own = apart.argmin(1)
    sizes, radii = np.bincount(own, minlength=40), np.array([apart[own == c, c].max(initial=0) for c in range(40)])
    pairs = rt.bounds(rt.units(asked, "q_id"), 16, centres, sizes, radii, 5, -1.0).collect()
    assert sum(x.bound >= kth[x.q_id] for x in pairs) < 0.2 * 40 * len(kth)


def test_terms_by_join(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["b", "a", "b", "x"]), (2, []), (3, ["x", "it's", "\\"]), (4, None)], "doc_id long, t array<string>")
    asked = spark.createDataFrame([(0, "a", 1), (0, "b", 1), (1, "it's", 2), (1, "\\", 1), (2, "none", 1)], "q_id long, term string, times int")
    want = {1: ([("a", 1), ("b", 2)], 4), 2: ([], 0), 3: ([("\\", 1), ("it's", 1)], 3), 4: ([], None)}
    for most in (rt.TERMS, 0):
        monkeypatch.setattr(rt, "TERMS", most)
        got = rt.frequencies(docs, w=(F.col("t"), asked)).collect()
        assert {r.doc_id: ([tuple(x) for x in r.w], r.w_len) for r in got} == want


def test_nearest_by_force(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(300, 5)).round(1)
    m[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "doc_id long, v array<double>").repartition(3)
    got = {(x.q_id, x.rank): x.doc_id for x in rt.nearest(rows, rows.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "q_id"), 5, block=64).collect()}
    for q in range(0, 300, 20):
        with np.errstate(invalid="ignore"):
            s = np.round(m @ m[q] / np.linalg.norm(m, axis=1) / np.linalg.norm(m[q]), 12)
        order = [i for i in np.lexsort((np.arange(300), -np.nan_to_num(s, nan=-9))) if i not in (q, 7)][:5]
        assert [got[q, k + 1] for k in range(5)] == order
    assert len(got) == 75
