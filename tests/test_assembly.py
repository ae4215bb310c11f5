"""Quotes, claims, passages and hops against plain loops."""

import math
import random
import re

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import assembly as am
from quire.plans import assembly as plans

DATA = "/root/testdata/sf0.001"


def test_quotes(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(["ab", " ", "\n", "\n\n", "c. "]) for _ in range(r.randint(0, 30))), sorted(r.sample(range(60), 3))) for i in range(60)]
    got = spark.createDataFrame(rows, "i int, t string, b array<int>").select("i", am.quote_spans(F.col("t"), F.col("b")).alias("s"))
    for x in got.collect():
        text, borders = rows[x.i][1:]
        cuts = sorted({0, len(text), *(b for b in borders if 0 < b < len(text)), *(m.end() for m in re.finditer(r"\n\s*\n", text))})
        want = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            s = text[a:b]
            if s.strip():
                a += len(s) - len(s.lstrip())
                want.append((len(want) + 1, a, a + len(s.strip()), s.strip()))
        assert [tuple(s) for s in x.s] == want


def test_located(spark):
    text = "Intro. The “bid” limit—as of\n now—is $100,000 (or more); see A.1 [x]."
    asked = ['The "bid" limit-as of now-is', "limit—as of now—is $100,000 (or more);", "too short", "is not in this text at all", "$100,000 (or more); see A.1 [x]."]
    got = spark.createDataFrame([(i, q, text) for i, q in enumerate(asked)], "i int, q string, t string").select("i", am.located(F.col("q"), F.col("t")).alias("p")).orderBy("i").collect()
    assert [text[p.start : p.end] if p else None for p in (x.p for x in got)] == ["The “bid” limit—as of\n now—is", "limit—as of\n now—is $100,000 (or more);", None, None, "$100,000 (or more); see A.1 [x]."]


def test_claims(spark):
    passages = [(1, 1, "Bids are needed at $100,000 or more.\n\nBUS-43 says so on page 9.", []), (1, 2, "A second source of some length.", [])]
    support = "array<struct<source_id:int,quote_id:int,quote:string>>"
    claims = [
        (1, 1, "A bid is needed at 100,000.", [(1, 1, None)]), (1, 2, "Both say so, BUS 43 too.", [(2, None, "second source of  some"), (1, 2, None)]), (1, 3, "It is 250,000.", [(1, 1, None)]),
        (1, 4, "So [1].", [(1, 1, None)]), (1, 5, " ", [(1, 1, None)]), (1, 6, "x", [(3, 1, None)]), (1, 7, "x", [(1, 3, None)]), (1, 8, "x", [(2, None, "nothing of this kind is here")]), (1, 9, "x", []),
    ]
    got = am.verified(spark.createDataFrame(claims, f"q_id int, claim int, text string, support {support}"), spark.createDataFrame(passages, "q_id int, source_id int, text string, borders array<int>"))
    got = {r.claim: r for r in got.collect()}
    assert [got[k].problem for k in range(1, 10)] == [None, None, "number without evidence", "own citation", "blank", "unknown source", "unknown part", "absent quote", "no support"]
    assert got[2].line == "Both say so, BUS 43 too. [1] [2]" and got[2].quotes == ["second source of some", "BUS-43 says so on page 9."]


def by_loop(question, ranked, edges, sections):
    """The passages of one question, section by section, as plain strings."""
    picks, used = [], 0

    def add(section, start, end, edge):
        nonlocal used
        doc, _, _, text = sections[section]
        left = 24_000 - used
        if len(picks) >= (4 if edge is None else 6) or section in [p[0] for p in picks] or left < 500:
            return False
        if any(sections[p[0]][0] == doc and (text in p[4] or p[4] in text) for p in picks):
            return False
        limit, a, b = min(12_000, left), 0, len(text)
        if b > limit:
            a = max(0, (start + end) // 2 - limit // 2)
            b = min(len(text), a + limit)
            if (gap := text.find("\n\n", a, start)) >= 0:
                a = gap + 2
            if (gap := text.rfind("\n\n", end, b)) >= end:
                b = gap
        if end - start > b - a:
            return False
        picks.append((section, a, b, edge, text[a:b]))
        used += b - a
        return True

    for section in ranked:
        add(section, *sections[section][1:3], None)
    hops = 0
    for section, _, _, _, passage in list(picks):
        for edge, source, target, only, label, quote in sorted(edges):
            if hops == 2 or len(picks) == 6 or source != section or quote not in passage or target == sections[section][0] or edge in [p[3] for p in picks]:
                continue
            own = [i for i in sorted(sections) if sections[i][0] == target and only in (None, i)]
            tokens = {i: [w for w in re.findall("[a-z0-9]+", sections[i][3].lower()) if w not in tx.STOPWORDS] for i in own}
            asked = {w for w in re.findall("[a-z0-9]+", f"{question} {label}".lower()) if w not in tx.STOPWORDS}
            asked |= {x for w in asked for x in tx.EXPANSIONS.get(w, "").split()}
            average = max(sum(map(len, tokens.values())) / max(len(own), 1), 1)
            score = {i: 0.0 for i in own}
            for w in asked:
                df = sum(w in t for t in tokens.values())
                for i, t in tokens.items():
                    if f := t.count(w):
                        score[i] += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / average))
            for i in sorted((i for i in own if score[i] > 0), key=lambda i: (-round(score[i], 9), i))[:30]:
                if add(i, *sections[i][1:3], edge):
                    hops += 1
                    break
    return [p[:4] for p in picks], used


def test_assembled_at_random(spark):
    r = random.Random(12)
    words = "alpha beta gamma delta bid quote vendor limit rule".split()
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", ". ", "\n\n"]) for _ in range(n))
    sections = {}
    for i in range(60):
        body = text(r.choice([8, 40, 300, 2500]))
        if i % 9 == 8:
            body = sections[i - 1][3][: len(body)]  # within its neighbour's text
        start = r.randrange(len(body) - 5)
        sections[i] = (i // 3, start, min(len(body), start + r.choice([5, 300])), body)
    edges = [(e, s, r.randrange(20), r.choice([None, r.randrange(60)]), text(2), sections[s][3][5:15] if r.random() < 0.8 else "nowhere") for e, s in enumerate(r.choices(range(60), k=150))]
    edges = [(e, s, d, o if o is None or o // 3 == d else 3 * d, *x) for e, s, d, o, *x in edges]
    questions = {q: text(5) for q in range(25)}
    ranked = {q: r.sample(range(60), 10) for q in questions}
    rows = [(q, k, i, sections[i][0], *sections[i][1:]) for q, own in ranked.items() for k, i in enumerate(own, start=1)]
    got = am.assembled(
        spark.createDataFrame(rows, "q_id int, rank int, section long, doc_id long, start int, end int, text string"), spark.createDataFrame(edges, "edge long, source long, target_doc long, target_section long, label string, quote string"),
        spark.createDataFrame([(i, *x) for i, x in sections.items()], "section long, doc_id long, start int, end int, text string"), spark.createDataFrame(list(questions.items()), "q_id int, question string"),
    )
    found = {x.q_id: ([(p.section, p.a, p.b, p.edge) for p in x.picks], x.used) for x in got.collect()}
    want = {q: by_loop(questions[q], ranked[q], edges, sections) for q in questions}
    assert found == want
    assert sum(p[3] is not None for picks, _ in want.values() for p in picks) > 20


def test_passages_with_hop(spark):
    ranked, edges, sections, questions = (x.collect() for x in plans.hop_inputs(spark, DATA))
    own = {s.section: (s.doc_id, s.start, s.end, s.text) for s in sections}
    lists = {}
    for x in sorted(ranked, key=lambda x: x["rank"]):
        lists.setdefault(x.q_id, []).append(x.section)
    asked = {q.q_id: q.question for q in questions}
    refs = [tuple(e) for e in edges]
    got = {x.q_id: (x.picks, x.used) for x in plans.passages_with_hop(spark, DATA).collect()}
    for q, own_list in lists.items():
        picks, used = by_loop(asked[q], own_list, [e for e in refs], own)
        assert got[q] == (",".join(f"{s}:{a}:{b}:{'' if e is None else e}" for s, a, b, e in picks), used)
    assert len(got) == len(lists)


def test_rewritten(spark):
    rows = [("  a  b ", "m", "q"), (" ", "m\nn", "q"), (None, "", "q"), (None, None, " ")]
    got = spark.createDataFrame(rows, "t string, m string, q string").select(am.rewritten(F.col("t"), F.col("m"), F.col("q")).alias("r"))
    assert [x.r for x in got.collect()] == ["a b", "m n", "q", None]
