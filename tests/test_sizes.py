"""Steps that are held to a size per task, whatever the tables' size."""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quire import scratch
from quire.functions import text
from quire.operators import engine, mentions, messages, rendering, rules
from quire.operators import questions as qs
from quire.operators import requests as rq
from quire.operators import retrieval as rt
from quire.plans import asked, purchases, records, worded
from quire.plans import layout as layout_plan


def test_pairs_of_a_ranking_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(rt, "PAIRS", 8)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("t"))
    asked = spark.createDataFrame([(q, w, 1) for q in range(4) for w in "ab"], "q_id long, term string, times int")
    counts = rt.frequencies(docs, t=(F.col("t"), asked)).select("doc_id", F.col("t").alias("tf"), F.col("t_len").alias("len"))
    sizes = [r["count"] for r in rt.bm25(counts, asked).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 240 and len(sizes) >= 15 and max(sizes) <= 40


def test_a_long_line_has_few_runs_with_their_places(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(2000))
    spark.createDataFrame([(7, text), (6, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")  # 7 is bold, 6 is not
    rows = layout_plan.runs(spark, str(tmp_path)).orderBy("file", "ordinal").collect()
    assert [len([r for r in rows if r.file == k]) for k in (6, 7)] == [1, 445]
    assert all("".join(r.text for r in rows if r.file == k) == text for k in (6, 7))
    assert all(text[int(r.x0 // 6) : int(r.x1 // 6)] == r.text.strip(" ") for r in rows)
    assert all((r.font == "Serif") == (r.ordinal % 9 == 8) for r in rows if r.file == 7)


def test_texts_meet_only_aliases_whose_beginning_they_have(spark, monkeypatch):
    aliases = spark.createDataFrame([(k, f"common-word{k}") for k in range(50)] + [(90, "a-b-c"), (91, "solo"), (92, "...")], "target long, alias string")
    texts = spark.createDataFrame([("one", "the common word7 is"), ("two", "common thing"), ("abc", "see abc"), ("a_bc", "A, bc!"), ("ab_c", "ab c"), ("cut", "a b d"), ("solo", "Solo"), ("none", None)], "key string, text string")
    want = {"one": [7], "abc": [90], "a_bc": [90], "ab_c": [90], "cut": [90], "solo": [91]}
    for keys in (mentions.KEYS, 1):  # broadcast, and joined by hash
        monkeypatch.setattr(mentions, "KEYS", keys)
        assert {r.key: sorted(a.target for a in r.aliases) for r in mentions.candidates(texts, aliases).collect()} == want
        found = {(r.key, r.target, r.quote) for r in mentions.mentions(texts, aliases).collect()}
        assert found == {("one", 7, "common word7"), ("abc", 90, "abc"), ("a_bc", 90, "A, bc"), ("ab_c", 90, "ab c"), ("solo", 91, "Solo")}


def test_few_aliases_are_one_table_and_texts_stay(spark, monkeypatch):
    aliases = spark.createDataFrame([(k, f"common-word{k}") for k in range(50)] + [(7, "word"), (8, "word"), (3, "..."), (4, None)], "target long, alias string")
    texts = spark.createDataFrame([(1, "a WORD of common word7; common_word8 commonword9, _word word"), (2, None), (3, "common, common word1word2")], "key long, text string")
    want = {(1, 7, 2, 6), (1, 7, 10, 22), (1, 8, 24, 36), (1, 9, 37, 48), (1, 7, 56, 60)}
    found = mentions.mentions(texts, aliases)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {(r.key, r.target, r.start, r.end) for r in found.collect()} == want
    monkeypatch.setattr(mentions, "ALIASES", 5)  # more aliases than one table has
    many = mentions.mentions(texts, aliases)
    assert "Join" in many._jdf.queryExecution().executedPlan().toString() and sorted(many.collect()) == sorted(found.collect())


def test_names_are_compared_letter_by_letter(monkeypatch):
    r, words = random.Random(3), ["a", "b", "ab", "A", "é", "É", "İ", "日", "1", "_", " ", " ", "-", "\n"]
    some = lambda n: "".join(r.choice(words) for _ in range(r.randint(0, n)))
    letters = lambda t: [[c.lower() if len(c.lower()) == 1 else c for c in w] for w in re.findall(r"[^\W_]+", t)]

    def searched(text, aliases):
        spans, own, taken, out = [m.span() for m in re.finditer(r"[^\W_]+", text)], letters(text), set(), []
        for target, alias in sorted(aliases, key=lambda x: (-len(x[1]), *x)):
            parts, free = letters(alias), 0
            cuts = {sum(map(len, parts[: k + 1])) for k in range(len(parts))}
            for i in range(len(own)):
                for j in range(i + 1, len(own) + 1):
                    breaks = {sum(map(len, own[i : k + 1])) for k in range(i, j)}
                    edges = text[: spans[i][0]][-1:] + text[spans[j - 1][1] :][:1]
                    if i >= free and sum(own[i:j], []) == sum(parts, []) and breaks <= cuts and "_" not in edges:
                        free = j
                        if not taken & {*range(i, j)}:
                            taken |= {*range(i, j)}
                            out.append((target, alias, spans[i][0], spans[j - 1][1]))
        return sorted(out)

    for n in range(300):
        monkeypatch.setattr(mentions, "MIX", 0 if n % 3 == 2 else 0xBF58476D1CE4E5B9)  # with 0 all hashes are equal
        monkeypatch.setattr(mentions, "STRETCH", (1, 30, 1 << 18)[n % 3])
        aliases, texts = [(r.randint(1, 4), some(5)) for _ in range(r.randint(0, 9))], [some(30), None, some(30), some(9)]
        rows = [x for b in mentions.automaton_of(aliases).read(pa.array(range(4)), texts) for x in b.to_pylist()]
        assert all(texts[x["key"]][x["start"] : x["end"]] == x["quote"] for x in rows)
        assert [sorted((x["target"], x["alias"], x["start"], x["end"]) for x in rows if x["key"] == k) for k in range(4)] == [searched(t or "", set(aliases)) for t in texts]


def test_names_of_sections_come_from_their_first_words(spark, tmp_path):
    texts = ["aaa bbb ccc ddd eee fff ggg hhh", "é " * 300 + "One Two Three Four Five Six Seven", "x" * 3 + " yy " * 130 + "abc def ghi jkl mno pqr stu", "aaa bbb ccc ddd eee fff", "aaa bbb ccc ddd ddd eee fff ggg", "日" * 390 + " aaa bbb ccc dddddd eee fff ggg"]
    spark.createDataFrame([(7 * k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = records.owned_sections(spark, str(tmp_path))[2]
    assert {(r.alias, r.target) for r in names.collect()} == {("ddd-eee", 0), ("ggg", 0), ("four-five", 7), ("seven", 7), ("ghi-jkl", 14), ("pqr", 14), ("dddddd-eee", 35)}


def test_patterns_are_looked_for_only_in_texts_with_their_stems(spark):
    patterns = {name: p for part in (qs, rq, rules) for name, p in vars(part).items() if name.isupper() and isinstance(p, str) and "(" in p and not name.startswith("CART")}
    patterns |= qs.TOPICS | qs.EXPOSURES | qs.PERMIT_NOTES | dict(rules.COVERED) | dict(rules.ADVISORY) | dict(rq.JUSTIFICATIONS) | {f"exception_{k}": p for k, p in rq.EXCEPTIONS}
    texts = [*purchases.TEXTS, *worded.MORE, *asked.ASKED, *(x.upper() for x in asked.ASKED), "Straße İ K riK level: RISK LEVEL", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = rows.select("i", *(F.coalesce(F.col("t").rlike(f"(?i){p}"), F.lit(False)).alias(k) for k, p in patterns.items()))
    assert sorted(rows.select("i", *(text.said(F.col("t"), p).alias(k) for k, p in patterns.items())).collect()) == sorted(plain.collect())
    assert text.stems(qs.TOPICS["sat"]) == ("simplified acquisition",) and text.stems(r"\bp3\b|a?b+|x*") == () and text.stems(r"\p{L}ab") == ()
    assert sum(bool(text.stems(p)) for p in patterns.values()) > 90


def test_heavy_rows_are_dealt_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch.dealt, "__defaults__", (100,))
    spark.createDataFrame([(k, k, 1000.0 * k, "2-HIGH") for k in range(2000)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for rows in (asked.purchases(spark, str(tmp_path)), worded.decided(spark, str(tmp_path)).withColumn("f", F.input_file_name())):
        by = F.col("f") if "f" in rows.columns else F.spark_partition_id()
        sizes = [r["count"] for r in rows.groupBy(by.alias("p")).count().collect()]
        assert sum(sizes) == 2000 and len(sizes) == 20 and max(sizes) < 200


def test_amounts_next_to_each_other_keep_their_places(spark):
    texts = ("$5k x25k 25k", "a\x01$ 1,200.50 and\x02 $3 million. Liability of $2,000,000? Pay 7K in total $8", "\n$12 é\U0001f600 $13", "none", "", None)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", qs.amounts(F.col("t")).alias("a")).orderBy("i").collect()
    assert [None if r.a is None else [r.t[x.start : x.end] for x in r.a] for r in got] == [["$5k", "25k"], ["$ 1,200.50 ", "$3 million", "$2,000,000", "7K", "$8"], ["$12 ", "$13"], [], [], None]
    assert [(x.reference, x.total) for x in got[1].a] == [(False, False), (False, False), (True, False), (False, False), (False, True)]


def test_messages_of_flags_are_worded_once(spark):
    plan = worded.flag_messages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 1


def test_descriptions_that_requests_share_are_read_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(worded, "sized", lambda df: read.append(df.count()) or scratch.sized(df))
    texts = [*(t + m for t in purchases.TEXTS for m in worded.MORE), "", None]
    rows = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(3 * len(texts))], "request_id long, description string")
    one_by_one = engine.read(rows.withColumn("topics", qs.topics(F.col("description"))))
    got = worded.read_once(rows, rows).select(one_by_one.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, one_by_one.collect())) and read == [len(texts)]
    assert "RLIKE" not in worded.determined(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_a_header_words_only_the_flags_that_it_names(spark):
    assert "zip_with(" not in worded.answer_headers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    forbidden = F.filter("flag_texts", lambda f: f["severity"].isin("block", "require") & f["code"].isin(*messages.PROHIBITIONS))
    rows = rendering.answer_line(rendering.worded(worded.decided(spark, "/root/testdata/sf0.001"))).select("header", F.transform(forbidden, lambda f: f["message"]).alias("m")).collect()
    assert all(r.header.startswith(" ".join([messages.MESSAGES["line:before"].strip(), *r.m])) for r in rows if r.m) and len({m for r in rows for m in r.m}) > 100


def test_an_answer_makes_only_what_it_says(spark):
    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = worded.rule_answers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", fields)
    # two tables are read, orders and descriptions, and none of determinations; no flag but the prohibitions' is made; replies are taken apart in a column of their own
    assert plan.count("] parquet") == 2 and "flags#" in plan and "category_flags#" not in plan and "COVERED_SERVICE" not in plan and plan.count("Conditions\\**") <= 3


def test_replies_are_cut_at_their_first_marks(spark):
    texts = (
        *worded.REPLIES, *asked.REPLIES, "Conditions: a\nConditions: b\nSource: c", "\n \n**Conditions** : \n\n x\u2028y\nRule: z", "Rule: r\nAnswer: n", "Answer: a\r\nSources: s\r\nConditions:\r\n- one\r\n- two",
        "no conditions: here", "a\nrules : b\nCONDITIONS:c\n**Source**: d\nmore", "Answer: x Rule: y", "\\$1 \\ $2\nConditions: $3", "Conditions:",
    )
    stop, mark = r"(?im)^\s*\**(?:Rule|Source)s?\**\s*:", r"(?im)^\s*\**Conditions\**\s*:\s*"
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    cut = lambda c, p: F.split(c, p, 2)
    answer = F.regexp_replace(F.trim(cut(cut(F.col("t"), mark)[0], stop)[0]), r"(?i)^\s*\**Answer\**\s*:\s*", "")
    rest = F.trim(F.regexp_replace(cut(F.coalesce(F.get(cut(F.col("t"), mark), F.lit(1)), F.lit("")), stop)[0], r"^\s+|\s+$", ""))
    want = rows.select("i", F.trim(F.regexp_replace(answer, r"\s+", " ")).alias("answer"), F.when(rest == "", "None").otherwise(rest).alias("conditions"))
    assert sorted(rows.select("i", qs.reply_parts(F.col("t")).alias("p")).select("i", "p.*").collect()) == sorted(want.collect())


def test_split_orders_without_lambdas(spark):
    amounts = (None, 0.0, 10_000.0, 49_999.99, 50_000.0, 99_999.99, 100_000.0, float("nan"))
    related = (None, [], [None], [5_000.0], [40_000.0, 30_000.0], [90_000.0, None], [100_000.0], [float("nan")])
    cases = [(a, r, f, w, s) for a in amounts for r in related for f in (True, False, None) for w in ("contract", None) for s in (True, None)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, amount double, related array<double>, federal_rules boolean, award string, split_intent boolean")
    orders = F.concat(F.array("amount"), F.coalesce("related", F.array().cast("array<double>")))
    total = F.aggregate(orders, F.lit(0.0), lambda a, x: a + x)
    form = F.when(~F.col("federal_rules"), rules.FORM_OTHER).when(F.col("award") == "contract", rules.FORM_CONTRACT).otherwise(rules.FORM_GRANT)
    under = lambda limit: (F.size(orders) >= 2) & F.forall(orders, lambda x: x < limit) & (total >= limit)
    found = rules.compact(F.when(under(F.lit(rules.BID)), "competitive_bid"), F.when((form != rules.BID) & under(form), "form"))
    want = rows.select("i", F.when(F.size(found) > 0, found).when(F.coalesce("split_intent", F.lit(False)), F.array(F.lit("intent"))).otherwise(found).alias("f")).orderBy("i").collect()
    out = rules.split_orders(rows)
    assert [r.split_flags for r in out.orderBy("i").collect()] == [r.f for r in want] and {len(r.f) for r in want} == {0, 1, 2}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction") <= 2  # the total's own
