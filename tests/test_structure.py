"""Cutting texts at lines that open a section, against a plain search for their starts."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from quire.operators import structure as st
from quire.plans import corpus
from quire.queries import oracle_sql

CAPITALS = re.compile(r"(?m)^[ \t]*[A-Z][A-Z\s]{4,}:?\s*$")
OPENING = re.compile(
    r"(?mi)^[ \t]*(Part\s+\d+|[IVXLCDM]{1,6}\.|[A-Z]\.\s|\d{1,2}\.\s|[a-z]\)\s|\(\d+\)\s|SECTION|DEFINITION|POLICY|PROCEDURE|BACKGROUND|PURPOSE|SCOPE|RESPONSIBILITIES|COMPLIANCE|REFERENCE|APPENDIX|EXHIBIT)"
)


def cut(text):
    starts = {m.start() for p in (CAPITALS, OPENING) for m in p.finditer(text)}
    if not starts:
        return [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    borders = sorted({0, *starts, len(text)})
    return [p for p in (text[a:b].strip() for a, b in zip(borders, borders[1:], strict=False)) if len(p) > 20]


def test_pieces(spark):
    r = random.Random(7)
    words = ["a plain line of words", "\n", "\n\n", " \n\t\n", "  IV. Scope", "1. ", "b) ", "(2) of", "PURCHASING RULES:", "ALL CAPS\nAND MORE", "Policyholder", "part 3", "Part\n4. x", "", "x" * 30]
    texts = ["", "   ", "one\n\ntwo\n \n\nthree", "ABCDEF", "1.\n2. x" + "y" * 30, *("\n".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(300))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", st.pieces_by_marker(F.col("t")).alias("p")).collect()
    for row in got:
        assert row.p == cut(texts[row.i]), texts[row.i]
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(F.size(F.coalesce(st.pieces_by_marker(F.col("t")), F.array().cast("array<string>"))).alias("n")).first().n == 0


def test_intervals_without_a_start(spark):
    rows = [(1, 5, 15), (1, None, None), (1, None, None), (1, 12, 22), (1, 40, 50), (1, 5, 15), (1, 50, 60), (2, None, None), (2, None, None), (None, 1, 11), (None, None, None), (3, 7, 17)]
    got = st.union_intervals(spark.createDataFrame(rows, "key long, start int, end int").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 5, 22), (1, 40, 60), (2, None, None), (2, None, None), (None, 1, 11), (3, 7, 17)]))


def test_orders_without_a_date_as_in_sql(spark, tmp_path):
    days = ["1995-01-01", None, "1995-01-08", "1996-01-08", None, "1980-01-05 23:59:59", None]
    rows = spark.createDataFrame([(k, (1, 1, 1, 1, 2, 3, None)[k], d) for k, d in enumerate(days)], "o_orderkey long, o_custkey long, d string")
    rows.select("o_orderkey", "o_custkey", F.col("d").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    sql = oracle_sql()["merged_ranges"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = corpus.merged_ranges(spark, str(tmp_path)).select("key", "start", "end").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duckdb.sql(sql).fetchall())) and len(got) == 5
