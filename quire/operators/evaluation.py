"""Checks of answers against evidence, and scores of question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import dollar_amounts, money


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def grounding(rows: DataFrame) -> DataFrame:
    """Adds invalid_refs, unmatched, question_only and review to (question, answer, refs array of strings, evidence).

    References in brackets sort as text; amounts print with two decimals.
    """
    cited = F.array_sort(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1))))
    said, known, asked = (dollar_amounts(F.col(c)) for c in ("answer", "evidence", "question"))
    listed = lambda a: F.array_join(F.transform(F.array_sort(a), money), ";")
    out = rows.withColumns({
        "citations": F.size(cited),
        "invalid_refs": F.array_join(F.array_except(cited, "refs"), ";"),
        "unmatched": listed(F.array_except(said, known)),
        "question_only": listed(F.array_except(F.array_intersect(said, asked), known)),
    })
    return out.withColumn("review", (F.col("invalid_refs") != "") | (F.col("unmatched") != ""))


def grounding_summary(rows: DataFrame, error: Column, refused: Column) -> DataFrame:
    """One row of counters over grounding()'s rows: errors and refusals aren't evaluated."""
    done = ~error & ~refused
    count = lambda c: F.count_if(done & c)
    return rows.agg(
        F.count("*").alias("total"), F.count_if(error).alias("execution_errors"), F.count_if(~error & refused).alias("refusals"), count(F.lit(True)).alias("evaluated"), count(F.col("review")).alias("flagged"),
        count(F.col("invalid_refs") != "").alias("invalid_citations"), count(F.col("unmatched") != "").alias("unmatched_dollar_amounts"), count(F.col("question_only") != "").alias("question_amounts_not_in_evidence"),
    )


def stands(value: Column, quote: Column) -> Column:
    """Whether a constant stands in its quote: plain, with commas, in thousands, or in millions."""
    forms = F.array(value.cast("long").cast("string"), F.format_number(value, 0), F.concat((value / 1000).cast("long").cast("string"), F.lit("K")), F.concat(F.regexp_replace((value / 1e6).cast("string"), r"\.0$", ""), F.lit(" million")))
    return F.exists(forms, lambda f: F.contains(quote, f))


def positions(grades: DataFrame) -> DataFrame:
    """(run, grade, n, positions) of a run's grades (run, place, grade): how many of each, and at which places, ascending. A run is one list of questions."""
    return grades.groupBy("run", "grade").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("place")).alias("positions"))


def pool_recall(questions: DataFrame, hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: recall at 1, 5 and in the pool, mean pool size, and misses. hits: (q_id, rank) of right candidates in the pools, sizes: (q_id, pool)."""
    best = hits.groupBy("q_id").agg(F.min("rank").alias("first"))
    rows = questions.select("q_id").join(best, "q_id", "left").join(sizes, "q_id", "left")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    first = F.col("first")
    return rows.agg(share(first == 1).alias("recall_1"), share(first <= 5).alias("recall_5"), share(first.isNotNull()).alias("recall_pool"), F.round(F.avg(F.coalesce("pool", F.lit(0))), 9).alias("mean_pool"), F.count_if(~F.coalesce(first <= 5, F.lit(False))).alias("missed_5"), F.count_if(first.isNull()).alias("missed_pool"))


def numeric_grade(truth: Column, answer: Column) -> Column:
    """correct, partial or wrong by the share of the truth's numbers of four digits or more that the answer holds; none: correct."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(truth, F.lit(r"(\d[\d,]{3,})"), F.lit(1)), lambda n: F.regexp_replace(n, ",", "")))
    plain = F.regexp_replace(answer, ",", "")
    share = F.try_divide(F.size(F.filter(numbers, lambda n: F.contains(plain, n))), F.size(numbers))
    return F.when(share.isNull() | (share >= 0.8), "correct").when(share >= 0.4, "partial").otherwise("wrong")


def judged(label: Column) -> Column:
    """A judge's reply as a grade: an unclear, empty or failed one is wrong."""
    up = F.upper(F.coalesce(label, F.lit("")))
    return F.when(up.contains("INCORRECT"), "wrong").when(up.contains("PARTIAL"), "partial").when(up.contains("CORRECT"), "correct").otherwise("wrong")


# Fixed patterns of the answer diagnostics.
LEAK = r"(?i)\b(?:wait,? the answer|let me (?:check|recheck|verify|think)|the answer seems contradictory|let me finalize|I should (?:check|reconsider)|the answer is correct\.)"
PLACEHOLDER = r"(?i)\[\s*(?:cite (?:the )?(?:policy )?(?:excerpt|source|document)|insert citation|citation needed)[^\]]*\]"
UNSURE = r"(?i)\b(?:not found in policy|cannot determine|insufficient (?:information|evidence))\b"


def diagnostics(answer: Column) -> Column:
    """Review flags of an answer, in fixed order."""
    text = F.coalesce(answer, F.lit(""))
    marks = F.regexp_count(text, F.lit(PLACEHOLDER))
    return compact(
        F.when(~text.rlike(r"\S"), "empty_answer"),
        F.when(text.rlike(r"^\s*ERROR:"), "error_response"),
        F.when(text.rlike("(?i)</?think>"), "thinking_marker_present"),
        F.when(text.rlike(LEAK), "possible_reasoning_leakage"),
        F.when(marks > 0, "placeholder_citation_present"),
        F.when(marks >= 3, "repeated_placeholder_citations"),
        F.when(~text.rlike(r"\[\d+\]"), "no_numbered_citation"),
        F.when(text.rlike(UNSURE), "uncertainty_or_refusal_phrase"),
        F.when(F.length(text) > 2000, "long_answer_over_2000_chars"),
    )


def histogram(flags: DataFrame) -> DataFrame:
    """(flag, n) of an array column flags."""
    return flags.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def claims(rows: DataFrame) -> DataFrame:
    """Adds problem to claims (text, quotes array of ids, n_quotes): no support, an unknown quote, or a citation mark of the model's own."""
    outside = F.exists("quotes", lambda q: (q < 1) | (q > F.col("n_quotes")))
    kind = F.when(F.size("quotes") == 0, "no support").when(outside, "unknown quote").when(F.col("text").rlike(r"\[\d+\]"), "own citation")
    return rows.withColumn("problem", kind)
