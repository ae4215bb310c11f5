"""A training corpus from documents: good ones, one of each group of near copies, without personal data, packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. run() applies them with a written table between them.

A stage passes texts to Python in batches of BATCH bytes, which it sets in the session: an executor holds several batches
outside of its heap, for as many tasks as run at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import minhash, packing, pii, quality
from quire.llm.common import saved, table

#: Bytes of a batch.
BATCH = "8m"


def modest(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.3."""
    modest(spark)
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    score = "quality_score" + "_" * max(map(len, docs.columns))  # no column of docs has this name
    return quality.score(docs, weights, out=score).where(f"{score} >= 0.3").select(*(f"`{c}`" for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of near copies."""
    modest(spark)
    return minhash.dedup(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    modest(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    modest(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", one_of_near_copies),
    ("PII", without_personal_data),
    ("packing", packed),
]

#: Trained weights, verified links and tokenizer ids are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
