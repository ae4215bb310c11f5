"""Published tables: each generation is a partition of its tables, and a small table of publications names the active one.

A generation is written and checked before its publication is appended, so that a failure leaves the old one in place.
A refused or previewed generation is a partition that no publication names. Only Spark's readers and writers are used.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quire.scratch import saved

VERSION = 1
PUBLICATIONS = "schema_version int, generation string, tables array<string>, published timestamp"


def partition(root: str, table: str, generation: str) -> str:
    return f"{root}/{table}/generation={generation}"


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with gapless numbers from 0 in an order, each row's partition and place added up; ties by nothing else, so order should be unique.

    Rows are range-sorted and written; only a count for each partition meets in one place.
    """
    at, row = name + "_part", name + "_row"
    rows = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({at: F.spark_partition_id(), row: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = rows.groupBy(at).agg(F.count("*").alias("n"))  # a row for each partition
    base = sizes.select(at, (F.sum("n").over(Window.orderBy(at)) - F.col("n")).alias(name + "_base"))
    return rows.join(F.broadcast(base), at).withColumn(name, F.col(name + "_base") + F.col(row)).drop(at, row, name + "_base")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], DataFrame] | None = None, preview: bool = False) -> str:
    """Writes tables as a new generation and returns its name. check gives rows for problems; any row stops the publication.

    Rows are counted as they are written and again as they are read; a difference stops the publication too.
    """
    name = f"gen-{uuid.uuid4().hex}"
    written = {}
    for table, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(partition(root, table, name))
        written[table] = spark.read.parquet(partition(root, table, name))
        if written[table].count() != seen.get["n"]:
            raise ValueError(f"not published: {table} is not whole")
    if check is not None and (found := check(written).limit(5).collect()):
        raise ValueError(f"not published: {found}")
    if not preview:
        row = spark.range(1).select(
            F.lit(VERSION).alias("schema_version"),
            F.lit(name).alias("generation"),
            F.array(*map(F.lit, sorted(tables))).cast("array<string>").alias("tables"),
            F.current_timestamp().alias("published"),
        )
        row.write.mode("append").parquet(f"{root}/publications")
    return name


def active(spark: SparkSession, root: str) -> str:
    """The generation published last (ties: the greater name); another version or an unfit name is refused."""
    rows = spark.read.schema(PUBLICATIONS).parquet(f"{root}/publications")
    found = rows.orderBy(F.desc("published"), F.desc("generation")).first()
    if found is None or found.schema_version != VERSION or not re.fullmatch(r"gen-[0-9a-f]{32}", found.generation or ""):
        raise ValueError("no publication can be used")
    return found.generation


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(partition(root, table, active(spark, root)))
