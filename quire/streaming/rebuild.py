"""An index that is kept up to date by batches of documents: only what changed is cut into chunks again, old versions stay as archived.

Below a folder stand a log of versions and the chunks, each with a partition for every batch, and the publications. A
batch writes its own partitions and then its publication, so a batch that is done again after a failure replaces what it
had left, and readers see whole batches only. What a batch writes follows its changes and not the index's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quire.scratch import forget, saved

LOG = "doc_id long, version string, deleted boolean, batch long"
PUBLICATIONS = "batch long, published timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table with partitions by batch; empty where nothing was written yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def published(spark: SparkSession, root: str) -> int:
    """The last batch that readers see; -1 before the first."""
    last = stored(spark, f"{root}/publications", PUBLICATIONS).agg(F.max("batch")).first()[0]
    return -1 if last is None else last


def versions(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """(doc_id, version, status, batch): every version of every document, of each the batch that it came with last. A document's last version is active unless it was deleted; all others are archived."""
    upto = published(spark, root) if upto is None else upto
    log = stored(spark, f"{root}/log", LOG).where(F.col("batch") <= upto)
    newest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("batch"))) == 1  # a row for a document and batch at most
    state = log.withColumn("status", F.when(newest & ~F.col("deleted"), "active").otherwise("archived"))
    one = state.where("version is not null").groupBy("doc_id", "version").agg(F.min("status").alias("status"), F.max("batch").alias("batch"))
    return one.select("doc_id", "version", "status", "batch")


def chunks(spark: SparkSession, root: str, schema: str | T.StructType, archived: bool = False) -> DataFrame:
    """The chunks, with doc_id, version and the batch that made them, of active versions, or of archived ones too."""
    own = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*T._parse_datatype_string("doc_id long, version string").fields, *own.fields, T.StructField("batch", T.LongType())])
    upto = published(spark, root)
    rows = stored(spark, f"{root}/chunks", whole).where(F.col("batch") <= upto)
    wanted = versions(spark, root, upto)
    return rows.join(wanted if archived else wanted.where("status = 'active'"), ["doc_id", "version"], "left_semi")


def absorb(rows: DataFrame, number: int, root: str, cut: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Takes a batch (doc_id, text, modified, deleted) into the index as batch `number`.

    Of a document's rows the one modified last counts, of those the one with the greatest text. A document whose text is
    that of its active version is left alone, one that comes back to an earlier text has that version again without being
    cut anew. cut gets (doc_id, version, text) and gives (doc_id, version, ...); check gives rows for problems in what it
    gave, any of which stops the batch before it is published. Rows without a doc_id are left out, null texts are empty.
    """
    spark = rows.sparkSession
    last = F.max(F.struct("modified", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("deleted", F.lit(False)).alias("deleted"))).alias("x")
    given = rows.where("doc_id is not null").groupBy("doc_id").agg(last).select("doc_id", "x.text", "x.deleted")
    given = saved(given.withColumn("version", F.when(~F.col("deleted"), F.sha2(F.col("text").cast("binary"), 256))))
    before = saved(versions(spark, root, number - 1))
    active = before.where("status = 'active'").select("doc_id", F.col("version").alias("now"))
    known = given.select("doc_id", "version", "deleted").join(active, "doc_id", "left")
    changed = known.where(F.when(F.col("deleted"), F.col("now").isNotNull()).otherwise(~F.col("version").eqNullSafe(F.col("now"))))
    changed.select("doc_id", "version", "deleted").write.mode("overwrite").parquet(f"{root}/log/batch={number}")
    fresh = changed.where("not deleted").select("doc_id", "version").join(before.select("doc_id", "version"), ["doc_id", "version"], "left_anti")
    texts = given.select("doc_id", "version", "text").join(fresh, ["doc_id", "version"], "left_semi")
    cut(texts).write.mode("overwrite").parquet(f"{root}/chunks/batch={number}")
    if check is not None and (found := check(spark.read.parquet(f"{root}/chunks/batch={number}")).limit(5).collect()):
        raise ValueError(f"batch {number} is not published: {found}")
    spark.range(1).select(F.lit(number).cast("long").alias("batch"), F.current_timestamp().alias("published")).write.mode("append").parquet(f"{root}/publications")
    forget(given, before)


def rebuild(spark: SparkSession, landing: str, root: str, checkpoint: str, cut: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame] | None = None, files: int | None = None) -> StreamingQuery:
    """Takes all Parquet files that have arrived in a folder into the index, some files to a batch, and ends."""
    stream = spark.readStream.schema("doc_id long, text string, modified long, deleted boolean")
    stream = stream.option("maxFilesPerTrigger", files) if files else stream
    out = stream.parquet(landing).writeStream.foreachBatch(lambda rows, number: absorb(rows, number, root, cut, check))
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
