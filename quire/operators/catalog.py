"""What a library knows of its files: manifests, copies, pinned sources, lookups, flat metadata, and joins by a text's hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import page_range
from quire.operators.versions import normalized
from quire.scratch import BROADCAST_ROWS, saved

HASH = "^[a-f0-9]{64}$"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def slug(file: Column) -> Column:
    """A file name's stem in small letters and digits, with single hyphens between."""
    stem = F.regexp_replace(F.lower(F.regexp_replace(file, r"\.[^.]*$", "")), "[^a-z0-9]+", "-")
    return F.regexp_replace(stem, "^-|-$", "")


def met(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """rows with the columns of small, whose keys are unique and n is the number of rows that each has; null where there is none.

    What many rows share is broadcast, as no more than BROADCAST_ROWS keys can each have more than one in BROADCAST_ROWS
    of all rows; the others meet by hash, so no key is a hot task.
    """
    small = saved(small)
    total = small.agg(F.sum("n")).first()[0] or 0
    hot = small.where(F.col("n") > total / BROADCAST_ROWS)
    first = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), key, "left")
    rest = first.where("is_hot is null").select(*(f"`{c}`" for c in rows.columns)).join(small.join(hot.select(key), key, "left_anti"), key, "left")
    return first.where("is_hot").drop("is_hot", "n").unionByName(rest.drop("n"))


def additional_files(files: DataFrame) -> DataFrame:
    """(version_id, doc_id, first): the documents (doc_id, text) that hold what an earlier one has, with its version and the first one's id; one row for each, however many there are."""
    own = files.select("doc_id", sha(F.col("text")).alias("sha"))
    first = own.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    out = met(own, first, "sha").where("first is not null and doc_id <> first")
    return out.select(F.concat(F.lit("document:"), F.col("first").cast("string"), F.lit(":"), "sha").alias("version_id"), "doc_id", "first")


def equalized(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(id, names, title, status, sha) of a manifest (id, names array, title, status) against the files at hand (file, sha).

    An entry with a file is active with the hash of its first one; its other files get active entries of their own; files
    that no entry names too. An entry without a file stays as it is. Files are known by their normalised names, of files
    with one normalised name the first counts.
    """
    known = files.withColumn("norm", normalized(F.col("file"))).groupBy("norm").agg(F.min(F.struct("file", "sha")).alias("x")).select("norm", "x.file", "x.sha")
    named = manifest.select("id", "title", "status", F.posexplode("names").alias("place", "name")).withColumn("norm", normalized(F.col("name")))
    here = named.join(known, "norm", "left")
    by_file = here.where("file is not null").groupBy("id", "file", "sha").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("own"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("file"))
    by_file = by_file.withColumn("k", place).withColumn("own", F.transform("own", lambda x: x["name"]))
    absent = here.where("file is null").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("absent"))
    none = F.array().cast("array<string>")
    first = by_file.where("k = 1").select("id", "sha", "own")
    entries = manifest.select("id", "title", "status").join(first, "id", "left").join(absent, "id", "left")
    names = F.concat(F.coalesce("own", none), F.coalesce("absent", none))
    entries = entries.select("id", names.alias("names"), "title", F.when(F.col("sha").isNotNull(), "active").otherwise(F.col("status")).alias("status"), "sha")
    stem = F.replace(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    more = by_file.where("k > 1").select(slug(F.col("file")).alias("id"), F.col("own").alias("names"), stem.alias("title"), F.lit("active").alias("status"), "sha")
    new = known.join(named.select("norm").distinct(), "norm", "left_anti")
    new = new.select(slug(F.col("file")).alias("id"), F.array("file").alias("names"), stem.alias("title"), F.lit("active").alias("status"), "sha")
    return entries.unionByName(more).unionByName(new)


def entry_problem() -> Column:
    """What is wrong with a manifest's entry (id, archived array of hashes, status, reviewer, reviewed_at, sha); the first of them, null for a sound one."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    archived = F.coalesce("archived", F.array().cast("array<string>"))
    date = F.try_to_timestamp(F.when(F.col("reviewed_at").rlike(r"^\d{4}-\d\d-\d\d"), F.substring("reviewed_at", 1, 10))).isNull()
    return (
        F.when(~F.coalesce(F.col("id").rlike("^[a-z0-9][a-z0-9-]*$"), F.lit(False)), "no slug")
        .when(F.exists(archived, lambda x: ~F.coalesce(x.rlike(HASH), F.lit(False))), "archived version without a hash")
        .when(F.array_contains(archived, F.coalesce("sha", F.lit(""))), "current version is archived")
        .when((F.col("status") == "active") & (blank("reviewer") | blank("reviewed_at") | ~F.coalesce(F.col("sha").rlike(HASH), F.lit(False))), "active without review")
        .when((F.col("status") == "active") & date, "review is no date")
    )


def citable(pinned: Column, quote: Column) -> Column:
    """Why a pinned source (text, status, classification) can't be cited: not active, not public, changed, quote changed; else fine."""
    why = F.when(F.col("status") != "active", "not active").when(F.coalesce(F.col("classification") != "public", F.lit(True)), "not public")
    return why.when(~pinned.eqNullSafe(sha(F.col("text"))), "changed").when(~F.coalesce(F.contains("text", quote), F.lit(False)), "quote changed").otherwise("fine")


def looked_up(sections: DataFrame, asked: DataFrame, scope: Column) -> DataFrame:
    """The asked sections (doc_id, section) that a scope shows, with their text and their parent's text; what is hidden gives no row, a hidden or missing parent null."""
    seen = sections.where(scope)
    child = seen.join(asked, ["doc_id", "section"]).select("doc_id", "section", "parent", "text")
    above = seen.select("doc_id", F.col("section").alias("parent"), F.col("text").alias("parent_text"))
    return child.join(above, ["doc_id", "parent"], "left").select("doc_id", "section", "text", "parent_text")


def flat_metadata(rows: DataFrame, key: str) -> DataFrame:
    """(key, page, effective_date, revision_date, n) of rows (key, place, page, effective, revision): the pages as one range, and the first of each date by place."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("place", c)))[c]
    out = rows.groupBy(key).agg(F.min("page").alias("low"), F.max("page").alias("high"), first("effective").alias("effective_date"), first("revision").alias("revision_date"), F.count("*").alias("n"))
    return out.select(key, page_range(F.array("low", "high")).alias("page"), "effective_date", "revision_date", "n")


def by_text(wanted: DataFrame, corpus: DataFrame) -> DataFrame:
    """wanted (doc_id, text) with found, the greatest doc_id of the corpus with the same text; null where no text is the same. Texts meet by hash and length."""
    mark = lambda t: t.select("doc_id", F.concat_ws(":", sha(F.col("text")), F.length("text").cast("string")).alias("mark"))
    last = mark(corpus).groupBy("mark").agg(F.max("doc_id").alias("found"))
    n = mark(wanted).groupBy("mark").agg(F.count("*").alias("n"))
    return met(mark(wanted), last.join(n, "mark"), "mark").select("doc_id", "found")


def paired(store: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, question, doc_id): each question of a store (key, questions array) with the first text (doc_id, key) of its key; null where there is no text."""
    asked = store.groupBy("key").agg(F.max("questions").alias("questions")).select("key", F.explode("questions").alias("question"))
    return asked.join(texts.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "key", "left")


def file_key(name: Column) -> Column:
    """A file name's lookup key with the letters and digits of all scripts."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def tagged(pages: DataFrame, table: DataFrame, default: str = "General Policy") -> DataFrame:
    """pages (source) with policy_name and doc_type of a table (file, policy_name, doc_type) by file name, and file_format by suffix; unknown files have their own name and the default type."""
    known = table.withColumn("key", file_key(F.col("file"))).groupBy("key").agg(F.min(F.struct("file", "policy_name", "doc_type")).alias("x"))
    out = pages.withColumn("key", file_key(F.col("source"))).join(known, "key", "left")
    suffix = F.upper(F.regexp_extract("source", r"\.([A-Za-z0-9]+)$", 1))
    return out.select(*(f"`{c}`" for c in pages.columns), F.coalesce("x.policy_name", "source").alias("policy_name"), F.coalesce("x.doc_type", F.lit(default)).alias("doc_type"), F.when(suffix == "", "UNKNOWN").otherwise(suffix).alias("file_format"))
