"""URL filters whose lists change over time.

Dated list entries (a pattern is added to or removed from a list on a day) become validity intervals. Every capture is
evaluated against the entries that were active on the day it was fetched: an as-of join on the patterns its URL can
match (its host, the host's parent domains, and the host with the first folder of the path) and on the month, so that a
pattern's long intervals and a much captured host are both spread, with the exact days as a condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import saved

#: Parts into which the captures of each pattern and month are dealt.
SALTS = 32


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def folder(url: Column) -> Column:
    """The first folder of a URL's path; empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)


def patterns(url: Column) -> Column:
    """What list entries can name of a URL: its host, each parent domain with a dot in it, and host/folder."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.greatest(k, F.lit(1))), "."))
    path = F.when(folder(url) != "", F.array(F.concat_ws("/", host(url), folder(url)))).otherwise(F.array().cast("array<string>"))
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, path)))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, allow, from, to (exclusive; null while open) for entries list, pattern, allow, day, added.

    Repeated entries count once; of several on one day an addition wins. Entries with a null field are left out; a
    removal of what isn't listed does nothing.
    """
    known = entries.where("list is not null and pattern is not null and allow is not null and day is not null and added is not null")
    days = known.groupBy("list", "pattern", "allow", "day").agg(F.max("added").alias("added"))
    after = F.lead("day").over(Window.partitionBy("list", "pattern", "allow").orderBy("day"))
    return days.withColumn("to", after).where("added").select("list", "pattern", "allow", F.col("day").alias("from"), "to")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, day) with host, the number of active entries, the deciding pattern and the decision.

    The longest active pattern decides; of equal ones an allowing entry. Without one the decision is none. A null or
    malformed URL has no host and matches nothing, a null day neither. Repeated rows stay.
    """
    rows = saved(captures.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "day"))  # numbered once, read twice
    captures = rows
    last = F.coalesce(F.date_sub("to", 1), F.lit("2999-12-31").cast("date"))
    bounds = captures.agg(F.trunc(F.min("day"), "month").alias("low"), F.trunc(F.max("day"), "month").alias("high"))  # one row
    active = intervals(entries).crossJoin(F.broadcast(bounds)).withColumns({"a": F.greatest(F.trunc("from", "month"), "low"), "z": F.least(F.trunc(last, "month"), "high")}).where("a <= z")
    active = active.select("pattern", "allow", "from", "to", F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("month"))
    probes = rows.select("row", "day", F.trunc("day", "month").alias("month"), F.explode(patterns(F.col("url"))).alias("pattern"))
    named = active.join(probes.select("pattern", "month").distinct(), ["pattern", "month"], "left_semi")
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a host's captures of a month are dealt to tasks
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    hit = probes.join(salted, ["pattern", "month", "salt"]).where((F.col("day") >= F.col("from")) & (F.col("to").isNull() | (F.col("day") < F.col("to"))))
    best = F.max(F.struct(F.length("pattern").alias("n"), "allow", "pattern"))
    found = hit.groupBy("row").agg(F.count("*").alias("n_active"), best.alias("best"))
    decision = F.when(F.col("best").isNull(), "none").when(F.col("best.allow"), "allow").otherwise("block")
    out = rows.join(found, "row", "left")
    return out.select("page_id", host(F.coalesce("url", F.lit(""))).alias("host"), "day", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.col("best.pattern").alias("pattern"), decision.alias("decision"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries that follow from the hosts in a table, in place of lists that it doesn't have.

    By digits of its MD5, a pattern is on a list or not, from a day of 2024 on, for 20 to 275 days or for good.
    """
    patterns_of = pages.select(F.explode(patterns(F.col("url"))).alias("pattern")).distinct()
    digit = lambda a, n: F.conv(F.substring(F.md5("pattern"), a, n), 16, 10).cast("int")
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(digit(3, 2), F.lit(200)))
    listed = patterns_of.where(digit(1, 1) < 9).select(F.when(digit(2, 1) < 5, "trusted").otherwise("blocked").alias("list"), "pattern", (digit(2, 1) < 5).alias("allow"), start.alias("day"), digit(5, 2).alias("more"), digit(7, 1).alias("ends"))
    added = listed.select("list", "pattern", "allow", "day", F.lit(True).alias("added"))
    gone = listed.where("ends < 10").select("list", "pattern", "allow", F.expr("date_add(day, 20 + more)").alias("day"), F.lit(False).alias("added"))
    return added.unionByName(gone)


def digest(pages: DataFrame) -> DataFrame:
    """Every page as a capture of a day of 2024 that follows from its id, evaluated against dated_entries()."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    return evaluate(pages.select("page_id", "url", day.alias("day")), dated_entries(pages.select("url")))


SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS day,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS folder,
    row_number() OVER () AS row FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM p WHERE host <> ''),
k AS (
  SELECT DISTINCT row, day, pattern FROM (
    SELECT row, day, unnest(list_transform(range(2, greatest(len(labels), 2) + 1), lambda n: array_to_string(labels[greatest(len(labels) - n + 1, 1):], '.'))) AS pattern FROM l
    UNION ALL SELECT row, day, host || '/' || folder FROM l WHERE folder <> '')),
d AS (SELECT DISTINCT pattern, md5(pattern) AS h FROM k),
n AS (SELECT pattern, ('0x' || substr(h, 1, 1))::INT AS a, ('0x' || substr(h, 2, 1))::INT AS b, ('0x' || substr(h, 3, 2))::INT AS c,
        ('0x' || substr(h, 5, 2))::INT AS e, ('0x' || substr(h, 7, 1))::INT AS f FROM d),
i AS (SELECT pattern, b < 5 AS allow, DATE '2024-01-01' + c % 200 AS start, CASE WHEN f < 10 THEN DATE '2024-01-01' + c % 200 + 20 + e END AS stop FROM n WHERE a < 9),
hit AS (SELECT row, i.pattern, allow FROM k JOIN i ON k.pattern = i.pattern AND day >= start AND (stop IS NULL OR day < stop)),
g AS (SELECT row, count(*) AS n_active, max({'n': length(pattern), 'allow': allow, 'pattern': pattern}) AS best FROM hit GROUP BY row)
SELECT page_id, host, day, coalesce(n_active, 0) AS n_active, best.pattern AS pattern,
  CASE WHEN best IS NULL THEN 'none' WHEN best.allow THEN 'allow' ELSE 'block' END AS decision
FROM p LEFT JOIN g USING (row)
"""
