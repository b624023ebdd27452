"""Operator 7, URL filters as a temporal list join, in DataFrame functions only.

Lists are histories: dated rows that add an entry to a list or take it off. Each history
becomes validity intervals [from_day, to_day) by looking at the next row of the entry. A
capture is turned into the keys that could list it (its host, each parent domain, each
directory prefix), and an as-of join finds the intervals that hold at the day of the fetch.

The join is an equi join on key and time bucket, so a long history of one host costs each
capture only the part near its day; Spark may broadcast the lists if they are small, and
splits a host that a third of all captures share if they are not. Equal captures (URL and
day) are looked up once.

Defined results: every row of the captures comes out; a null or malformed URL, or a null
day, matches nothing; of several changes of one entry on one day a removal wins; repeated
entries count once. Columns of the captures are kept, but for those named like an added
one, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 32
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
ADDED = ["blocked", "n_entries", "lists"]


def host_of(url: Column) -> Column:
    """Lower-case host; empty if there is none."""
    return F.regexp_extract(F.lower(url), HOST, 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def url_keys(url: Column) -> Column:
    """Keys of a URL: ``host:h``, ``domain:d`` of two labels or more, ``prefix:h/dir``."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.filter(F.sequence(F.lit(1), n), lambda i: i < n), lambda i: F.concat(F.lit("domain:"), F.concat_ws(".", F.slice(labels, i, n)))
    )
    parts = F.split(path_of(url), "/")
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: (i > 1) & (F.element_at(parts, i) != "")),
        lambda i: F.concat(F.lit("prefix:"), host, F.concat_ws("/", F.slice(parts, F.lit(1), i))),
    )
    keys = F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)
    return F.when(host != "", F.array_distinct(keys))


def validity(history: DataFrame) -> DataFrame:
    """Intervals (list, key, from_day, to_day) of histories (list, key, day, active); to_day is null if open."""
    rows = history.where("list IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL AND active IS NOT NULL")
    daily = rows.groupBy("list", "key", "day").agg(F.min("active").alias("active"))
    own = Window.partitionBy("list", "key").orderBy("day")
    changes = daily.withColumn("was", F.lag("active").over(own)).where("was IS NULL OR was <> active")
    return changes.withColumn("to_day", F.lead("day").over(own)).where("active").select("list", "key", F.col("day").alias("from_day"), "to_day")


def filter_urls(captures: DataFrame, intervals: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """Captures with blocked, n_entries (entries active at the fetch) and lists (their lists, by name)."""
    kept = [c for c in captures.columns if c.lower() not in ADDED]
    rows = captures.select(F.struct(*kept).alias("kept"), F.col(url).alias("_url"), F.col(day).cast("long").alias("_day"))
    asked = rows.select("_url", "_day").where("_url IS NOT NULL AND _day IS NOT NULL").distinct()
    bucket = lambda c: F.floor(c / BUCKET_DAYS)
    keyed = asked.select("_url", "_day", F.explode(url_keys(F.col("_url"))).alias("key")).withColumn("bucket", bucket(F.col("_day")))
    ends = rows.agg(F.min("_day").alias("low"), F.max("_day").alias("high"))
    ranges = intervals.join(F.broadcast(ends)).where("from_day <= high AND (to_day IS NULL OR to_day > low)")
    first, last = F.greatest("from_day", "low"), F.coalesce(F.least(F.col("to_day") - 1, F.col("high")), F.col("high"))
    dealt = ranges.select("list", "key", "from_day", "to_day", F.explode(F.sequence(bucket(first), bucket(last))).alias("bucket"))
    hits = keyed.join(dealt, ["key", "bucket"]).where("from_day <= _day AND (to_day IS NULL OR _day < to_day)")
    found = hits.groupBy("_url", "_day").agg(
        F.count(F.lit(1)).alias("n_entries"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists")
    )
    return rows.join(found, ["_url", "_day"], "left").select(
        "kept.*",
        F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce("lists", F.lit("")).alias("lists"),
    )
