"""Time-aware URL filters: which list entries were active when a page was fetched?

Dated add and remove entries become disjoint validity intervals per (list, domain). A capture
is tested against its host and all parent domains with an as-of join: intervals are cut at
30-day buckets, captures know their bucket, and the two meet on (domain, bucket) with the
exact interval as a further condition. One domain and bucket has at most one interval start
per day and list, so no match fans out, whatever the number of captures. Captures are reduced
to distinct (host, day) first, so a host with a third of all captures is looked up once a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_DAYS = 30
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; null when the url has none."""
    found = F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))
    return F.when(found != "", found)


def domains(name: Column) -> Column:
    """The host and all its parents: a.b.c gives a.b.c, b.c and c."""
    labels = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, since, until): ``entries`` has (list, domain, action 'add' or 'remove',
    day date). Entries of one day count once, and adding wins over removing. An interval
    includes ``since`` and excludes ``until``, null when it is still open. Entries with a null
    list, domain or day, or another action, are ignored."""
    days = (
        entries.where(F.col("action").isin("add", "remove"))
        .dropna(subset=["list", "domain", "day"])
        .groupBy("list", "domain", "day")
        .agg(F.max((F.col("action") == "add").cast("int")).alias("active"))
    )
    order = Window.partitionBy("list", "domain").orderBy("day")
    changes = days.withColumn("before", F.lag("active", 1, 0).over(order)).where("active <> before")
    return (
        changes.withColumn("until", F.lead("day").over(order))
        .where("active = 1")
        .select("list", "domain", F.col("day").alias("since"), "until")
    )


def _bucket(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BUCKET_DAYS)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of ``captures`` (url, fetched date, any others but the new ones) with ``host``,
    ``blocked`` and ``matches`` (sorted array<struct<list, domain>> of the entries active at
    fetch time).

    Captures without a host or a date match nothing. Repeated captures are kept; an empty list
    blocks nothing.
    """
    rows = captures.withColumn("host", host(F.col("url")))
    asked = rows.select("host", "fetched").dropna().distinct()
    last = asked.agg(F.max("fetched").alias("last"))
    intervals = validity_intervals(entries).join(F.broadcast(last), F.col("since") <= F.col("last"))
    pieces = intervals.withColumn(
        "bucket",
        F.explode(
            F.sequence(
                _bucket(F.col("since")),
                _bucket(F.least(F.date_sub(F.coalesce("until", F.date_add("last", 1)), 1), "last")),
            )
        ),
    ).drop("last")
    found = (
        asked.select("host", "fetched", _bucket(F.col("fetched")).alias("bucket"), F.explode(domains(F.col("host"))).alias("domain"))
        .join(pieces, ["domain", "bucket"])
        .where("fetched >= since AND (until IS NULL OR fetched < until)")
        .groupBy("host", "fetched")
        .agg(F.sort_array(F.collect_set(F.struct("list", "domain"))).alias("matches"))
    )
    none = F.array().cast("array<struct<list:string,domain:string>>")
    return rows.join(found, ["host", "fetched"], "left").withColumns(
        {
            "blocked": F.col("matches").isNotNull(),
            "matches": F.coalesce("matches", none),
        }
    )
