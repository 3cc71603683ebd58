"""URL filters (6): dated list entries as validity intervals, joined to captures as of their fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dots; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def segment_of(url: Column) -> Column:
    """First part of the path; empty if there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)


def keys_of(host: Column, segment: Column) -> Column:
    """What a list may name: the host, each domain above it of two labels or more, and host/segment."""
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    own = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.concat(domains, own))


def validity(entries: DataFrame) -> DataFrame:
    """(key, category, effective date, action add | remove) -> (key, category, valid_from, valid_to).

    An entry holds until the next one of its key and category; valid_to is
    open (null) for the last. Of entries of one day, an add outweighs. Entries
    that change nothing make no new interval. Nulls in any column: left out.
    """
    e = entries.select("key", "category", "effective", (F.col("action") == "add").alias("on")).dropna()
    e = e.groupBy("key", "category", "effective").agg(F.max("on").alias("on"))
    w = Window.partitionBy("key", "category").orderBy("effective")
    e = e.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).filter(F.col("on") != F.col("was"))
    e = e.withColumn("valid_to", F.lead("effective").over(w))
    return e.filter("on").select("key", "category", F.col("effective").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_on") -> DataFrame:
    """All rows and columns of captures, with blocked, block_categories (sorted, comma-joined), blocked_since.

    A capture is blocked if an entry for one of its keys is valid at its fetch
    (valid_from <= fetch < valid_to). blocked_since is the earliest valid_from
    of these. A null url or time is not blocked. Rows that are repeated stay.
    Empty lists block nothing; an empty table has no rows. Columns of captures
    that are named like the new ones are replaced.

    Captures meet the list once for each host, path segment and time, however
    many there are: a host with a third of all rows is one row for each day.
    """
    out = ("blocked", "block_categories", "blocked_since")
    own = captures.select(*[F.col(f"`{x}`") for x in captures.columns if x not in out])
    key = ["__host", "__segment", "__at"]
    c = own.withColumns({"__host": host_of(F.col(url_col)), "__segment": F.coalesce(segment_of(F.col(url_col)), F.lit("")), "__at": F.col(time_col)})
    each = c.select(*key).dropna().distinct()
    listed = each.withColumn("key", F.explode(keys_of(F.col("__host"), F.col("__segment")))).join(validity(entries), "key")
    listed = listed.filter((F.col("valid_from") <= F.col("__at")) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to"))))
    hits = listed.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("block_categories"), F.min("valid_from").alias("blocked_since"))
    found = c.join(hits, key, "left").drop(*key)
    return found.withColumns({"blocked": F.col("blocked_since").isNotNull(), "block_categories": F.coalesce("block_categories", F.lit(""))}).select(*own.columns, *out)
