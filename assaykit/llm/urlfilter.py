"""URL filters by a temporal list join: dated list entries, evaluated as of each capture's fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; '' for null or a URL without one."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, "\\.$", "")


def segments_of(url: Column) -> Column:
    """Path segments without empty ones, query and fragment."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def entry_key(entry: Column) -> Column:
    """``host`` or ``host/path/segments`` of a list entry."""
    return F.concat_ws("/", F.array_insert(segments_of(entry), 1, host_of(entry)))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) in which each entry (entry, action add or remove, on) is listed.

    An addition holds until the entry's next event; of several events at one time a removal counts last. valid_to is
    null while the entry is still listed. Rows with null entry, action or time, and unknown actions, are ignored.
    """
    known = entries.where(F.col("action").isin("add", "remove") & F.col("on").isNotNull() & (host_of(F.col("entry")) != ""))
    at = known.groupBy(entry_key(F.col("entry")).alias("key"), F.col("on").cast("timestamp").alias("valid_from")).agg(
        F.max("action").alias("action")  # 'remove' sorts after 'add'
    )
    then = F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from"))
    return at.withColumn("valid_to", then).where(F.col("action") == "add").select("key", "valid_from", "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", broadcast_sites: int = 100_000) -> DataFrame:
    """Evaluate every capture (id, url, fetched) against the list entries that are active at its fetch time.

    An entry holds for its host, all subdomains, and all paths that begin with its segments. Returns the id, host,
    fetched, n_active, and entry and since of the most specific active entry (longest host, then longest path), blocked.

    Captures are first reduced to distinct sites (host and as many path segments as any entry has); sites meet entries
    by equality of their suffixes and prefixes, never by comparing all pairs. The sites' intervals then go back to the
    captures: broadcast up to ``broadcast_sites`` matched sites, else by a shuffle in which AQE splits hot hosts.

    Null or hostless URLs and null fetch times are never blocked (host '', null time). Repeated captures are judged
    each; an empty list blocks nothing; other columns of ``captures`` are ignored.
    """
    spans = materialize(validity(entries), "validity")
    depth = spans.agg(F.max(F.size(F.split("key", "/")) - 1).alias("d")).first().d or 0
    made = captures.select(
        F.col(id_col), host_of(F.col("url")).alias("host"), F.slice(segments_of(F.col("url")), 1, max(1, depth)).alias("segments"),
        F.col("fetched").cast("timestamp").alias("fetched"),
    ).withColumn("segments", F.col("segments") if depth else F.array().cast("array<string>"))
    made = made.withColumn("site", F.concat_ws("/", F.array_insert("segments", 1, F.col("host"))))
    sites = made.where(F.col("host") != "").select("site", "host", "segments").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("segments")), lambda i: F.concat_ws("/", F.slice(F.col("segments"), F.lit(1), i)))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.when(p == "", h).otherwise(F.concat(h, F.lit("/"), p)))))
    hits = sites.select("site", F.explode(keys).alias("key")).join(spans, "key")
    rank = F.struct(
        F.size(F.split(F.substring_index("key", "/", 1), "\\.")).alias("labels"), F.size(F.split("key", "/")).alias("depth"),
        F.col("key").alias("entry"), F.col("valid_from").alias("since"), F.col("valid_to").alias("until"),
    )
    hits = materialize(hits.groupBy("site").agg(F.collect_list(rank).alias("spans")), "sites")
    if hits.count() <= broadcast_sites:
        hits = F.broadcast(hits)
    active = F.filter("spans", lambda s: (s.since <= F.col("fetched")) & (s.until.isNull() | (F.col("fetched") < s.until)))
    best = F.try_element_at(F.sort_array("active"), F.lit(-1))
    return (
        made.drop("segments")
        .join(hits, "site", "left")
        .withColumn("active", active)
        .select(
            id_col, "host", "fetched", F.coalesce(F.array_size("active"), F.lit(0)).cast("long").alias("n_active"), best.alias("best"),
        )
        .select(
            id_col, "host", "fetched", "n_active", F.col("best.entry").alias("entry"),
            F.col("best.since").alias("since"), F.col("best").isNotNull().alias("blocked"),
        )
    )
