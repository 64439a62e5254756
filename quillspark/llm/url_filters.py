r"""URL filters by temporal list join, in DataFrame expressions only.

List entries are dated: each adds a pattern to a list or removes it. Per (kind, pattern, list) they become validity
intervals, closed at the start and open at the end, that last until the next entry of the same key. Every capture is
then joined as of its fetch time with the intervals of the patterns that fit its URL:

    domain  the host or a parent domain of it
    url     host and path, without scheme, user, port, query, fragment and trailing slashes

Domains are resolved for distinct hosts first, so that a popular parent domain meets each host once and not each
capture; captures then meet the intervals of their own host and URL on equal keys. Both joins are plain equi-joins
with a time condition, which adaptive execution can split when one host holds a large part of the rows.

Cases: a null or malformed URL has no host and fits nothing; a null fetch time fits nothing (both give
``blocked = false``); entries with a null field are no entries; of entries with equal times a removal comes last;
repeated captures (equal id, URL and time) give one row; entries without captures and empty tables go through; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"
FOREVER = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """Lower-case host; empty if the URL has none."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))
    return F.regexp_replace(found, r"\.+$", "")


def url_key(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1), r"/+$", "")
    return F.concat(host_of(url), path)


def parent_domains(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.", -1)
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, list_name, valid_from, valid_to) from dated entries (kind, pattern, list_name, action, at)."""
    rows = entries.select("kind", F.lower("pattern").alias("pattern"), "list_name", "action", "at").dropna()
    # Within one key the order is by time; a key's entries are as many as its list changes.
    order = Window.partitionBy("kind", "pattern", "list_name").orderBy("at", F.when(F.col("action") == "remove", 1).otherwise(0))
    rows = rows.distinct().withColumn("valid_to", F.coalesce(F.lead("at").over(order), F.lit(FOREVER).cast(rows.schema["at"].dataType)))
    rows = rows.where((F.col("action") == "add") & (F.col("at") < F.col("valid_to")))
    return rows.select("kind", "pattern", "list_name", F.col("at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture (page_id, url, fetch_ts) with what the lists said at its fetch time.

    Returns page_id, url, fetch_ts, host, blocked, n_entries, and list_name, kind, pattern and valid_from of the
    longest fitting pattern (ties: kind, list, earliest start).
    """
    spans = validity_intervals(entries)
    seen = captures.select("page_id", "url", "fetch_ts").distinct().withColumn("host", host_of(F.col("url")))
    hosts = seen.where("host != ''").select("host").distinct()
    up = hosts.select("host", F.explode(parent_domains(F.col("host"))).alias("pattern"))
    by_host = up.join(spans.where("kind = 'domain'"), "pattern").withColumn("key", F.concat(F.lit("d:"), "host"))
    by_url = spans.where("kind = 'url'").withColumn("key", F.concat(F.lit("u:"), "pattern"))
    cols = ["key", "kind", "pattern", "list_name", "valid_from", "valid_to"]
    active = by_host.select(cols).unionByName(by_url.select(cols))
    # A capture without a host keeps one row, under a key that no interval has.
    keys = F.when(
        F.col("host") != "", F.array(F.concat(F.lit("d:"), "host"), F.concat(F.lit("u:"), F.lower(url_key(F.col("url")))))
    ).otherwise(F.array(F.lit("-")))
    asked = seen.withColumn("key", F.explode(keys)).alias("c")
    a = active.alias("a")
    at_time = (F.col("c.fetch_ts") >= F.col("a.valid_from")) & (F.col("c.fetch_ts") < F.col("a.valid_to"))
    joined = asked.join(a, (F.col("c.key") == F.col("a.key")) & at_time, "left")
    best = F.struct(
        (-F.length("a.pattern")).alias("shorter"),
        F.col("a.kind").alias("kind"),
        F.col("a.list_name").alias("list_name"),
        F.col("a.valid_from").alias("valid_from"),
        F.col("a.pattern").alias("pattern"),
    )
    found = joined.groupBy("c.page_id", "c.url", "c.fetch_ts", "c.host").agg(
        F.count("a.pattern").alias("n_entries"), F.min(F.when(F.col("a.pattern").isNotNull(), best)).alias("best")
    )
    return found.select(
        "page_id",
        "url",
        "fetch_ts",
        "host",
        (F.col("n_entries") > 0).alias("blocked"),
        "n_entries",
        F.col("best.list_name").alias("list_name"),
        F.col("best.kind").alias("kind"),
        F.col("best.pattern").alias("pattern"),
        F.col("best.valid_from").alias("valid_from"),
    )
