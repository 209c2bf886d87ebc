"""URL filters by a temporal list join, with DataFrame functions only.

Dated entries (list, key, action, day) become validity intervals: an entry holds from
its day until the next one of the same list and key.  A key is a domain
(``example.com``, which covers its subdomains) or a domain of exactly that host with a
path prefix (``example.com/fr``).  Each distinct URL is joined once with the intervals
of its keys; each capture is then evaluated as of its own fetch time, without moving
the page itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed

#: Later ones win where a list has several entries of a key on one day.
ACTIONS = ("remove", "allow", "block")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, since, until) of dated entries (list, key, action, day).

    Keys are compared in lower case.  Rows with a null in any column or another
    action than ``ACTIONS`` are no entries; repeated rows count once; of several
    entries of a list and key on one day the last of ``ACTIONS`` holds.  ``until``
    is null for the last entry; ``remove`` only ends what was before it.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    rows = entries.select("list", F.lower("key").alias("key"), rank.alias("rank"), F.col("day").cast("timestamp_ntz").alias("since"))
    rows = rows.filter("list is not null and key is not null and since is not null and rank > 0")
    rows = rows.groupBy("list", "key", "since").agg(F.max("rank").alias("rank"))
    until = F.lead("since").over(Window.partitionBy("list", "key").orderBy("since"))
    rows = rows.withColumn("until", until).filter("rank > 1")
    return rows.select("list", "key", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")).alias("action"), "since", "until")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a dot at its end; empty where a URL has none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.rtrim(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), F.lit("."))


def path_of(url: Column) -> Column:
    """Path of a URL without query and fragment, in lower case."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """Every key that covers a URL: the host, its parent domains, and the host with each path prefix."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(segments, lambda x, i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i + 1), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def _labels(key: Column) -> Column:
    """Labels of a key's host."""
    return F.size(F.split(F.substring_index(key, "/", 1), r"\."))


def verdicts(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """One row for each capture: id, host, fetch time, ``verdict`` and the entry behind it.

    ``verdict`` is the action of the longest key that covers the URL with an entry
    active at the fetch time (since <= time < until); on a tie block before allow,
    then the first list by name.  It is ``pass``, and list, key and since are null,
    where no entry is active, the URL is null or has no host, or the time is null.
    Repeated captures each give a row; other columns are ignored; without captures
    there are no rows, and without entries all pass.
    """
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"), F.col(fetched).cast("timestamp_ntz").alias("_at"))
    spans = intervals(entries)
    urls = rows.filter("_url is not null").select("_url").distinct()
    keyed = urls.select("_url", F.explode(keys_of(host_of(F.col("_url")), path_of(F.col("_url")))).alias("_key"))
    depths = [r[0] for r in spans.select(_labels(F.col("key")).alias("n")).distinct().collect()]  # a few small numbers
    keyed = keyed.filter(_labels(F.col("_key")).isin(depths))  # a key like com, which every URL has, goes unless a list has such
    hits = keyed.join(spans, keyed._key == spans.key)
    entry = F.struct(
        (-F.length("key")).alias("longest"), F.when(F.col("action") == "block", 0).otherwise(1).alias("kind"),
        "list", "key", "action", "since", "until",
    )
    lists = checkpointed(hits.groupBy(F.col("_url").alias("_listed")).agg(F.array_sort(F.collect_list(entry)).alias("_entries")))
    found = rows.join(lists, rows._url == lists._listed, "left")
    active = F.filter("_entries", lambda x: (x["since"] <= F.col("_at")) & (x["until"].isNull() | (F.col("_at") < x["until"])))
    first = F.get(active, F.lit(0))
    return found.select(
        F.col("_id").alias(id_col), F.coalesce(host_of(F.col("_url")), F.lit("")).alias("host"), F.col("_at").alias(fetched),
        F.coalesce(first["action"], F.lit("pass")).alias("verdict"), first["list"].alias("list"), first["key"].alias("key"), first["since"].alias("since"),
    )
