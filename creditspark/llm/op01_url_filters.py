"""Operator 1 [native]: URL filters by a temporal list join.

Dated list entries (an entry is added to or removed from a list on a day) become validity
intervals, and every capture is decided by the entries valid on the day it was fetched. A capture
is looked up by its whole URL, the directories of its path, its host and the host's parent
domains. Captures are first reduced to distinct (key, day) pairs, which meet the intervals by an
equi-join on the key with the day inside; each pair's answer then joins the captures. A host with
a third of all captures is thus a few days' pairs, and the join back has unique keys on its right
side, so its hot side splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("url", "path", "host", "domain")  # from the most specific to the least

URL_PARTS = r"^([a-z][a-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?"


def list_intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, category, valid_from, valid_to) from dated entries.

    ``entries``: list, kind, pattern, category, day, action (``add`` or ``remove``). The last event
    of a day counts (removals last); an addition holds until the pattern's next event in that list,
    or for ever (null). Repeated entries count once. Rows with a null list, kind, pattern, day or
    action are ignored, as are unknown kinds and actions. A pattern has at most one event a day,
    so a window's group is bounded by the calendar.
    """
    known = entries.where(
        F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("day").isNotNull()
        & F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove"))
    daily = known.groupBy("list", "kind", "pattern", "day").agg(
        F.max("action").alias("action"), F.min(F.when(F.col("action") == "add", F.coalesce("category", F.lit("")))).alias("category"))
    following = Window.partitionBy("list", "kind", "pattern").orderBy("day")
    dated = daily.withColumn("valid_to", F.lead("day").over(following)).where("action = 'add'")
    return dated.select("list", "kind", "pattern", "category", F.col("day").alias("valid_from"), "valid_to")


def url_keys(url: F.Column) -> F.Column:
    """Array of (kind, key) under which a URL is looked up; empty for URLs without scheme or host."""
    low = F.lower(F.trim(url))
    host = F.regexp_replace(F.regexp_extract(low, URL_PARTS, 2), r"\.+$", "")
    path = F.regexp_extract(low, URL_PARTS, 3)
    query = F.regexp_extract(low, URL_PARTS, 4)
    labels = F.split(host, r"\.")
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    paths = F.transform(F.sequence(F.lit(1), F.greatest(F.size(folders), F.lit(1))),
                        lambda i: key("path", F.concat(host, F.lit("/"), F.array_join(F.slice(folders, F.lit(1), i), "/"))))
    keys = F.concat(F.array(key("url", F.concat(host, path, query)), key("host", host)), domains, paths)
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(keys)).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched_on) with the decision of the lists at fetch time.

    Adds decision (``blocked``, ``allowed``, ``unlisted``), matched_kind, matched_pattern, category,
    valid_from and n_active (entries that apply). The most specific kind decides, then the longer
    pattern, then an ``allow`` list before others, then the list's name. Null or malformed URLs and
    null dates are unlisted. Repeated captures give a row each; other columns are ignored.
    """
    day = F.col("fetched_on").cast("date")
    rows = captures.select("page_id", "url", day.alias("fetched_on")).groupBy("page_id", "url", "fetched_on").agg(F.count("*").alias("_copies"))
    keyed = rows.select("*", F.explode_outer(url_keys(F.col("url"))).alias("k")).select("page_id", "url", "fetched_on", "_copies", "k.kind", "k.key")
    spans = list_intervals(entries)
    pairs = keyed.where("kind is not null and fetched_on is not null").select("kind", F.col("key").alias("pattern"), "fetched_on").distinct()
    active = pairs.join(spans, ["kind", "pattern"]).where("valid_from <= fetched_on and (valid_to is null or fetched_on < valid_to)")
    rank = F.struct(F.expr(" ".join(["case kind", *(f"when '{k}' then {i}" for i, k in enumerate(KINDS)), "end"])).alias("r"),
                    (-F.length("pattern")).alias("longer"), F.when(F.col("list") == "allow", 0).otherwise(1).alias("a"), "list",
                    "kind", "pattern", "category", "valid_from")
    answers = active.groupBy("kind", F.col("pattern").alias("key"), "fetched_on").agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    met = keyed.join(answers, ["kind", "key", "fetched_on"], "left")
    decided = met.groupBy("page_id", "url", "fetched_on", "_copies").agg(F.min("best").alias("best"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_active"))
    decided = decided.withColumn("_copy", F.explode(F.expr("sequence(1, _copies)")))
    return decided.select(
        "page_id", "url", "fetched_on",
        F.when(F.col("best").isNull(), "unlisted").when(F.col("best.list") == "allow", "allowed").otherwise("blocked").alias("decision"),
        F.col("best.kind").alias("matched_kind"), F.col("best.pattern").alias("matched_pattern"), F.col("best.category").alias("category"),
        F.col("best.valid_from").alias("valid_from"), "n_active")
