"""URL filters with dated lists: validity intervals and an as-of join. DataFrame operations only.

A list is a log of dated entries: from ``at`` on, ``pattern`` has ``action``. Entries of one pattern
become half-open intervals, each ending where the next begins. A capture is looked up under every
pattern that may cover it - its host, the host's parent domains, and each of these with the leading
directories of the path - and the entries that are active at its fetch time decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_enough


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, action, since, until`` from ``pattern, action, at``; the last ``until`` is null.

    Patterns are compared in lower case, without a scheme and slashes at the end; one with a query
    matches nothing. Entries with a null pattern, action or time are void. Of
    entries of one pattern and time, the greatest action by name counts ("block" after "allow");
    repeated entries count once.
    """
    usable = entries.filter("pattern is not null and action is not null and at is not null")
    bare = F.regexp_replace(F.lower("pattern"), r"^[a-z][a-z0-9+.-]*://|/+$", "")
    dated = usable.groupBy(bare.alias("pattern"), F.col("at").alias("since")).agg(F.max("action").alias("action"))
    until = F.lead("since").over(W.partitionBy("pattern").orderBy("since"))
    return dated.select("pattern", "action", "since", until.alias("until"))


def covering_patterns(url):
    """Array of ``struct(pattern, rank)``, the most specific first; empty for what is no URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.lower(path), "/"), lambda part: part != "")
    none = F.array().cast("array<string>")
    # each path with one part less than the one before, the whole path first
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))).otherwise(none)
    deep = F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.concat(d, p))))
    every = F.concat(deep, domains)
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def decide(captures: DataFrame, entries: DataFrame, broadcast_rows: int = 200_000, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``id_col, allowed, pattern, action, since, n_active`` for every row of ``captures``.

    Of the active entries that cover a capture, the one with the most specific pattern decides
    (host and directory before host before parent domain); without any it is allowed. A null or
    malformed URL, or a null time, matches nothing and is allowed. Rows that repeat an id are merged
    if they agree in URL and time, and decided apart otherwise. No rows give no rows; an empty list
    allows everything. The list is broadcast only if it has ``broadcast_rows`` intervals at most;
    otherwise both sides are shuffled by pattern and Spark splits hot patterns at run time.
    """
    spans = intervals(entries)
    if small_enough(spans, broadcast_rows):
        spans = F.broadcast(spans)
    rows = captures.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), F.col(f"`{time_col}`").alias("_at"))
    asked = rows.select("_id", "_url", "_at", F.posexplode_outer(covering_patterns(F.col("_url"))).alias("_rank", "_pattern"))
    active = (F.col("_pattern") == F.col("pattern")) & (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    hits = asked.join(spans, active, "left")
    best = F.min(F.when(F.col("pattern").isNotNull(), F.struct("_rank", "pattern", "action", "since"))).alias("best")
    found = hits.groupBy("_id", "_url", "_at").agg(best, F.count("pattern").alias("n_active"))
    return found.select(
        F.col("_id").alias(id_col),
        F.coalesce(F.col("best.action") != "block", F.lit(True)).alias("allowed"),
        F.col("best.pattern").alias("pattern"),
        F.col("best.action").alias("action"),
        F.col("best.since").alias("since"),
        "n_active",
    )
