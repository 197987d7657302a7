"""Mixing sources to target weights by hashed keys and distributed prefix sums.

Each row gets a hash-random key. Rows of a source are range-partitioned by the leading digits of
the key into bins whose number follows the source's row count; sums per bin and a prefix sum over
bins give each bin's offset, and a running sum within a bin finishes the job. A source with a third
of all rows is many bins, so no task holds a source. A source is cut at its exact budget; budgets
beyond the source repeat it in whole epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, word_count


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Weights repeat over the sources in code-point order, null last. ``share`` times all sizes is
    dealt out by weight; no target is above ``most`` times its source's size, and what is cut goes
    to the rest by weight until none is above. Sources are filled in order of cap / weight: the
    level at which no further source is full gives all targets at once. One row per source takes
    part, so the window over all of them is small beside the rows.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    rows = (
        rows.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("after", F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("after"))
        # the first source in this order that its level does not fill sets the level of all later ones
        .withColumn("open", F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")))
        .withColumn("level", F.first("open", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    bin_rows: int = 1500,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``id_col, size, source_size, target, taken, epochs, rest`` for every row of ``docs``.

    ``size`` counts words (null text: 0). ``taken = epochs * size + rest``: whole repeats and, in
    the last, begun epoch, the words up to the source's budget: all of a row's words before the
    cut, none after it, part of them in the row that the cut falls in. The taken words of a source
    add up to its target, rounded down. Ties of the key go by id, null ids last; rows equal in id
    and size are alike. Null is a source like any other. Extra columns are ignored. No rows give no
    rows. Keys come from MD5, so reruns agree on any cluster.
    """
    rows = _sized(docs, seed, id_col, text_col, source_col)
    return _taken(rows, weights, share, most, bin_rows).select(
        F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"), "epochs", "rest"
    )


def _sized(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    """``_id, source, size, _key`` and ``more`` for every row of ``docs``, stored."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), *more)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))))
    return stored(rows.withColumn("_key", key), "mix-sizes")


def _taken(rows: DataFrame, weights: Sequence[float], share: float, most: float, bin_rows: int, *ties: str) -> DataFrame:
    """``rows`` of ``_sized`` with ``source_size, target, epochs, rest``; ``ties`` order rows equal in key, id and size."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    targets = source_targets(sums.drop("_rows"), weights, share, most).withColumnRenamed("source", "_source")
    bins = F.least(F.lit(1 << 20), F.greatest(F.lit(1), F.ceil(F.col("_rows") / bin_rows))).cast("long")
    plan = sums.select("source", bins.alias("_bins")).join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    budget = F.floor(F.col("target") + 1e-9).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = stored(plan.withColumn("epochs", epochs).withColumn("_rest", budget - epochs * F.col("source_size")), "mix-plan")

    at = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    p = plan.select(F.col("source").alias("_source"), "_bins", "source_size", "target", "epochs", "_rest")
    binned = rows.join(p, rows["source"].eqNullSafe(p["_source"])).drop("_source").withColumn("_bin", F.shiftrightunsigned(at * F.col("_bins"), 32))
    whole = binned.groupBy("source", "_bin").agg(F.sum("size").alias("_sum"))
    whole = whole.withColumn("_before", F.sum("_sum").over(W.partitionBy("source").orderBy("_bin")) - F.col("_sum")).select(F.col("source").alias("_source"), F.col("_bin").alias("_b"), "_before")
    binned = binned.join(whole, binned["source"].eqNullSafe(whole["_source"]) & (F.col("_bin") == F.col("_b"))).drop("_source", "_b")
    order = W.partitionBy("source", "_bin").orderBy("_key", F.col("_id").asc_nulls_last(), "size", *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.col("_before") + F.sum("size").over(order)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - (F.col("_end") - F.col("size"))))
    return binned.withColumn("_end", end).withColumn("rest", rest.cast("long"))


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    bin_rows: int = 1500,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` as the mix takes them: rows repeated or left out; columns unchanged.

    Whole documents only: the one document of a source that the cut falls in is taken whole. Rows
    without words cost nothing and stay once. Each row is taken by itself, under a number that is
    stored with it: ids may be null or repeated.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = _sized(docs, seed, id_col, text_col, source_col, F.monotonically_increasing_id().alias("_row"), whole)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs") + (F.col("rest") > 0).cast("int")).cast("int")
    mixed = _taken(rows.drop("_doc"), weights, share, most, bin_rows, "_row").select(F.col("_row").alias("_mixed"), times.alias("_times")).filter("_times > 0")
    joined = rows.select("_row", "_doc").join(mixed, F.col("_row") == F.col("_mixed"))
    return joined.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")
