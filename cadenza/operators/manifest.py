"""Manifests: paths, filters, splits, weighted picks, offsets."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import uniform
from .files import home_expanded
from .metrics import bounded


def full_path(path: Column, root: str) -> Column:
    """Trimmed path, a leading ``~`` expanded, under ``root`` unless absolute; blank stays blank."""
    p = home_expanded(F.trim(F.coalesce(path, F.lit(""))))
    return F.when(p == "", "").when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))


def strict(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which no wanted path is blank."""
    return df.filter(" AND ".join(f"coalesce({c}, '') <> ''" for c in columns))


def lenient(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows in which a wanted path is valid, with the least duration of the valid ones, if positive.

    ``columns`` maps path columns to duration columns; an unknown duration does not count.
    """
    known = [F.when(F.coalesce(F.col(p), F.lit("")) != "", F.col(d)) for p, d in columns.items()]
    least = F.array_min(F.array(*known))
    return df.withColumn("min_duration", least.cast("double")).filter("min_duration > 0")


def tag_filter(name: Column, wanted: Column, unwanted: list[str]) -> Column:
    """Some tag contains ``wanted`` and none contains any of ``unwanted``."""
    tags = F.split(F.lower(F.trim(name)), " ")
    return F.exists(tags, lambda t: F.contains(t, wanted)) & ~F.exists(tags, lambda t: t.rlike("|".join(unwanted)))


def proportional_split(df: DataFrame, key: str, shares: tuple[float, float, float], seed: int) -> DataFrame:
    """``split`` of each row: seeded order, floor(share * n) for train and val, the rest is test.

    Rows are ordered by bins of the hash with a prefix sum of bin counts, so no task sorts all rows; the
    number of bins follows the number of rows, up to 65,536.
    """
    if abs(sum(shares) - 1) > 1e-6:
        raise ValueError("shares must add up to 1")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    digits = 2 if df.count() < 1 << 24 else 4
    rows = df.withColumn("_h", h).withColumn("_bin", F.substring("_h", 1, digits))
    bins = rows.groupBy("_bin").agg(F.count("*").alias("_n"))
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(W.partitionBy()))
    ranked = rows.join(F.broadcast(bins), "_bin").withColumn("_r", F.row_number().over(W.partitionBy("_bin").orderBy("_h", key)) + F.col("_before"))
    train, val = (F.floor(F.lit(s) * F.col("_all")) for s in shares[:2])
    split = F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_h", "_bin", "_n", "_before", "_all", "_r")


def source_weights(sources: DataFrame, weight: str | None) -> DataFrame:
    """``w`` per source: clipped at 0 and divided by the sum; uniform if absent or all zero."""
    n = F.count("*").over(W.partitionBy())
    if weight is None:
        return sources.withColumn("w", 1.0 / n)
    clipped = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    total = F.sum(clipped).over(W.partitionBy())
    return sources.withColumn("w", F.when(total > 0, clipped / total).otherwise(1.0 / n))


def weighted_pick(draws: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """A source for each ``idx``, by a uniform in cumulative weights ``lo <= u < hi``; at most 10,000 sources, which is checked."""
    spans = sources.withColumn("hi", F.round(F.sum("w").over(W.orderBy("source")), 9)).withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("source")), F.lit(0.0)))
    return draws.withColumn("u", uniform(seed, F.col("idx"))).join(bounded(spans, 10_000), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))


def excerpt_offset(u: Column, file: Column, duration: float, rate: int) -> Column:
    """Uniform offset, 0 for files that are not longer, at most one sample before the last start."""
    room = file - duration
    return F.when(room <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(u * room, room - 1.0 / rate)))
