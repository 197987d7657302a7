"""Rhythm features: compress, adaptive bands, transients, quantile normalisation, quantisation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .signal import moving_average


def log_compress(x: Column, most: float = 50.0) -> Column:
    return F.log1p(F.least(F.greatest(x, F.lit(0.0)), F.lit(most))) / F.log1p(F.lit(most))


def band_of(grid: DataFrame, bands: int) -> DataFrame:
    """``item, mel, band``: bins cut where cumulative mean energy reaches equal shares of the total.

    A band ends with the first bin that reaches its share; equal cuts leave a band empty. Sums are
    decimal, so both sides of a comparison are exact.
    """
    means = grid.groupBy("item", "mel").agg(F.round(F.avg("e"), 6).cast("decimal(38,6)").alias("m"))
    by = W.partitionBy("item")
    cum = means.withColumn("cum", F.sum("m").over(by.orderBy("mel"))).withColumn("total", F.sum("m").over(by))
    before = F.col("cum") - F.col("m")
    # a bin lies in band k if the bins before it reach k shares but not k + 1
    band = sum(((before * bands >= F.col("total") * k).cast("int") for k in range(1, bands)), F.lit(0))
    return cum.select("item", "mel", band.alias("band"))


def quantise(x: Column, levels: int) -> Column:
    """Half-even rounding to ``levels`` values in [0, 1]."""
    return F.rint(x * (levels - 1)) / (levels - 1)


def rhythm_features(grid: DataFrame, bands: int = 2, slow: int = 7, post: int = 3, q: float = 0.98, levels: int = 5) -> DataFrame:
    """``item, band, frame, value`` from ``item, mel, frame, e``; steps as in the module's title.

    Every band has all frames of its item; one without bins has zeros.
    """
    grid = grid.withColumn("e", F.round(log_compress(F.col("e")), 9))
    split = grid.join(band_of(grid, bands), ["item", "mel"])
    # one sum a band, so that a band without bins has zeros
    sums = [F.coalesce(F.sum(F.when(F.col("band") == k, F.col("e").cast("decimal(38,9)"))).cast("double"), F.lit(0.0)) for k in range(bands)]
    summed = split.groupBy("item", "frame").agg(F.array(*sums).alias("s")).select("item", "frame", F.posexplode("s").alias("band", "x"))
    rows = moving_average(summed, slow, ["item", "band"], "frame").withColumn("x", F.greatest(F.round(F.col("x") - F.col("ma"), 9), F.lit(0.0))).drop("ma")
    rows = moving_average(rows, post, ["item", "band"], "frame").select("item", "band", "frame", F.round("ma", 9).alias("x"))
    top = rows.groupBy("item", "band").agg(F.greatest(F.percentile("x", F.lit(q)), F.lit(1e-8)).alias("q"))
    scaled = F.least(F.round(F.col("x") / F.col("q"), 6), F.lit(1.0))
    return rows.join(top, ["item", "band"]).select("item", "band", "frame", quantise(scaled, levels).alias("value"))
