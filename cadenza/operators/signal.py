"""Signals in long layout ``signal_id, t, x``: windows, levels, delays, mixing, convolution."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def moving_average(df: DataFrame, width: int, keys: list[str], t: str = "t", x: str = "x", out: str = "ma") -> DataFrame:
    """Centred mean over ``width`` samples with reflected edges (the edge sample is not repeated).

    Edge rows are mirrored and given times beyond the ends, then one frame covers all rows; no row
    outside the edges moves. Width 1 or less is the identity. Needs at least ``width // 2 + 1``
    samples per signal and times 0, 1, 2, ...
    """
    if width <= 1:
        return df.withColumn(out, F.col(x))
    left, right = (width - 1) // 2, width // 2
    ends = df.withColumn("_last", F.max(t).over(W.partitionBy(*keys)))
    ends = ends.withColumn("_real", F.lit(True))
    low = ends.filter((F.col(t) >= 1) & (F.col(t) <= left)).withColumn(t, -F.col(t)).withColumn("_real", F.lit(False))
    high = ends.filter((F.col(t) < F.col("_last")) & (F.col(t) >= F.col("_last") - right)).withColumn(t, 2 * F.col("_last") - F.col(t)).withColumn("_real", F.lit(False))
    frame = W.partitionBy(*keys).orderBy(t).rowsBetween(-left, right)
    return ends.unionByName(low).unionByName(high).withColumn(out, F.sum(x).over(frame) / width).filter("_real").drop("_real", "_last")


def rms_db(x: Column, eps: float = 1e-12) -> Column:
    """Level of a group in dB, with a floor."""
    return 20 * F.log10(F.greatest(F.sqrt(F.avg(x * x) + eps), F.lit(eps)))


def decibels(x: Column) -> Column:
    """Level of a magnitude in dB; that of silence is minus infinity and that of a negative number NaN, where the engine's logarithm is null."""
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(20 * F.log10(x))


def energy(x: Column) -> Column:
    return F.avg(x * x) + 1e-8


def delay(df: DataFrame, d: int, feedback: float, taps: int, mix: float, keys: list[str]) -> DataFrame:
    """Dry signal and ``taps`` echoes, the k-th of gain feedback**k and k * d samples late.

    One pass of window lags over a sorted signal; no join.
    """
    order = W.partitionBy(*keys).orderBy("t")
    wet = sum((F.coalesce(F.lag("x", k * d).over(order), F.lit(0.0)) * feedback**k for k in range(1, taps + 1)), F.lit(0.0))
    return df.withColumn("y", (1 - mix) * F.col("x") + mix * wet)


def snr_gain(signal: Column, noise: Column, snr: float) -> Column:
    """Gain of the noise that makes the ratio of energies ``snr`` dB."""
    level = lambda e: 10 * F.log10(e)
    return F.sqrt(F.pow(F.lit(10.0), (level(signal) - level(noise) - snr) / 10))


def convolve(df: DataFrame, taps: list[float], keys: list[str]) -> DataFrame:
    """Circular convolution with a short response, by lags that wrap around."""
    each = W.partitionBy(*keys)
    n = F.count("*").over(each)
    spread = df.withColumn("_n", n).select(*keys, "_n", "t", "x", F.posexplode(F.array(*[F.lit(float(v)) for v in taps])).alias("_k", "_h"))
    return spread.groupBy(*keys, F.pmod(F.col("t") + F.col("_k"), F.col("_n")).cast("int").alias("t")).agg(F.sum(F.col("x") * F.col("_h")).alias("y"))


def compressor_db(level: Column, threshold: float, ratio: float, knee: float) -> Column:
    """Output level of a soft-knee compressor; the knee counts only if it is positive."""
    over = level - threshold
    hard = F.when(over > 0, threshold + over / ratio).otherwise(level)
    if knee <= 0:
        return hard
    soft = level + (1 / ratio - 1) * F.pow(over + knee / 2, 2) / (2 * knee)
    return F.when(F.abs(over) * 2 <= knee, soft).otherwise(hard)
