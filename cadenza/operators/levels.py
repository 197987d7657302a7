"""Levels, mixing and alignment of signals in long layout ``keys, t, x``."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .signal import energy, snr_gain


def downmix(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over channels at each time."""
    return df.groupBy(*keys, "t").agg(F.avg("x").alias("x"))


def peak_limited(df: DataFrame, keys: list[str], most: float = 1.0) -> DataFrame:
    """Signals whose peak exceeds ``most`` are scaled down to it; others stay."""
    peak = F.max(F.abs("x")).over(W.partitionBy(*keys))
    return df.withColumn("x", F.when(peak > most, F.col("x") / peak * most).otherwise(F.col("x")))


def volume_normalised(df: DataFrame, keys: list[str], target_db: float, eps: float = 1e-8) -> DataFrame:
    """Gain to a root mean square of ``target_db`` (mean squares count as ``eps`` at least), then the peak limit."""
    rms = F.sqrt(F.greatest(F.avg(F.col("x") * F.col("x")).over(W.partitionBy(*keys)), F.lit(eps)))
    return peak_limited(df.withColumn("x", F.col("x") * 10.0 ** (target_db / 20) / rms), keys)


def snr_mixed(signal: DataFrame, noise: DataFrame, keys: list[str], snr: float) -> DataFrame:
    """``y``: signal plus noise at ``snr`` dB. Noise is cut or filled with zeros to the signal's length."""
    both = signal.join(noise.select(*keys, "t", F.col("x").alias("_n")), [*keys, "t"], "left").fillna(0.0, ["_n"])
    gains = both.groupBy(*keys).agg(snr_gain(energy(F.col("x")), energy(F.col("_n")), snr).alias("_g"))
    return both.join(gains, keys).withColumn("y", F.col("x") + F.col("_g") * F.col("_n")).drop("_n", "_g")


def energy_matched(df: DataFrame, keys: list[str], before: str, after: str, clamp: float | None = None) -> DataFrame:
    """``after`` scaled to the energy of ``before``; the gain lies in [1/clamp, clamp]."""
    if clamp is not None and clamp <= 0:
        raise ValueError("clamp must be positive")
    each = W.partitionBy(*keys)
    level = lambda c: F.avg(F.col(c) * F.col(c)).over(each) + 1e-8
    gain = F.sqrt(level(before) / F.greatest(level(after), F.lit(1e-8)))
    if clamp is not None:
        gain = F.least(F.greatest(gain, F.lit(1 / clamp)), F.lit(float(clamp)))
    return df.withColumn(after, F.col(after) * gain)


def rolled_to_peak(df: DataFrame, keys: list[str]) -> DataFrame:
    """Circular shift that brings the largest magnitude (the first of equals) to time 0."""
    each = W.partitionBy(*keys)
    peak = -F.max(F.struct(F.abs("x").alias("a"), (-F.col("t")).alias("t"))).over(each)["t"]
    return df.withColumn("t", F.pmod(F.col("t") - peak, F.count("*").over(each)).cast("int"))


def looked_ahead(df: DataFrame, keys: list[str], steps: int, x: str = "x") -> DataFrame:
    """A gain moved ``steps`` earlier; the tail is 1."""
    return df.withColumn(x, F.lead(x, steps, 1.0).over(W.partitionBy(*keys).orderBy("t")))


def standardised(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sigmoid of the standard score (sample deviation)."""
    each = W.partitionBy(*keys)
    z = (F.col("x") - F.avg("x").over(each)) / F.greatest(F.stddev_samp("x").over(each), F.lit(1e-8))
    return df.withColumn("y", 1 / (1 + F.exp(-z)))


def border_trimmed(df: DataFrame, keys: list[str], quiet: float) -> DataFrame:
    """Without the quiet ends. Where fewer than min(8, n // 10) columns would stay, all stay."""
    each = W.partitionBy(*keys)
    loud = F.when(F.col("x") > quiet, F.col("t"))
    n = F.count("*").over(each)
    rows = df.withColumn("_a", F.min(loud).over(each)).withColumn("_b", F.max(loud).over(each)).withColumn("_n", n)
    whole = F.col("_a").isNull() | (F.col("_b") - F.col("_a") + 1 < F.least(F.lit(8), F.floor(F.col("_n") / 10)))
    return rows.filter(whole | F.col("t").between(F.col("_a"), F.col("_b"))).drop("_a", "_b", "_n")


def aligned_excerpts(df: DataFrame, stems: list[str], starts: DataFrame, length: int) -> DataFrame:
    """``item, stem, t, x`` for ``length`` samples of every stem from one start per item.

    ``df(item, stem, t, x)``, ``starts(item, start)``. A missing sample or stem is zero.
    """
    slots = starts.select("item", "start", F.explode(F.array(*[F.lit(s) for s in stems])).alias("stem"))
    slots = slots.select("item", "stem", F.posexplode(F.sequence(F.col("start"), F.col("start") + length - 1)).alias("_i", "t"))
    return slots.join(df.select("item", "stem", "t", "x"), ["item", "stem", "t"], "left").select("item", "stem", F.col("_i").alias("t"), F.coalesce("x", F.lit(0.0)).alias("x"))


def resampled(df: DataFrame, keys: list[str], width: int, linear: bool = False) -> DataFrame:
    """Every signal on ``width`` times: the nearest earlier sample, or between two (half-sample centres)."""
    slots = df.groupBy(*keys).agg(F.count("*").alias("_n")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_t"))
    if not linear:
        at = slots.withColumn("t", F.floor(F.col("_t") * F.col("_n") / width).cast("int"))
        return at.join(df, [*keys, "t"]).select(*keys, F.col("_t").alias("t"), "x")
    place = F.greatest((F.col("_t") + 0.5) * F.col("_n") / width - 0.5, F.lit(0.0))
    share = F.col("_p") - F.floor("_p")
    ends = F.array(F.struct(F.floor("_p").cast("int").alias("t"), (1 - share).alias("w")), F.struct(F.least(F.floor("_p") + 1, F.col("_n") - 1).cast("int").alias("t"), share.alias("w")))
    at = slots.withColumn("_p", place).select(*keys, "_t", F.explode(ends).alias("_e")).select(*keys, "_t", "_e.*")
    return at.join(df, [*keys, "t"]).groupBy(*keys, F.col("_t").alias("t")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))
