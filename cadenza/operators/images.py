"""Images of signals: mel bands of power spectra in decibels, as grey levels.

Spectra are rows ``keys, frame, re, im`` (arrays), as ``frames.stft`` gives them.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The mel scale: linear up to 1000 Hz in steps of 200/3 Hz, then 27 mels for each factor of 6.4. Fixed values.
HZ_PER_MEL, BREAK_HZ, BREAK_MEL, LOG_STEP = 200 / 3, 1000.0, 15.0, math.log(6.4) / 27


def to_mel(hz: float) -> float:
    return hz / HZ_PER_MEL if hz < BREAK_HZ else BREAK_MEL + math.log(hz / BREAK_HZ) / LOG_STEP


def to_hz(mel: Column) -> Column:
    return F.when(mel < BREAK_MEL, mel * HZ_PER_MEL).otherwise(BREAK_HZ * F.exp(LOG_STEP * (mel - BREAK_MEL)))


def mel_bank(spark: SparkSession, rate: int, size: int, bands: int) -> DataFrame:
    """``bin, band, weight``: triangles of unit area between neighbouring centres that are even in mels, up to half the rate.

    A bin lies in two bands at most, so the bank has about two rows a bin.
    """
    edge = lambda k: to_hz((F.col("id") + k) * (to_mel(rate / 2) / (bands + 1)))
    triangles = spark.range(bands).select(F.col("id").cast("int").alias("band"), edge(0).alias("_a"), edge(1).alias("_b"), edge(2).alias("_c"))
    bins = spark.range(size // 2 + 1).select(F.col("id").cast("int").alias("bin"), (F.col("id") * F.lit(rate) / size).alias("_hz"))
    both = triangles.join(bins, (F.col("_hz") > F.col("_a")) & (F.col("_hz") < F.col("_c")))
    slope = F.least((F.col("_hz") - F.col("_a")) / (F.col("_b") - F.col("_a")), (F.col("_c") - F.col("_hz")) / (F.col("_c") - F.col("_b")))
    return both.select("bin", "band", (slope * 2 / (F.col("_c") - F.col("_a"))).alias("weight"))


def mel_power(spectra: DataFrame, bank: DataFrame, keys: list[str], bands: int) -> DataFrame:
    """``keys, frame, band, power`` of every frame and band; bands without bins have no power."""
    power = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    cells = spectra.select(*keys, "frame", F.posexplode(power).alias("bin", "p")).join(bank, "bin")
    sums = cells.groupBy(*keys, "frame", "band").agg(F.sum(F.col("weight") * F.col("p")).alias("power"))
    every = spectra.select(*keys, "frame", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    return every.join(sums, [*keys, "frame", "band"], "left").fillna(0.0, ["power"])


def grey_levels(power: DataFrame, keys: list[str], span_db: float = 80.0, least: float = 1e-10) -> DataFrame:
    """``keys, frame, band, level``: 0 to 255 for ``span_db`` below an item's largest power up to it."""
    top = power.groupBy(*keys).agg(F.greatest(F.max("power"), F.lit(least)).alias("_top"))
    db = 10 * F.log10(F.greatest("power", F.lit(least))) - 10 * F.log10("_top")
    level = F.floor(F.round(255 * (F.greatest(db, F.lit(-span_db)) + span_db) / span_db, 6)).cast("int")
    return power.join(top, keys).select(*keys, "frame", "band", level.alias("level"))


def borders_stripped(levels: DataFrame, keys: list[str], threshold: int = 2, fewest: int = 8) -> DataFrame:
    """Levels without the frames before the first and after the last that exceed ``threshold``, counted from 0.

    Items of which fewer than ``fewest`` frames, or a tenth of them, would be left (or none) stay whole.
    """
    frames = levels.groupBy(*keys, "frame").agg(F.max("level").alias("_m"))
    loud = F.when(F.col("_m") > threshold, F.col("frame"))
    ends = frames.groupBy(*keys).agg(F.min(loud).alias("_a"), F.max(loud).alias("_b"), F.count("*").alias("_w"))
    left = F.coalesce(F.col("_b") - F.col("_a") + 1, F.lit(0))
    whole = (left < F.least(F.lit(fewest), F.floor(F.col("_w") / 10))) | (left == 0)
    ends = ends.select(*keys, F.when(whole, 0).otherwise(F.col("_a")).alias("_a"), F.when(whole, F.col("_w") - 1).otherwise(F.col("_b")).alias("_b"))
    return levels.join(ends, keys).filter("frame between _a and _b").withColumn("frame", F.col("frame") - F.col("_a")).drop("_a", "_b")


def resized(levels: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Levels of ``width`` frames (over 1), linear between the two nearest of an item's; the first and last stay in place."""
    sizes = levels.groupBy(*keys).agg((F.max("frame") + 1).alias("_w"))
    place = F.col("_x") * (F.col("_w") - 1) / (width - 1)
    slots = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_x")).withColumn("_p", place)
    low = F.floor("_p")
    pair = F.array(F.struct(low.alias("frame"), (1 - (F.col("_p") - low)).alias("share")), F.struct((low + 1).alias("frame"), (F.col("_p") - low).alias("share")))
    slots = slots.select(*keys, "_x", F.explode(pair).alias("s")).select(*keys, "_x", "s.*").filter("share > 0")
    sums = slots.join(levels, [*keys, "frame"]).groupBy(*keys, "band", F.col("_x").alias("frame")).agg(F.sum(F.col("share") * F.col("level")).alias("_l"))
    return sums.select(*keys, "frame", "band", F.floor(F.round("_l", 6)).cast("int").alias("level"))


def mel_image(spectra: DataFrame, keys: list[str], rate: int, size: int, bands: int, width: int) -> DataFrame:
    """``keys, row, col, level``: a picture of ``bands`` rows, high bands first, and ``width`` columns for each item."""
    bank = mel_bank(spectra.sparkSession, rate, size, bands)
    levels = borders_stripped(grey_levels(mel_power(spectra, bank, keys, bands), keys), keys)
    return resized(levels, keys, width).select(*keys, (bands - 1 - F.col("band")).alias("row"), F.col("frame").alias("col"), "level")
