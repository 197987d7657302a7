"""Filter banks: mel-spaced equaliser bands that add up to the signal, octave bands of noise for reverberation."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .filters import gaussian
from .items import mixed_at, responded
from .levels import peak_limited
from .scan import weighted

#: Centres of octave bands in Hz, and the edges of what lies below and above them. Fixed values.
OCTAVES = (31.5, 63, 125, 250, 500, 1000, 2000, 4000, 8000, 16000)
LOWEST, HIGHEST = 12.0, 18000.0


def band_edges(rate: float, bands: int) -> list[float]:
    """Edges between ``bands`` bands that are even in mels (2595 log10(1 + f / 700)) up to half the rate, as shares of it."""
    top = 2595 * math.log10(1 + rate / 1400)
    return [700 * (10 ** (top * k / bands / 2595) - 1) / rate for k in range(1, bands)]


def band_reach(rate: float, bands: int, zeros: float) -> int:
    """Taps on either side: those of the lowest edge, for all."""
    return int(zeros / band_edges(rate, bands)[0] / 2) if bands > 1 else 0


@functools.lru_cache(256)
def band_taps(rate: float, gains: tuple[float, ...], zeros: float) -> np.ndarray:
    """Taps of all bands at their gains (linear): a band is the difference of the low passes at its edges, the last is what is left.

    With equal gains only the middle tap is not zero, so the bands add up to the signal.
    """
    half = band_reach(rate, len(gains), zeros)
    k = np.arange(-half, half + 1)
    taps = np.where(k == 0, gains[-1], 0.0)
    window = 0.5 + 0.5 * np.cos(np.pi * k / max(half, 1))
    for edge, low, high in zip(band_edges(rate, len(gains)), gains, gains[1:], strict=False):
        one = np.sinc(2 * edge * k) * window
        taps = taps + (low - high) * one / one.sum()
    return taps


def band_equalised(df: DataFrame, params: DataFrame, keys: list[str], rate: float, zeros: float = 8, lengths: DataFrame | None = None) -> DataFrame:
    """``keys, t, x, y``: mel-spaced bands at ``gains`` (array of dB, as many as bands) of ``params`` by key. Ends are held.

    One finite filter stands for all bands; zero gains leave the signal. ``lengths(keys, n)`` as in ``weighted``.
    """
    bands = F.size("gains")
    lowest = 700 * (F.pow(F.lit(10.0), F.lit(math.log10(1 + rate / 1400)) / bands) - 1) / rate
    reach = F.when(bands > 1, (F.lit(float(zeros)) / lowest / 2).cast("long")).otherwise(0)
    linear = F.transform("gains", lambda g: F.pow(F.lit(10.0), g / 20))
    held = params.select(*keys, linear.alias("gains"), reach.alias("before"), reach.alias("after"))

    def taps(row: dict) -> np.ndarray:
        found = band_taps(rate, tuple(row["gains"].tolist()), zeros)
        off = row["before"] - len(found) // 2  # the reach by the engine's logarithm may differ by one
        return np.pad(found, off) if off >= 0 else found[-off:off]

    return weighted(df, held, keys, taps, lengths=lengths)


def equalised_noise_added(df: DataFrame, params: DataFrame, keys: list[str], rate: float, seed: int) -> DataFrame:
    """``keys, channel, t, y``: white noise through the bands of ``params(keys, gains, snr)``, added at ``snr`` dB of each key."""
    times = df.select(*keys, "t").distinct()
    noise = times.select(*keys, "t", gaussian(seed, *map(F.col, keys), F.col("t")).alias("x"))
    coloured = band_equalised(noise, params.select(*keys, "gains"), keys, rate).select(*keys, "t", F.col("y").alias("x"))
    return mixed_at(df, coloured, params.select(*keys, "snr"), keys)


def equalised_responses(responses: DataFrame, params: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """``keys, ir``: responses of sample arrays through the bands of ``params(keys, gains)``."""
    rows = responses.select(*keys, F.posexplode("ir").alias("t", "x"))
    y = band_equalised(rows, params, keys, rate)
    return y.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda e: e["y"]).alias("ir"))


def with_direct_ratio(responses: DataFrame, params: DataFrame, keys: list[str], rate: float, seconds: float = 0.0025) -> DataFrame:
    """``keys, ir``: the direct part scaled so that its energy lies ``drr`` dB over the rest's, by key.

    The direct part reaches ``seconds`` to either side of the peak (the first of equals), under a Hann
    window that goes over to the rest; it is scaled by the positive root of the quadratic that the energies give.
    """
    half = int(seconds * rate)
    peaks = responses.select(*keys, "ir", (F.array_position(F.transform("ir", lambda v: F.abs(v)), F.array_max(F.transform("ir", lambda v: F.abs(v)))) - 1).alias("_p"))
    off = F.abs(F.col("t") - F.col("_p"))
    window = F.when(off <= half, 0.5 + 0.5 * F.cos(math.pi * off / max(half, 1))).otherwise(0.0)
    early = off <= half
    rows = peaks.select(*keys, "_p", F.posexplode("ir").alias("t", "x")).withColumn("_w", window)
    w, x = F.col("_w"), F.col("x")
    total = lambda c: F.sum(F.when(early, c).otherwise(0.0))
    sums = rows.groupBy(*keys).agg(total(F.pow(w * x, 2)).alias("_a"), total(2 * w * (1 - w) * x * x).alias("_b"), total(F.pow((1 - w) * x, 2)).alias("_c"), F.sum(F.when(early, 0.0).otherwise(x * x)).alias("_late"))
    wanted = F.pow(F.lit(10.0), F.col("drr") / 10) * F.col("_late")
    root = (-F.col("_b") + F.sqrt(F.greatest(F.pow("_b", F.lit(2.0)) - 4 * F.col("_a") * (F.col("_c") - wanted), F.lit(0.0)))) / (2 * F.greatest("_a", F.lit(1e-20)))
    scaled = rows.join(sums.join(params.select(*keys, "drr"), keys).select(*keys, root.alias("_g")), keys)
    y = F.when(early, F.col("_g") * w * x + (1 - w) * x).otherwise(x)
    return scaled.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", y.alias("y")))), lambda e: e["y"]).alias("ir"))


def octave_bands(rate: float) -> list[tuple[float, float]]:
    """(low, high) of the bands as shares of half the rate; those that begin beyond it are left out."""
    half = rate / 2
    bands = [(0.0, LOWEST / half)] + [(c / math.sqrt(2) / half, min(c * math.sqrt(2) / half, 0.999)) for c in OCTAVES] + [(HIGHEST / half, 1.0)]
    return [b for b in bands if b[0] < min(b[1], 0.999)]


@functools.lru_cache(256)
def windowed_band(low: float, high: float, count: int) -> np.ndarray:
    """``count`` taps of a band under a Hamming window, with a gain of one at its middle (at 0 or half the rate if it reaches there)."""
    m = np.arange(count) - (count - 1) / 2
    taps = (high * np.sinc(high * m) - low * np.sinc(low * m)) * np.hamming(count)
    middle = 0.0 if low == 0 else 1.0 if high == 1 else (low + high) / 2
    return taps / (taps * np.cos(np.pi * m * middle)).sum()


def octave_responses(params: DataFrame, keys: list[str], rate: float, seed: int, taps: int = 1023) -> DataFrame:
    """``keys, ir``: noise in octave bands, each under its own attack, decay and gain, meaned over bands.

    ``params(keys, duration, gains, decays, attacks)``: seconds, and arrays with a number for each of ``octave_bands``.
    The noise is seeded by key, band and time.
    """
    if taps % 2 == 0:
        raise ValueError("an odd number of taps")
    bands = octave_bands(rate)
    length = F.greatest(F.lit(1), F.ceil(F.greatest("duration", F.lit(0.0)) * rate).cast("int"))
    each = params.select(*keys, length.alias("_n"), F.posexplode(F.arrays_zip("gains", "decays", "attacks")).alias("band", "p")).filter(F.col("band") < len(bands))
    own = [*keys, "band"]
    # dealt before a band becomes samples; what follows by key and band stays where it is
    each = spread(each.select(*keys, "_n", "band", "p.*"), *own)
    noise = each.select(*own, F.explode(F.sequence(F.lit(0), F.col("_n") + taps - 2)).alias("t"))
    noise = noise.select(*own, "t", gaussian(seed, *map(F.col, own), F.col("t")).alias("x"))
    filtered = weighted(noise, (0, taps - 1), own, lambda row: windowed_band(*bands[row["band"]], taps), "zero")
    rows = filtered.join(each, own).filter(F.col("t") < F.col("_n"))
    s = F.col("t") / rate
    attack = F.when(F.col("attacks") <= 1e-8, 1.0).otherwise(F.least(s / F.col("attacks"), F.lit(1.0)))
    shaped = F.col("y") * F.exp(-s / F.greatest("decays", F.lit(1e-8))) * attack * F.greatest("gains", F.lit(0.0))
    sums = rows.groupBy(*keys, "t").agg((F.sum(shaped) / len(bands)).alias("x"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda e: e["x"]).alias("ir"))


def octave_reverb(df: DataFrame, params: DataFrame, keys: list[str], rate: float, seed: int, taps: int = 1023) -> DataFrame:
    """``keys, t, y``: the signal in a room of ``octave_responses``, mixed with the dry one by ``mix`` of each key, peaks limited."""
    wet = responded(df, octave_responses(params, keys, rate, seed, taps), keys, from_peak=False)
    mix = F.least(F.greatest("mix", F.lit(0.0)), F.lit(1.0))
    both = df.select(*keys, "t", "x").join(wet, [*keys, "t"]).join(params.select(*keys, mix.alias("_m")), keys)
    return peak_limited(both.select(*keys, "t", ((1 - F.col("_m")) * F.col("x") + F.col("_m") * F.col("y")).alias("x")), keys).withColumnRenamed("x", "y")
