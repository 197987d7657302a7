"""Windowed-sinc filters of signals in long layout ``keys, t, x``; cutoffs are shares of the sample rate."""

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from . import blocks
from .blocks import chunked, each_chunk, filled, with_length
from .levels import peak_limited, snr_mixed
from .scan import weighted


def hz_quantised(hz: Column, step: float) -> Column:
    """Frequency on a grid of ``step``; a step of zero or less leaves it."""
    return hz if step <= 0 else F.rint(hz / step) * step


@functools.lru_cache(64)
def sinc_taps(cutoff: float, zeros: float = 51) -> list[float]:
    """Low-pass taps: a sinc with ``zeros`` zero crossings under a Hann window, with sum 1."""
    half = reach(cutoff, zeros)
    at = [2 * math.pi * cutoff * k for k in range(-half, half + 1)]
    taps = [(math.sin(a) / a if a else 1.0) * (0.5 + 0.5 * math.cos(math.pi * k / half) if half else 1.0) for a, k in zip(at, range(-half, half + 1), strict=True)]
    total = sum(taps)
    return [w / total for w in taps]


def reach(cutoff: float, zeros: float) -> int:
    return int(zeros / cutoff / 2)


def low_passed(df: DataFrame, keys: list[str], cutoff: float, zeros: float = 51) -> DataFrame:
    """``keys, t, x`` without what lies above ``cutoff``, held to [0, 1/2]; 0 leaves nothing. Ends are held.

    ``t`` counts from 0 without gaps. Work goes by blocks of samples, by way of their spectra.
    """
    return _passed(df, keys, cutoff, zeros).select(*keys, "t", F.col("y").alias("x"))


def high_passed(df: DataFrame, keys: list[str], cutoff: float, zeros: float = 51) -> DataFrame:
    """Signal less its low pass."""
    return _passed(df, keys, cutoff, zeros).select(*keys, "t", (F.col("x") - F.col("y")).alias("x"))


def _passed(df: DataFrame, keys: list[str], cutoff: float, zeros: float) -> DataFrame:
    cutoff = min(max(cutoff, 0.0), 0.5)
    if cutoff == 0:
        return df.select(*keys, "t", "x", F.lit(0.0).alias("y"))
    half = reach(cutoff, zeros)
    return weighted(df, (half, half), keys, lambda row: sinc_taps(cutoff, zeros))


def passed(df: DataFrame, params: DataFrame, keys: list[str], zeros: float = 51) -> DataFrame:
    """``keys, t, x, y``: the signal and its low pass at ``cutoff`` of each key, as in ``low_passed``."""
    cutoff = F.least(F.greatest(F.col("cutoff").cast("double"), F.lit(0.0)), F.lit(0.5))
    half = F.when(F.col("cutoff") > 0, (F.lit(float(zeros)) / F.col("cutoff") / 2).cast("long")).otherwise(0)
    held = params.select(*keys, cutoff.alias("cutoff")).select(*keys, "cutoff", half.alias("before"), half.alias("after"))
    return weighted(df, held, keys, lambda row: sinc_taps(row["cutoff"], zeros) if row["cutoff"] else [0.0])


def band_passed(df: DataFrame, keys: list[str], low: float, high: float, zeros: float = 51) -> DataFrame:
    """High pass at ``low``, low pass at ``high``, then the peak limit."""
    in_order(low, high)
    return peak_limited(low_passed(high_passed(df, keys, low, zeros), keys, high, zeros), keys)


def bands_passed(df: DataFrame, params: DataFrame, keys: list[str], zeros: float = 51) -> DataFrame:
    """``band_passed`` at ``low, high`` of each key; a pair out of order is an error."""
    wrong = F.raise_error(F.lit("low must be below high")).cast("double")
    cut = lambda c: params.select(*keys, F.when(F.col("low") < F.col("high"), F.col(c)).otherwise(wrong).alias("cutoff"))
    high = passed(df, cut("low"), keys, zeros).select(*keys, "t", (F.col("x") - F.col("y")).alias("x"))
    return peak_limited(passed(high, cut("high"), keys, zeros).select(*keys, "t", F.col("y").alias("x")), keys)


def in_order(low: float, high: float) -> None:
    """A range's ends; ValueError unless the first is the smaller."""
    if low >= high:
        raise ValueError("low must be below high")


def rate_changed(df: DataFrame, keys: list[str], old: int, new: int, zeros: int = 24, rolloff: float = 0.945) -> DataFrame:
    """``keys, t, x`` at rate ``new`` instead of ``old``, as in ``rate_changed_by``; equal rates leave the signal."""
    if old == new:
        return df.select(*keys, "t", "x")
    return _resampled(with_length(df.select(*keys, "t", "x"), keys).withColumns({"old": F.lit(old).cast("long"), "new": F.lit(new).cast("long")}), keys, zeros, rolloff)


def rate_changed_by(df: DataFrame, rates: DataFrame, keys: list[str], zeros: int = 24, rolloff: float = 0.945, lengths: DataFrame | None = None) -> DataFrame:
    """``keys, t, x`` at rate ``new`` instead of ``old`` of ``rates(keys, old, new)``, by windowed-sinc interpolation; ends are held.

    A signal of n samples gets n * new // old. The sinc has ``zeros`` crossings on either side under
    a squared cosine, and its weights add up to 1 at each output. Equal rates leave the signal. ``t`` counts from 0 without
    gaps. Work is the outputs times the crossings, by blocks of samples, so a long signal spreads and only its samples
    move. ``lengths(keys, n)`` spares a pass over signals of known lengths.
    """
    rows = df.select(*keys, "t", "x")
    rows = with_length(rows, keys) if lengths is None else rows.join(lengths.select(*keys, F.col("n").cast("long").alias("n")), keys)
    both = rows.join(rates.select(*keys, F.col("old").cast("long").alias("old"), F.col("new").cast("long").alias("new")), keys)
    return _resampled(both, keys, zeros, rolloff)


def _resampled(rows: DataFrame, keys: list[str], zeros: int, rolloff: float) -> DataFrame:
    """Outputs of signals ``keys, t, x, n, old, new`` by blocks."""
    reach = F.ceil(F.col("old") * float(zeros) / (F.least("old", "new") * rolloff)) + 1
    rows = rows.select(*keys, F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"), "n", "old", "new", reach.alias("reach"))
    rows = rows.withColumn("width", F.greatest(F.lit(blocks.BLOCK), 2 * F.col("reach")))
    cut = chunked(rows, [*keys, "n", "old", "new", "reach", "width"], F.col("width"), F.col("reach"), F.col("reach"), F.floor((F.col("n") - 1) / F.col("width")))

    def kernel(row: dict) -> dict:
        n, old, new, start, reach = row["n"], row["old"], row["new"], row["chunk"] * row["width"], row["reach"]
        x = filled(row["ts"], row["xs"], start - reach, row["width"] + 2 * reach)
        # outputs whose place lies in the block
        t = np.arange(-(-start * new // old), min(-(-(start + row["width"]) * new // old), n * new // old))
        if old == new:
            return {"t": t, "x": x[t - start + reach]}
        band = min(old, new) * rolloff
        most = zeros * old / band
        taps = np.arange(int(2 * most) + 2)
        y = np.empty(len(t))
        per = max(1, (1 << 18) // len(taps))
        for a in range(0, len(t), per):
            place = t[a : a + per] * old / new
            i = np.ceil(place - most).astype(int)[:, None] + taps
            off = i - place[:, None]
            angle = off * (band / old)
            w = np.where(abs(off) <= most, np.sinc(angle) * np.cos(angle * (np.pi / (2 * zeros))) ** 2, 0.0)
            y[a : a + per] = (w * x[np.clip(i, 0, n - 1) - start + reach]).sum(1) / w.sum(1)
        return {"t": t, "x": y}

    return each_chunk(cut, keys, kernel, "t long, x double").withColumn("t", F.col("t").cast("int"))


def gaussian(seed: int, *keys: Column) -> Column:
    """Standard normal draw of a key, from two hashed uniforms. Draws depend on seed and key only."""
    return F.sqrt(-2 * F.log(F.greatest(uniform(seed, *keys), F.lit(1e-9)))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))


def noise_added(df: DataFrame, keys: list[str], snr: float, seed: int) -> DataFrame:
    """``y``: the signal and white noise at ``snr`` dB. The noise is seeded by ``keys`` and ``t``."""
    noise = df.select(*keys, "t", gaussian(seed, *map(F.col, keys), F.col("t")).alias("x"))
    return snr_mixed(df, noise, keys, snr)
