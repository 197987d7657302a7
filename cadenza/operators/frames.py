"""Framed transforms of signals ``keys, t, x``: spectra, their inverse, phase and pitch shifts.

Frames are centred: frame f begins at f * hop - size // 2, and ends are mirrored by size // 2 samples, so that
there are 1 + (n - size % 2) // hop frames.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks
from .blocks import chunked, each_chunk, extended, filled, with_length
from .filters import rate_changed_by
from .levels import peak_limited

def hann(size: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def _spectra(row: dict, size: int, hop: int, width: int, window: np.ndarray, frames: int) -> np.ndarray:
    """Spectra of the first ``frames`` frames of a block."""
    x = filled(row["ts"], row["xs"], row["chunk"] * width - size // 2, width + size + hop)
    cut = np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:frames]
    return np.fft.rfft(cut * window, axis=1)


def _blocks(df: DataFrame, keys: list[str], size: int, hop: int, width: int, more: int = 0, ends: str = "mirror") -> DataFrame:
    """Blocks of samples of the frames that begin in them, and of ``more`` frames beyond."""
    half, after = F.lit(size // 2), max(0, size - size // 2 + (more - 1) * hop)
    rows = extended(with_length(df, keys), half, half, ends)
    last = F.floor(F.floor((F.col("n") - size % 2) / hop) * hop / width)
    return chunked(rows, [*keys, "n"], F.lit(width), half, F.lit(after), last)


def stft(df: DataFrame, keys: list[str], size: int, hop: int, window: np.ndarray | None = None, ends: str = "mirror") -> DataFrame:
    """``keys, n, frame, re, im``: spectra of all frames, under the Hann window unless given another; ``ends`` as in ``extended``."""
    window = hann(size) if window is None else window
    per = max(1, blocks.BLOCK // hop)

    def kernel(row: dict) -> dict:
        first = row["chunk"] * per
        count = min(per, (row["n"] - size % 2) // hop + 1 - first)
        s = _spectra(row, size, hop, per * hop, window, count)
        return {"frame": np.arange(first, first + count), "re": s.real, "im": s.imag}

    return each_chunk(_blocks(df, keys, size, hop, per * hop, ends=ends), [*keys, "n"], kernel, "frame long, re array<double>, im array<double>")


def _overlapped(spectra: np.ndarray, first: int, hop: int, window: np.ndarray, length: int) -> dict:
    """Sums of windowed frames, and of the squared window, at the times from 0 to ``length`` that they reach."""
    size, count = len(window), len(spectra)
    frames = np.fft.irfft(spectra, size, axis=1) * window
    y, w = np.zeros((2, (count - 1) * hop + size))
    square = window * window
    for i in range(count):
        y[i * hop : i * hop + size] += frames[i]
        w[i * hop : i * hop + size] += square
    start = first * hop - size // 2
    a, b = max(0, -start), max(0, min(len(y), length - start))
    return {"t": np.arange(start + a, start + max(a, b)), "y": y[a : max(a, b)], "w": w[a : max(a, b)]}


def _added_up(parts: DataFrame, keys: list[str]) -> DataFrame:
    sums = parts.groupBy(*keys, "t").agg(F.sum("y").alias("_y"), F.sum("w").alias("_w"))
    return sums.select(*keys, F.col("t").cast("int").alias("t"), F.when(F.col("_w") > 1e-11, F.col("_y") / F.col("_w")).otherwise(0.0).alias("x"))


def istft(spectra: DataFrame, keys: list[str], size: int, hop: int, window: np.ndarray | None = None) -> DataFrame:
    """``keys, t, x``: signals of ``n`` samples from their ``frame, re, im``, overlapping frames weighted by the window.

    Frames are added up by blocks, and what blocks share at their borders by time.
    """
    window = hann(size) if window is None else window
    per = max(1, blocks.BLOCK // hop)
    pieces = spectra.groupBy(*keys, "n", F.floor(F.col("frame") / per).alias("chunk")).agg(F.collect_list(F.struct("frame", "re", "im")).alias("rows"))
    pieces = pieces.select(*keys, "n", "chunk", F.col("rows.frame").alias("frames"), F.flatten("rows.re").alias("re"), F.flatten("rows.im").alias("im"))

    def kernel(row: dict) -> dict:
        first, bins = row["chunk"] * per, size // 2 + 1
        s = np.zeros((row["frames"].max() - first + 1, bins), complex)
        s[row["frames"] - first] = (row["re"] + 1j * row["im"]).reshape(-1, bins)
        return _overlapped(s, first, hop, window, row["n"])

    return _added_up(each_chunk(pieces, keys, kernel, "t long, y double, w double"), keys)


def phase_shifted(df: DataFrame, shifts: DataFrame, keys: list[str], size: int, hop: int) -> DataFrame:
    """``keys, t, x``: every bin turned by ``shift`` radians of its key, under the root of the Hann window."""
    window = np.sqrt(hann(size))
    s = stft(df, keys, size, hop, window).join(shifts.select(*keys, "shift"), keys)
    turned = lambda a, b, sign: F.zip_with(a, b, lambda p, q: p * F.cos("shift") + sign * q * F.sin("shift"))
    return istft(s.select(*keys, "n", "frame", turned("re", "im", -1).alias("re"), turned("im", "re", 1).alias("im")), keys, size, hop, window)


def stretched(df: DataFrame, ratios: DataFrame, keys: list[str], size: int, hop: int) -> DataFrame:
    """``keys, t, x``: signals num / den times as long at the same pitch, by a phase vocoder; ``ratios(keys, num, den)``.

    Step k of the result lies between frames i = k den // num and i + 1, its magnitude is interpolated; its
    phase advances as from i to i + 1 (which turns that are expected of a bin do not change, as whole turns
    vanish). Advances are summed within blocks first, then by bin over the blocks' sums, and each block starts
    from what that gives. Beyond the last frame there is silence.
    """
    window, per, bins = hann(size), max(1, blocks.BLOCK // hop), size // 2 + 1
    width = per * hop
    pieces = _blocks(df, keys, size, hop, width, 1).join(ratios.select(*keys, "num", "den"), keys)

    def steps(row: dict):
        """First step of the block, its spectra's magnitudes, and the phases before and after each step."""
        first, frames, num, den = row["chunk"] * per, (row["n"] - size % 2) // hop + 1, row["num"], row["den"]
        low = -(-first * num // den)
        high = -(-min(first + per, frames) * num // den)
        s = _spectra(row, size, hop, width, window, per + 1)
        s[max(0, frames - first) :] = 0
        if len(s) < per + 1:
            s = np.concatenate([s, np.zeros((per + 1 - len(s), bins))])
        i, rest = np.divmod(np.arange(low, high) * den, num)
        a, b = s[i - first], s[i - first + 1]
        share = (rest / num)[:, None]
        phases = np.zeros((high - low + 1, bins))
        if not first:
            phases[0] = np.angle(s[0])
        phases[1:] = np.cumsum(np.angle(b) - np.angle(a), axis=0) + phases[0]
        return low, share * np.abs(b) + (1 - share) * np.abs(a), phases

    def totals(row: dict) -> dict:
        return {"bin": np.arange(bins), "total": np.remainder(steps(row)[2][-1], 2 * np.pi)}

    def synthesis(row: dict) -> dict:
        low, magnitude, phases = steps(row)
        if not len(magnitude):
            return {"t": [], "y": [], "w": []}
        if row["start"] is not None:
            phases = phases + row["start"]
        return _overlapped(magnitude * np.exp(1j * phases[:-1]), low, hop, window, row["n"] * row["num"] // row["den"])

    sums = each_chunk(pieces, [*keys, "chunk"], totals, "bin long, total double")
    before = F.sum("total").over(W.partitionBy(*keys, "bin").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(*keys, "chunk", "bin", before.alias("start")).filter("start is not null")
    starts = starts.groupBy(*keys, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "start"))), lambda b: b["start"]).alias("start"))
    return _added_up(each_chunk(pieces.join(starts, [*keys, "chunk"], "left"), keys, synthesis, "t long, y double, w double"), keys)


def pitch_shifted(df: DataFrame, ratios: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """``keys, t, x``: signals with all frequencies times num / den, at their length, then the peak limit.

    Stretched by a vocoder with frames of a 64th of a second, resampled back, and cut or filled with zeros.
    """
    size = max(2, rate // 64)
    long = stretched(df, ratios, keys, size, max(1, size // 32))
    rates = ratios.select(*keys, F.lit(rate).alias("old"), F.greatest(F.lit(1), F.rint(rate * F.col("den") / F.col("num")).cast("int")).alias("new"))
    lengths = df.groupBy(*keys).agg(F.count("*").alias("n")).join(ratios.select(*keys, "num", "den"), keys)
    back = rate_changed_by(long, rates, keys, lengths=lengths.select(*keys, F.floor(F.col("n") * F.col("num") / F.col("den")).alias("n")))
    whole = df.select(*keys, F.col("t").cast("int").alias("t")).join(back, [*keys, "t"], "left").fillna(0.0, ["x"])
    return peak_limited(whole, keys)
