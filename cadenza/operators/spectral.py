"""Smoothing and circular convolution of signals ``keys, t, x``, all with the same numbers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import filtered, one_pole_sections, weighted


def one_pole(df: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """``keys, t, y``: y[t] = (1 - alpha) x[t] + alpha y[t-1], by its response over a power of two."""
    return filtered(df, one_pole_sections(F.lit(float(alpha))), keys).select(*keys, "t", "y")


def fft_convolve(df: DataFrame, keys: list[str], taps: list[float]) -> DataFrame:
    """``keys, t, y``: circular convolution at each signal's length; longer responses go round."""
    return weighted(df, (len(taps) - 1, 0), keys, lambda row: taps[::-1], ends="ring").select(*keys, "t", "y")
