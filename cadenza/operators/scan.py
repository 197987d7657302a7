"""Recursive and finite filters of signals ``keys, t, x`` by blocks.

A recursive filter is an affine map of its state over a block. Blocks first find what they add to a state of
zero, the carries follow from these alone, and each block's output is that of a zero state plus the carry's. Filters
are those of a sampled response: circular over ``period(n)``, so the first carry is the one that comes back after it.
A finite filter is the product of spectra over a block and the samples that its taps reach (overlap-save).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import chunked, each_chunk, extended, filled, with_length


def period(n: int) -> int:
    """Length over which a response to ``n`` samples is sampled: a power of two, without overlap of the direct part."""
    return 1 << max(1, int(np.ceil(np.log2(max(2 * n - 1, 1)))))


class System:
    """A cascade of second-order sections (b0, b1, b2, a1, a2) as state' = A state + B x, y = C state + D x.

    ``gains[:, t]`` is A^t B, ``reads[t]`` C A^t and ``response`` the first ``width`` samples of the impulse response.
    """

    def __init__(self, flat: tuple[float, ...], width: int):
        size = 2 * (len(flat) // 5)
        self.a, b, unit = np.zeros((size, size)), np.zeros(size), np.eye(size)
        c, d = np.zeros(size), 1.0
        for i in range(0, size, 2):
            b0, b1, b2, a1, a2 = flat[5 * i // 2 : 5 * i // 2 + 5]
            c_out, d_out = b0 * c + unit[i], b0 * d
            self.a[i], b[i] = b1 * c - a1 * c_out + unit[i + 1], b1 * d - a1 * d_out
            self.a[i + 1], b[i + 1] = b2 * c - a2 * c_out, b2 * d - a2 * d_out
            c, d = c_out, d_out
        self.gains, reads, power = b[:, None], c[:, None], self.a
        while self.gains.shape[1] < width:
            self.gains = np.concatenate([self.gains, power @ self.gains], 1)
            reads = np.concatenate([reads, power.T @ reads], 1)
            power = power @ power
        self.gains, self.reads = self.gains[:, :width], reads[:, :width].T
        self.response = np.concatenate([[d], c @ self.gains])[:width]

    def final(self, x: np.ndarray) -> np.ndarray:
        """State after ``x``, from zero."""
        return self.gains[:, : len(x)][:, ::-1] @ x

    def output(self, x: np.ndarray, carry: np.ndarray) -> np.ndarray:
        size = 1 << int(np.ceil(np.log2(max(2 * len(x), 2))))
        direct = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(self.response[: len(x)], size), size)[: len(x)]
        return direct + self.reads[: len(x)] @ carry

    def carries(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """State at the start of each block, from what the blocks of ``counts`` samples add."""
        n = int(counts.sum())
        powers = {c: np.linalg.matrix_power(self.a, int(c)) for c in set(counts.tolist())}
        state = np.zeros(len(self.a))
        for s, c in zip(sums, counts.tolist(), strict=True):
            state = powers[c] @ state + s
        rest = np.linalg.matrix_power(self.a, period(n) - n)
        state = np.linalg.solve(np.eye(len(self.a)) - rest @ np.linalg.matrix_power(self.a, n), rest @ state)
        out = []
        for s, c in zip(sums, counts.tolist(), strict=True):
            out.append(state)
            state = powers[c] @ state + s
        return np.array(out)


@functools.lru_cache(8)
def system(flat: tuple[float, ...], width: int) -> System:
    return System(flat, width)


def filtered(df: DataFrame, params: DataFrame | Column, keys: list[str], x: str = "x") -> DataFrame:
    """``keys, t, x, y``: a cascade of second-order sections, arrays of b0, b1, b2, a1, a2.

    ``params`` has ``sections`` by key, or is that array of all signals.
    """
    width = blocks.BLOCK
    told = lambda rows: rows.withColumn("flat", F.flatten(params)) if isinstance(params, Column) else rows.join(params.select(*keys, F.flatten("sections").alias("flat")), keys)
    rows = with_length(df.select(*keys, F.col("t").cast("long").alias("t"), F.col(x).cast("double").alias("x")), keys)
    cut = chunked(rows, [*keys, "n"], F.lit(width), F.lit(0), F.lit(0), F.floor((F.col("n") - 1) / width))
    cut = told(cut)
    of = lambda row: system(tuple(row["flat"].tolist()), width)
    samples = lambda row: filled(row["ts"], row["xs"], row["chunk"] * width, min(width, row["n"] - row["chunk"] * width))

    def sums(row: dict) -> dict:
        x = samples(row)
        return {"count": [len(x)], "sum": of(row).final(x)[None]}

    def carries(row: dict) -> dict:
        order = np.argsort(row["chunks"])
        sums = row["sums"].reshape(len(order), -1)[order]
        return {"chunk": row["chunks"][order], "carry": of(row).carries(sums, row["counts"][order])}

    def output(row: dict) -> dict:
        x = samples(row)
        t = row["chunk"] * width + np.arange(len(x))
        return {"t": t, "x": x, "y": of(row).output(x, row["carry"])}

    added = told(each_chunk(cut, [*keys, "chunk"], sums, "count long, sum array<double>"))
    # a few numbers for each block of a signal
    of_signal = added.groupBy(*keys, "flat").agg(F.collect_list(F.struct("chunk", "count", "sum")).alias("s"))
    of_signal = of_signal.select(*keys, "flat", F.col("s.chunk").alias("chunks"), F.col("s.count").alias("counts"), F.flatten("s.sum").alias("sums"))
    starts = each_chunk(of_signal, keys, carries, "chunk long, carry array<double>")
    out = each_chunk(cut.join(starts, [*keys, "chunk"]), keys, output, "t long, x double, y double")
    return out.withColumn("t", F.col("t").cast("int"))


def one_pole_sections(alpha: Column) -> Column:
    """Sections of y[t] = (1 - alpha) x[t] + alpha y[t - 1]."""
    return F.array(F.array(1 - alpha, F.lit(0.0), F.lit(0.0), -alpha, F.lit(0.0)))


def weighted(df: DataFrame, params: DataFrame | tuple[int, int], keys: list[str], taps: Callable[[dict], np.ndarray], ends: str = "hold", lengths: DataFrame | None = None) -> DataFrame:
    """``keys, t, x, y``: y[t] adds up x[t - before + j] * taps[j].

    ``params(keys, before, after, ...)`` has the reach of the taps by key, or is that of all signals. ``taps`` gets
    a block's row, with the parameters (numbers, texts, arrays of doubles), and gives before + after + 1 numbers. ``ends``
    are as in ``blocks.extended``. Blocks are as long as the taps reach at least. ``lengths(keys, n)`` spares a pass over
    signals of known lengths.
    """
    rows = df.select(*keys, "t", F.col("x").cast("double").alias("x"))
    rows = with_length(rows, keys) if lengths is None else rows.join(lengths.select(*keys, F.col("n").cast("long").alias("n")), keys)
    reach = [F.col(c).cast("long").alias(c) for c in ("before", "after")]
    if isinstance(params, tuple):
        more, rows = [], rows.withColumns({c: F.lit(n).cast("long") for c, n in zip(("before", "after"), params, strict=True)})
    else:
        more, rows = [c for c in params.columns if c not in (*keys, "before", "after")], rows.join(params.select(*keys, *reach), keys)
    rows = extended(rows, F.col("before"), F.col("after"), ends).withColumn("width", F.greatest(F.lit(blocks.BLOCK), F.col("before") + F.col("after")))
    cut = chunked(rows, [*keys, "n", "width", "before", "after"], F.col("width"), F.col("before"), F.col("after"), F.floor((F.col("n") - 1) / F.col("width")))
    if more:
        cut = cut.join(params.select(*keys, *more), keys)

    def kernel(row: dict) -> dict:
        start, before, after = row["chunk"] * row["width"], row["before"], row["after"]
        count = min(row["width"], row["n"] - start)
        x = filled(row["ts"], row["xs"], start - before, row["width"] + before + after)[: count + before + after]
        w = np.asarray(taps(row), float)
        size = 1 << int(np.ceil(np.log2(max(len(x), 2))))
        y = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(w, size)), size)[:count]
        return {"t": start + np.arange(count), "x": x[before : before + count], "y": y}

    return each_chunk(cut, keys, kernel, "t long, x double, y double").withColumn("t", F.col("t").cast("int"))
