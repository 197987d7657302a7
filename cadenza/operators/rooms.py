"""Recorded backgrounds and rooms as one step, and transforms that fire by chance.

Recordings are rows ``rec, t, x``, and ``info(rec, rate)`` has their rates. Excerpts meet recordings on blocks of time, so that one
that all items draw is read by as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..sources.tables import spread
from .bands import band_equalised, equalised_responses, with_direct_ratio
from .filters import rate_changed_by
from .items import mixed_at, responded

#: Samples of a recording that meet excerpts together.
BLOCK = 4096


def recorded(recordings: DataFrame, draws: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, t, x``: the ``count`` samples from ``first`` on of recording ``rec`` of each draw, or what there is; ``t`` counts from 0.

    Few draws become many samples, so these are dealt by key over tasks.
    """
    blocks = F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("count") - 1) / BLOCK))
    wanted = draws.filter("count > 0").select(*keys, "rec", "first", "count", F.explode(blocks).alias("_b"))
    rows = recordings.select("rec", "t", "x", F.floor(F.col("t") / BLOCK).alias("_b"))
    met = rows.join(wanted, ["rec", "_b"]).filter((F.col("t") >= F.col("first")) & (F.col("t") < F.col("first") + F.col("count")))
    return spread(met.select(*keys, (F.col("t") - F.col("first")).cast("int").alias("t"), "x"), *keys)


def background_added(df: DataFrame, draws: DataFrame, recordings: DataFrame, info: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """``keys, channel, t, y``: an excerpt of a recording, as long as the signal, at its rate and through bands, added at an SNR.

    ``df(keys, channel, t, x)``; ``draws(keys, rec, offset, snr, gains)``: seconds, dB, and an array of dB by band. Items without a draw,
    or whose recording is too short for the offset, get no noise. Excerpts' lengths follow from those of signals and recordings, so
    that no excerpt is made twice; samples are dealt by key over tasks before each step.
    """
    lengths = df.groupBy(*keys).agg((F.max("t") + 1).alias("_n"))
    ends = recordings.groupBy("rec").agg((F.max("t") + 1).alias("_end"))
    first = F.greatest(F.lit(0), F.floor(F.col("offset") * F.col("rate"))).cast("long")
    count = F.least(F.floor(F.col("_n") * F.col("rate") / rate), F.col("_end") - F.col("first"))
    asked = draws.join(info, "rec").join(ends, "rec").join(lengths, keys).withColumn("first", first).withColumn("count", count)
    cut = recorded(recordings, asked.select(*keys, "rec", "first", "count"), keys)
    rates = asked.select(*keys, F.col("rate").cast("int").alias("old"), F.lit(rate).alias("new"))
    level = spread(rate_changed_by(cut, rates, keys, lengths=asked.select(*keys, F.col("count").alias("n"))), *keys)
    told = asked.select(*keys, F.floor(F.col("count") * rate / F.col("rate").cast("int")).alias("n"))
    coloured = band_equalised(level, draws.select(*keys, "gains"), keys, rate, lengths=told).select(*keys, "t", F.col("y").alias("x"))
    quiet = lengths.select(*keys).join(draws.select(*keys, "snr"), keys, "left").fillna(0.0, ["snr"])
    return mixed_at(df, coloured, quiet, keys)


def room_applied(df: DataFrame, draws: DataFrame, recordings: DataFrame, info: DataFrame, keys: list[str], rate: int, seconds: float = 1.0) -> DataFrame:
    """``keys, t, y``: the signal in a recorded room, by ``draws(keys, rec, drr, gains)``; signals without one stay as they are.

    The first ``seconds`` of each response that is drawn are brought to the signals' rate once, then for each item go through
    its bands and get its direct-to-reverberant ratio.
    """
    used = draws.select("rec").distinct().join(info, "rec")
    cut = recorded(recordings, used.select("rec", F.lit(0).cast("long").alias("first"), F.floor(F.lit(seconds) * F.col("rate")).alias("count"), F.col("rec").alias("_r")), ["_r"])
    level = rate_changed_by(cut, used.select(F.col("rec").alias("_r"), F.col("rate").cast("int").alias("old"), F.lit(rate).alias("new")), ["_r"])
    arrays = level.groupBy(F.col("_r").alias("rec")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda e: e["x"]).alias("ir"))
    own = draws.join(arrays, "rec").select(*keys, "ir")
    shaped = with_direct_ratio(equalised_responses(own, draws.select(*keys, "gains"), keys, rate), draws.select(*keys, "drr"), keys, rate)
    wet = responded(df, shaped, keys)
    return df.select(*keys, "t", "x").join(wet, [*keys, "t"], "left").select(*keys, "t", F.coalesce("y", "x").alias("y"))


Step = Callable[[DataFrame], DataFrame]


def fired(df: DataFrame, keys: list[str], step: Step, share: float, seed: int | str) -> DataFrame:
    """``df`` with ``step`` done to the items that a draw of their key lets have it, a ``share`` of all. A step keeps the columns."""
    drawn = uniform(seed, *map(F.col, keys)) < share
    done = step(df.filter(drawn))
    return done.select(*df.columns).unionByName(df.filter(~drawn))


def composed(df: DataFrame, keys: list[str], steps: list[tuple[Step, float]], seed: int, share: float = 1.0) -> DataFrame:
    """Steps one after the other, each with its share of items, of the ``share`` of all that has any."""
    every = lambda d: reduce(lambda rows, s: fired(rows, keys, s[1][0], s[1][1], f"{seed}:{s[0]}"), enumerate(steps), d)
    return fired(df, keys, every, share, f"{seed}:all")


def chosen(df: DataFrame, keys: list[str], steps: list[Step], seed: int, weights: list[float] | None = None) -> DataFrame:
    """One of the steps for each item, by weight."""
    weights = [1.0] * len(steps) if weights is None else weights
    ends = [sum(weights[: i + 1]) / sum(weights) for i in range(len(weights))]
    at = uniform(seed, *map(F.col, keys))
    cut = lambda i: (at >= (ends[i - 1] if i else 0.0)) & ((at < ends[i]) if i + 1 < len(ends) else F.lit(True))
    return reduce(lambda a, b: a.unionByName(b), [step(df.filter(cut(i))).select(*df.columns) for i, step in enumerate(steps)])
