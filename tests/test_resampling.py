"""Resampling by blocks: against the sum over taps, and without rows for taps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import blocks, filters

RNG = np.random.RandomState(5)
SIGNALS = {1: RNG.normal(size=300), 2: RNG.normal(size=5), 3: RNG.normal(size=1), 4: RNG.normal(size=150)}
RATES = {1: (3, 2), 2: (2, 7), 3: (1, 3), 4: (5, 5)}


def brute(x, old, new, zeros=24, rolloff=0.945):
    if old == new:
        return list(x)
    band, out = min(old, new) * rolloff, []
    for t in range(len(x) * new // old):
        place, reach = t * old / new, zeros * old / band
        i = np.arange(math.ceil(place - reach), math.floor(place + reach) + 1)
        a = (i - place) * math.pi * band / old
        w = np.sinc(a / math.pi) * np.cos(a / (2 * zeros)) ** 2
        out.append((w * x[np.clip(i, 0, len(x) - 1)]).sum() / w.sum())
    return out


@pytest.mark.parametrize("width", [8, 8192])
def test_blocks_equal_sums_over_taps(spark, monkeypatch, width):
    monkeypatch.setattr(blocks, "BLOCK", width)
    df = spark.createDataFrame([(k, t, float(v)) for k, x in SIGNALS.items() for t, v in enumerate(x)], "k int, t int, x double")
    rates = spark.createDataFrame([(k, *r) for k, r in RATES.items()], "k int, old int, new int")
    lengths = df.groupBy("k").agg(F.count("*").alias("n"))
    for known in (None, lengths):
        got = filters.rate_changed_by(df, rates, ["k"], lengths=known).orderBy("k", "t").collect()
        for k, x in SIGNALS.items():
            assert [r.x for r in got if r.k == k] == pytest.approx(brute(x, *RATES[k]), abs=1e-9)


def test_no_row_is_made_for_a_tap(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).cast("int").alias("t"), F.lit(1.0).alias("x"))
    plan = filters.rate_changed(df, ["k"], 3, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # samples dealt to blocks


def test_no_row_is_made_for_a_tap_at_rates_by_key(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).cast("int").alias("t"), F.lit(1.0).alias("x"))
    rates = spark.createDataFrame([(0, 1, 2), (1, 3, 3)], "k long, old int, new int")
    plan = filters.rate_changed_by(df, rates, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Union" not in plan
