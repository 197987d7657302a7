"""Recorded backgrounds and rooms, and transforms by chance, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import items, rooms

RNG = np.random.RandomState(12)
SIGNALS = {k: RNG.randn(60) / 3 for k in range(4)}
RECORDINGS = {10: RNG.randn(500), 11: RNG.randn(30)}


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame([(k, 0, t, float(x)) for k, v in SIGNALS.items() for t, x in enumerate(v)], "k int, channel int, t int, x double")


@pytest.fixture(scope="module")
def recordings(spark):
    rows = spark.createDataFrame([(k, t, float(x)) for k, v in RECORDINGS.items() for t, x in enumerate(v)], "rec int, t int, x double")
    return rows, spark.createDataFrame([(10, 100), (11, 100)], "rec int, rate int")


def by_key(df, y="y"):
    out = {}
    for r in df.orderBy("k", "t").collect():
        out.setdefault(r.k, []).append(r[y])
    return {k: np.array(v) for k, v in out.items()}


def test_background_is_an_excerpt_at_its_level(spark, signals, recordings, monkeypatch):
    monkeypatch.setattr(rooms, "BLOCK", 16)
    draws = spark.createDataFrame([(0, 10, 1.0, 6.0, [0.0]), (1, 10, 4.7, 0.0, [0.0]), (2, 11, 9.0, 0.0, [0.0])], "k int, rec int, offset double, snr double, gains array<double>")
    got = by_key(rooms.background_added(signals, draws, *recordings, ["k"], 100))
    for k, rec, first, snr in ((0, 10, 100, 6.0), (1, 10, 470, 0.0), (2, 11, 900, 0.0), (3, 11, 900, 0.0)):
        x, noise = SIGNALS[k], np.zeros(60)
        part = RECORDINGS[rec][first : first + 60]
        noise[: len(part)] = part
        level = lambda v: 10 * np.log10((v * v).mean() + 1e-8)
        y = x + np.sqrt(10 ** ((level(x) - level(noise) - snr) / 10)) * noise
        assert got[k] == pytest.approx(y / max(1, abs(y).max()), abs=1e-9)


def test_room_is_a_circular_convolution(spark, signals, recordings):
    draws = spark.createDataFrame([(0, 11, 3.0, [0.0])], "k int, rec int, drr double, gains array<double>")
    got = by_key(rooms.room_applied(signals, draws, *recordings, ["k"], 100))
    assert got[1] == pytest.approx(SIGNALS[1])
    ir = RECORDINGS[11].copy()
    peak = np.argmax(abs(ir))  # at this rate the direct part is one sample
    ir[peak] = np.sign(ir[peak]) * np.sqrt(10**0.3 * (np.delete(ir, peak) ** 2).sum())
    padded = np.zeros(60)
    padded[:30] = ir
    y = np.fft.irfft(np.fft.rfft(SIGNALS[0]) * np.fft.rfft(np.roll(padded, -np.argmax(abs(ir)))), 60)
    assert got[0] == pytest.approx(y * abs(SIGNALS[0]).max() / abs(y).max(), abs=1e-9)


def test_steps_fire_for_their_share(spark):
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit(0.0).alias("x"))
    plus = lambda n: (lambda d: d.withColumn("x", F.col("x") + n))
    got = [r.x for r in rooms.composed(rows, ["k"], [(plus(1), 0.5), (plus(10), 1.0)], 3, 0.8).collect()]
    shares = [sum(x == v for x in got) / 2000 for v in (0, 10, 11)]
    assert shares == pytest.approx([0.2, 0.4, 0.4], abs=0.05) and sum(shares) == pytest.approx(1)
    one = [r.x for r in rooms.chosen(rows, ["k"], [plus(1), plus(2), plus(3)], 4, [1, 2, 1]).collect()]
    assert [sum(x == v for x in one) / 2000 for v in (1, 2, 3)] == pytest.approx([0.25, 0.5, 0.25], abs=0.05)


def test_excerpts_are_made_once_and_dealt_by_key(spark, signals, recordings):
    draws = spark.createDataFrame([(k, 10, 1.0, 6.0, [0.0, 3.0]) for k in range(4)], "k int, rec int, offset double, snr double, gains array<double>")
    rows = rooms.background_added(signals, draws, *recordings, ["k"], 100)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # rate and bands
    assert plan.count("RepartitionByExpression [k") == 3  # excerpts, at the new rate, and with the signals
    assert len({r.p for r in rows.select(F.spark_partition_id().alias("p")).collect()}) > 1


def test_noise_is_mixed_with_all_channels(spark):
    x, n = RNG.randn(2, 30) / 9, RNG.randn(40)
    signal = spark.createDataFrame([(1, c, t, float(x[c, t])) for c in range(2) for t in range(30)] + [(2, 0, 0, 0.5), (3, 0, 0, 0.5)], "k int, channel int, t int, x double")
    noise = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(n) if t % 5], "k long, t long, x double")
    snrs = spark.createDataFrame([(1, 3.0), (2, 3.0)], "k int, snr double")
    mixed = items.mixed_at(signal, noise, snrs, ["k"])
    assert mixed.dtypes == [("k", "int"), ("channel", "int"), ("t", "int"), ("y", "double")]
    got = {(r.k, r.channel, r.t): r.y for r in mixed.collect()}
    n = np.where(np.arange(30) % 5, n[:30], 0.0)
    level = lambda v: 10 * np.log10((v * v).mean() + 1e-8)
    y = x + np.sqrt(10 ** ((level(x.mean(0)) - level(n) - 3.0) / 10)) * n
    y = y / np.maximum(1, abs(y).max(1))[:, None]
    assert got == pytest.approx({(1, c, t): y[c, t] for c in range(2) for t in range(30)} | {(2, 0, 0): 0.5}, abs=1e-9)
