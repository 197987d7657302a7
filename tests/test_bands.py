"""Filter banks against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import bands
from cadenza.operators.filters import gaussian

RNG = np.random.RandomState(6)
SIGNALS = {1: RNG.randn(300), 2: RNG.randn(7)}


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame([(k, t, float(x)) for k, v in SIGNALS.items() for t, x in enumerate(v)], "k int, t int, x double")


def by_key(df, y="y"):
    out = {}
    for r in df.orderBy("k", "t").collect():
        out.setdefault(r.k, []).append(r[y])
    return {k: np.array(v) for k, v in out.items()}


def test_bands_at_no_gain_are_the_signal_and_gains_are_those_of_the_bands(spark, signals):
    keys = signals.select("k").distinct()
    for count in (1, 2, 6):
        flat = bands.band_equalised(signals, keys.withColumn("gains", F.array(*[F.lit(0.0)] * count)), ["k"], 44100.0)
        assert all(y == pytest.approx(SIGNALS[k], abs=1e-9) for k, y in by_key(flat).items())
    tone = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("t"), F.sin(F.col("id") * 0.2).alias("x"))
    edges = bands.band_edges(1000.0, 4)
    at = sum(0.2 / 2 / np.pi > e for e in edges)
    y = by_key(bands.band_equalised(tone, tone.select("k").distinct().withColumn("gains", F.array(*[F.lit(-60.0 if b != at else 6.0) for b in range(4)])), ["k"], 1000.0, zeros=40))[1]
    assert y[1000:3000] == pytest.approx(10**0.3 * np.sin(np.arange(1000, 3000) * 0.2), abs=0.03)


def test_direct_part_has_the_ratio_that_is_asked_for(spark):
    ir = RNG.randn(200) * np.exp(-np.arange(200) / 40)
    ir[20] = 8.0
    rows = spark.createDataFrame([(1, ir.tolist())], "k int, ir array<double>")
    got = np.array(bands.with_direct_ratio(rows, spark.createDataFrame([(1, 6.0)], "k int, drr double"), ["k"], 4000.0).first().ir)
    early = abs(np.arange(200) - 20) <= 10
    assert got[~early] == pytest.approx(ir[~early])
    assert 10 * np.log10((got[early] ** 2).sum() / (got[~early] ** 2).sum()) == pytest.approx(6.0, abs=1e-6)
    same = bands.equalised_responses(rows, spark.createDataFrame([(1, [0.0, 0.0])], "k int, gains array<double>"), ["k"], 4000.0).first().ir
    assert same == pytest.approx(ir, abs=1e-9)


def test_octave_responses_equal_filtered_noise(spark):
    rate, taps, n = 44100.0, 31, 25
    count = len(bands.octave_bands(rate))
    assert count == 12 and len(bands.octave_bands(8000.0)) == 9
    gains, decays, attacks = ([float(x) for x in RNG.uniform(0.001, 1, count)] for _ in range(3))
    attacks[0] = 0.0
    params = spark.createDataFrame([(1, (n - 0.5) / rate, gains, decays, attacks)], "k int, duration double, gains array<double>, decays array<double>, attacks array<double>")
    cells = spark.range(count).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("band")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n + taps - 2))))
    noise = np.zeros((count, n + taps - 1))
    for r in cells.select("band", "t", gaussian(9, F.col("k"), F.col("band"), F.col("t")).alias("x")).collect():
        noise[r.band, r.t] = r.x
    s, want = np.arange(n) / rate, np.zeros(n)
    for b, (low, high) in enumerate(bands.octave_bands(rate)):
        attack = np.minimum(s / attacks[b], 1) if attacks[b] else 1.0
        want += np.correlate(noise[b], bands.windowed_band(low, high, taps), "valid") * np.exp(-s / decays[b]) * attack * gains[b] / count
    assert bands.octave_responses(params, ["k"], rate, 9, taps).first().ir == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        bands.octave_responses(params, ["k"], rate, 9, 30)


def test_dry_mix_is_the_limited_signal(spark, signals):
    of = lambda v: F.array(*[F.lit(v)] * 12)
    params = signals.select("k").distinct().select("k", F.lit(0.001).alias("duration"), of(1.0).alias("gains"), of(0.1).alias("decays"), of(0.0).alias("attacks"), F.lit(0.0).alias("mix"))
    for k, y in by_key(bands.octave_reverb(signals, params, ["k"], 44100.0, 1, 31)).items():
        assert y == pytest.approx(SIGNALS[k] / max(1, abs(SIGNALS[k]).max()))
