"""Filters by blocks against kernels over whole signals in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import blocks, filters, items, scan

RNG = np.random.RandomState(4)
SIGNALS = {1: RNG.randn(500), 2: RNG.randn(37) * 5, 3: RNG.randn(1), 4: np.zeros(20)}
SECTIONS = {1: [(0.2, 0.1, 0.05, -0.5, 0.2)], 2: [(1.2, -1.9, 0.8, -1.9, 0.95), (0.5, 0, 0, -0.5, 0)], 3: [(0.1, 0, 0, -0.99, 0)], 4: [(1.0, 0, 0, 0, 0)]}


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame([(k, t, float(x)) for k, v in SIGNALS.items() for t, x in enumerate(v)], "k int, t int, x double")


@pytest.fixture(params=[8192, 16])
def block(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", request.param)


def by_key(df, y="y"):
    out = {k: [] for k in SIGNALS}
    for r in df.orderBy("k", "t").collect():
        assert r.t == len(out[r.k])
        out[r.k].append(r[y])
    return {k: np.array(v) for k, v in out.items()}


def sampled(x, sections):
    """The product of the sections' responses at the points of a transform."""
    n = scan.period(len(x))
    response = np.ones(n // 2 + 1, complex)
    for b0, b1, b2, a1, a2 in sections:
        response *= np.fft.rfft([b0, b1, b2], n) / np.fft.rfft([1.0, a1, a2], n) if n > 2 else np.array([b0 + b2 + b1, b0 + b2 - b1]) / np.array([1 + a2 + a1, 1 + a2 - a1])
    return np.fft.irfft(np.fft.rfft(x, n) * response, n)[: len(x)]


def test_recursive_filters_equal_sampled_responses(spark, signals, block):
    # cascades of two pad those of one with a section that does nothing
    most = [[tuple(map(float, s)) for s in v] + [(1.0, 0.0, 0.0, 0.0, 0.0)] * (2 - len(v)) for v in SECTIONS.values()]
    params = spark.createDataFrame(list(zip(SECTIONS, [[list(s) for s in v] for v in most], strict=True)), "k int, sections array<array<double>>")
    for k, y in by_key(scan.filtered(signals, params, ["k"])).items():
        assert y == pytest.approx(sampled(SIGNALS[k], SECTIONS[k]), abs=1e-8)


@pytest.mark.parametrize("ends,pad", [("zero", "constant"), ("hold", "edge"), ("mirror", "reflect"), ("ring", "wrap")])
def test_finite_filters_equal_sums_over_padded_signals(spark, signals, block, ends, pad):
    taps = {k: RNG.randn(3 + 4 * k).tolist() for k in SIGNALS}
    params = spark.createDataFrame([(k, k, len(w) - 1 - k, w) for k, w in taps.items()], "k int, before int, after int, w array<double>")
    for k, y in by_key(scan.weighted(signals, params, ["k"], lambda row: row["w"], ends)).items():
        x = np.pad(SIGNALS[k], (k, len(taps[k]) - 1 - k), mode=pad)
        assert y == pytest.approx(np.correlate(x, taps[k], "valid"), abs=1e-9)


def test_a_long_signal_is_spread_over_blocks(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("t"), F.sin(F.col("id") / 50).alias("x"))
    y = scan.filtered(rows, scan.one_pole_sections(F.lit(0.999)), ["k"])
    got = np.zeros(n)
    for r in y.select("t", "y").toArrow().to_batches():
        got[r.column("t").to_numpy()] = r.column("y").to_numpy()
    want = sampled(np.sin(np.arange(n) / 50), [(0.001, 0, 0, -0.999, 0)])
    assert got == pytest.approx(want, abs=1e-8)
    assert rows.groupBy(F.floor(F.col("t") / blocks.BLOCK)).count().count() == 37


def test_band_pass_by_item(spark, signals):
    params = spark.createDataFrame([(k, 0.05 * k, 0.4) for k in SIGNALS], "k int, low double, high double")
    got = by_key(filters.bands_passed(signals, params, ["k"], 8), "x")
    for k in (1, 2):
        one = by_key(filters.band_passed(signals.filter(F.col("k") == k), ["k"], 0.05 * k, 0.4, 8), "x")
        assert got[k] == pytest.approx(one[k], abs=1e-9)
    with pytest.raises(Exception, match="low must be below high"):
        filters.bands_passed(signals, params.withColumn("low", F.lit(0.5)), ["k"]).collect()


def test_compressor_listens_to_a_side_chain(spark, signals):
    params = signals.select("k").distinct().select("k", *[F.lit(v).alias(n) for n, v in dict(threshold_db=-20.0, ratio=4.0, attack_ms=1.0, release_ms=5.0, knee_db=6.0, makeup_db=0.0).items()])
    two = signals.select("k", "t", "x", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel")).withColumn("x", F.col("x") * (1 + F.col("channel")))
    heard = items.side_chain(two, ["k"], "peak")
    got = items.compressed(two, params, ["k"], 1000.0, listen=heard)
    gains = items.compressor_gains(heard, params, ["k"], 1000.0)
    back = two.join(gains, ["k", "t"]).withColumn("w", F.col("x") * F.col("gain")).join(got, ["k", "channel", "t"])
    assert got.count() == two.count() and back.filter(F.abs(F.col("w") - F.col("y")) > 1e-12).count() == 0
