"""Framed transforms against whole-signal NumPy, with blocks of any size; images against arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import blocks, frames, images

RNG = np.random.RandomState(0)
SIGNALS = {1: RNG.randn(400), 2: RNG.randn(23) * 5, 3: np.sin(np.arange(300) / 5), 4: RNG.randn(1), 5: RNG.randn(2)}


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame([(k, t, float(x)) for k, v in SIGNALS.items() for t, x in enumerate(v)], "k int, t int, x double")


def by_key(df):
    out = {k: [] for k in SIGNALS}
    for r in df.orderBy("k", "t").collect():
        assert r.t == len(out[r.k])
        out[r.k].append(r.x)
    return {k: np.array(v) for k, v in out.items()}


def spectra(x, size, hop, window):
    n, period = len(x), max(2 * len(x) - 2, 1)
    at = np.arange(-(size // 2), n + size) % period
    padded = x[np.where(at < n, at, period - at)]
    return np.array([np.fft.rfft(padded[f * hop : f * hop + size] * window) for f in range((n - size % 2) // hop + 1)])


def inverse(s, size, hop, window, n):
    y, w = np.zeros((2, max(len(s) * hop + size, n + size)))
    for f, row in enumerate(s):
        y[f * hop : f * hop + size] += np.fft.irfft(row, size) * window
        w[f * hop : f * hop + size] += window**2
    return np.where(w > 1e-11, y / np.maximum(w, 1e-11), 0)[size // 2 :][:n]


def vocoded(x, num, den, size, hop):
    """The usual formula, with the advance that is expected of each bin."""
    window = frames.hann(size)
    s = spectra(x, size, hop, window)
    steps, padded = -(-len(s) * num // den), np.concatenate([s, np.zeros((2, s.shape[1]))])
    advance, phase, out = np.linspace(0, np.pi * hop, s.shape[1]), np.angle(s[0]), []
    for k in range(steps):
        i, rest = divmod(k * den, num)
        out.append((rest / num * abs(padded[i + 1]) + (1 - rest / num) * abs(padded[i])) * np.exp(1j * phase))
        turn = np.angle(padded[i + 1]) - np.angle(padded[i]) - advance
        phase = phase + turn - 2 * np.pi * np.round(turn / 2 / np.pi) + advance
    return inverse(np.array(out), size, hop, window, len(x) * num // den)


@pytest.fixture(params=[8192, 40])
def block(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", request.param)


@pytest.mark.parametrize("size,hop", [(16, 4), (9, 2)])
def test_spectra_and_their_inverse(signals, block, size, hop):
    s = frames.stft(signals, ["k"], size, hop)
    got = {}
    for r in s.collect():
        got.setdefault(r.k, {})[r.frame] = np.array(r.re) + 1j * np.array(r.im)
    for k, x in SIGNALS.items():
        expected = spectra(x, size, hop, frames.hann(size))
        assert sorted(got[k]) == list(range(len(expected)))
        assert all(np.allclose(got[k][f], row, atol=1e-9) for f, row in enumerate(expected))
    for k, x in by_key(frames.istft(s, ["k"], size, hop)).items():
        assert np.allclose(x, SIGNALS[k], atol=1e-9)


@pytest.mark.parametrize("num,den", [(3, 2), (2, 3), (1, 1)])
def test_stretch_equals_a_vocoder_over_the_whole_signal(signals, block, num, den):
    ratios = signals.select("k").distinct().withColumn("num", F.lit(num)).withColumn("den", F.lit(den))
    for k, x in by_key(frames.stretched(signals, ratios, ["k"], 16, 2)).items():
        expected = vocoded(SIGNALS[k], num, den, 16, 2)
        assert len(x) == len(expected) and np.allclose(x, expected, atol=1e-6)


def test_phase_and_pitch(signals, block):
    keys = signals.select("k").distinct()
    window = np.sqrt(frames.hann(16))
    for k, x in by_key(frames.phase_shifted(signals, keys.withColumn("shift", F.col("k") / 2), ["k"], 16, 4)).items():
        assert np.allclose(x, inverse(spectra(SIGNALS[k], 16, 4, window) * np.exp(0.5j * k), 16, 4, window, len(SIGNALS[k])), atol=1e-9)
    ratios = keys.withColumn("num", F.lit(3)).withColumn("den", F.lit(2))
    shifted = by_key(frames.pitch_shifted(signals, ratios, ["k"], 2048))
    assert {k: len(x) for k, x in shifted.items()} == {k: len(x) for k, x in SIGNALS.items()}
    peak = lambda x: np.argmax(abs(np.fft.rfft(x[50:250])))
    assert abs(peak(shifted[3]) - 1.5 * peak(SIGNALS[3])) <= 1 and abs(shifted[3]).max() <= 1 + 1e-12


def test_ends(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(3)], "k int, t int, x double").withColumn("n", F.lit(3))
    row = lambda ends: [x for _, x in sorted((r.t, r.x) for r in blocks.extended(df, F.lit(5), F.lit(4), ends).collect())]
    assert row("mirror") == [1, 0, 1, 2, 1, 0, 1, 2, 1, 0, 1, 2]
    assert row("ring") == [1, 2, 0, 1, 2, 0, 1, 2, 0, 1, 2, 0]
    assert row("hold") == [0] * 5 + [0, 1, 2] + [2] * 4
    assert row("zero") == [0, 1, 2]


def test_images(spark):
    bank = {(r.bin, r.band): r.weight for r in images.mel_bank(spark, 16000, 512, 20).collect()}
    assert all(w > 0 for w in bank.values()) and {b for _, b in bank} == set(range(20))
    assert max(sum((f, b) in bank for b in range(20)) for f in range(257)) == 2
    levels = spark.createDataFrame([(1, f, 0, 200 if 30 <= f < 60 else 1) for f in range(100)] + [(2, f, 0, 2) for f in range(20)], "k int, frame long, band int, level int")
    left = images.borders_stripped(levels, ["k"])
    assert sorted((r.k, r.n) for r in left.groupBy("k").agg(F.count("*").alias("n")).collect()) == [(1, 30), (2, 20)]
    ramp = spark.createDataFrame([(1, f, 0, 10 * f) for f in range(5)] + [(2, 0, 0, 7)], "k int, frame long, band int, level int")
    got = {}
    for r in images.resized(ramp, ["k"], 9).orderBy("frame").collect():
        got.setdefault(r.k, []).append(r.level)
    assert got == {1: [0, 5, 10, 15, 20, 25, 30, 35, 40], 2: [7] * 9}
