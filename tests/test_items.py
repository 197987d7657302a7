"""Files, and operators with parameters per item, against brute force in NumPy."""

import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import features, files, filters, items, layers
from cadenza.plans import items as queries

RNG = np.random.RandomState(0)
SIGNALS = {1: RNG.randn(40), 2: RNG.randn(23) * 5, 3: np.zeros(9)}


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame([(k, t, float(x)) for k, v in SIGNALS.items() for t, x in enumerate(v)], "k int, t int, x double")


def by_key(df):
    out = {}
    for r in df.orderBy("k", "t").collect():
        out.setdefault(r.k, []).append(r.y)
    return {k: np.array(v) for k, v in out.items()}


def test_files_and_manifests(spark, tmp_path):
    for name in ("b/x_mixture.wav", "a/Mixture.wav", "a/notes.txt"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        if name.endswith("wav"):
            with wave.open(str(tmp_path / name), "wb") as w:
                w.setparams((2, 2, 8000, 0, "NONE", ""))
                w.writeframes(np.array([[1, -1], [16384, 0], [0, 8192]], "<i2").tobytes())
        else:
            (tmp_path / name).write_text("no audio")
    (tmp_path / "b/broken.wav").write_text("no audio")
    found = [os.path.relpath(r.path.removeprefix("file:"), tmp_path) for r in files.scan_files(spark, str(tmp_path), "ixture.wav").collect()]
    assert found == ["a/Mixture.wav", "b/x_mixture.wav"]
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(str(tmp_path))
    info = {os.path.basename(r.path): (r.duration, r.sample_rate) for r in files.wav_info(content).collect()}
    assert info == {"Mixture.wav": (3 / 8000, 8000), "x_mixture.wav": (3 / 8000, 8000), "broken.wav": (None, None)}
    samples = files.wav_samples(content.filter(F.col("path").contains("x_mixture")))
    assert [(r.channel, r.t, r.x) for r in samples.orderBy("t", "channel").collect()][2:4] == [(0, 1, 0.5), (1, 1, 0.0)]

    rows = spark.createDataFrame([("p1", "train", 2.0), ("p2", "train", None), ("p3", "test", 1.0)], "path string, split string, duration double")
    files.write_split(rows, str(tmp_path / "m"), {"drums": F.col("path"), "duration": F.col("duration"), "rate": F.lit(8000)}, F.col("duration").isNotNull())
    files.write_split(rows.withColumn("bass", F.lit("b")), str(tmp_path / "n"), {"bass": F.col("bass")})
    read = files.read_manifests(spark, [str(tmp_path / "m/train.csv"), str(tmp_path / "n/test.csv")], ["drums", "bass"])
    got = sorted((r.source_idx, r.drums, r.bass, r.meta) for r in read.collect())
    assert got == [(0, "p1", None, {"duration": "2.0", "rate": "8000"}), (1, None, "b", None)]
    assert spark.read.option("header", True).csv(str(tmp_path / "m/val.csv")).count() == 0

    path = lambda c: rows.limit(1).select(c).first()[0]
    assert path(files.sibling(F.lit("a/b.c/mixture.x.wav"), F.lit("drums"))) == "a/b.c/drums.wav"
    assert path(files.sibling(F.lit("mixture"), F.lit("drums"))) == "drums"
    assert path(files.home_expanded(F.lit("~/x"))) == os.path.expanduser("~/x") and path(files.home_expanded(F.lit("~x"))) == "~x"
    with pytest.raises(Exception, match="not a split"):
        rows.select(files.named_split(F.lit("dev"))).collect()


def test_empty_bands_are_zero(spark):
    grid = spark.createDataFrame([("i", m, f, float(m == 3) * (1 + f % 5)) for m in range(4) for f in range(20)], "item string, mel int, frame int, e double")
    for bands in (1, 2, 4):
        got = features.rhythm_features(grid, bands=bands).collect()
        assert len(got) == bands * 20 and {r.band for r in got} == set(range(bands))
        full = {r.band for r in got if r.value > 0}
        assert len(full) == 1


def test_passes(spark, signals):
    params = spark.createDataFrame([(1, 0.2), (2, 0.05), (3, 0.0)], "k int, cutoff double")
    low, high = (by_key(items.passed(signals, params, ["k"], kind)) for kind in ("low", "high"))
    for k, cutoff in ((1, 0.2), (2, 0.05)):
        x, taps = SIGNALS[k], filters.sinc_taps(cutoff, 51)
        half = len(taps) // 2
        want = [sum(w * x[min(max(t + j - half, 0), len(x) - 1)] for j, w in enumerate(taps)) for t in range(len(x))]
        assert low[k] == pytest.approx(np.array(want), abs=1e-9) and high[k] == pytest.approx(x - want, abs=1e-9)
    assert not low[3].any()


def test_equaliser_is_its_sections_in_turn(spark, signals):
    bands = [("low_shelf", "a"), ("peaking", "b"), ("high_shelf", "c")]
    given = {"a": (6.0, 50.0, 0.7), "b": (-4.0, 200.0, 1.5), "c": (3.0, 10_000.0, 0.7)}
    cols = [F.lit(v).alias(f"{n}_{p}") for n, vs in given.items() for p, v in zip(("db", "hz", "q"), vs, strict=True)]
    params = signals.select("k").distinct().select("k", *cols)
    got = by_key(items.equalised(signals, params, ["k"], 1000.0, bands))
    # recursion sample by sample; frequency sampling wraps what is left of the ringing after twice the length
    from cadenza.operators.network import biquad

    sections = [tuple(signals.select(biquad(kind, F.lit(given[n][0]), F.lit(min(given[n][1], 499.5)), F.lit(given[n][2]), 1000.0).alias("s")).first().s) for kind, n in bands]
    want = SIGNALS[1].copy()
    for b0, b1, b2, a1, a2 in sections:
        x, y = want, np.zeros(len(want))
        for t in range(len(x)):
            y[t] = b0 * x[t] + (b1 * x[t - 1] - a1 * y[t - 1] if t else 0) + (b2 * x[t - 2] - a2 * y[t - 2] if t > 1 else 0)
        want = y
    assert got[1] == pytest.approx(want, abs=0.05 * np.abs(want).max())
    assert not got[3].any()


def test_responses(spark, signals):
    ir = [0.1, -0.5, 0.2]
    got = by_key(items.responded(signals, signals.select("k").distinct().withColumn("ir", F.array(*map(F.lit, ir))), ["k"]))
    for k in (1, 2):
        x = SIGNALS[k]
        n, turned = len(x), np.roll(np.array(ir + [0.0] * (len(x) - 3)), -1)
        y = np.array([sum(turned[j] * x[(t - j) % n] for j in range(n)) for t in range(n)])
        assert got[k] == pytest.approx(y / np.abs(y).max() * np.abs(x).max())
    params = spark.createDataFrame([(1, 0.5, 0.1, 0.2, 0.0), (2, 0.25, 0.0, 0.2, 1.0)], "k int, duration double, attack double, decay double, wet double")
    irs = {r.k: r.ir for r in items.noise_response(params, ["k"], 20.0, 3).collect()}
    assert irs[1] == [1.0] + [0.0] * 9 and len(irs[2]) == 5 and len({round(v, 9) for v in irs[2]}) == 5
    dry = by_key(items.responded(signals.filter("k = 1"), items.noise_response(params, ["k"], 20.0, 3), ["k"], from_peak=False))
    assert dry[1] == pytest.approx(SIGNALS[1])


def test_compressor_leaves_quiet_signals_and_checks_lookahead(spark, signals):
    params = signals.select("k").distinct().select("k", F.lit(60.0).alias("threshold_db"), F.lit(4.0).alias("ratio"), F.lit(1.0).alias("attack_ms"), F.lit(0.01).alias("release_ms"), F.lit(0.0).alias("knee_db"), F.lit(0.0).alias("makeup_db"))
    got = by_key(items.compressed(signals, params, ["k"], 1000.0))
    assert got[1] == pytest.approx(SIGNALS[1], rel=1e-6)
    moved = by_key(items.compressed(signals, params.withColumn("threshold_db", F.lit(-20.0)), ["k"], 1000.0, lookahead=100))
    assert moved[2] == pytest.approx(SIGNALS[2])  # all gains are those after the end


def test_arguments_are_checked(spark):
    one = spark.range(1)
    assert one.select(items.per_codebook(F.array(F.lit(3)), 2)).first()[0] == [3, 3]
    with pytest.raises(Exception, match="asked for"):
        one.select(items.per_codebook(F.array(F.lit(1), F.lit(2)), 3)).collect()
    with pytest.raises(Exception, match="one seed"):
        one.select(items.seeds(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), F.lit(3))).collect()
    assert items.factor_products(12) == [1, 2, 3, 4, 6, 12]


def test_transformer_block(spark):
    width, heads, n = 8, 2, 5
    x = RNG.randn(n, width)
    valid = np.array([True, True, False, True, True])
    w = {k: np.array(v) for k, v in queries.weights(width, 16).items()}
    rows = spark.createDataFrame([(1, i, [float(v) for v in x[i]], bool(valid[i])) for i in range(n)], "item int, pos int, x array<double>, valid boolean")
    got = np.array([r.x for r in layers.block(rows, queries.weights(width, 16), heads).orderBy("pos").collect()])
    norm = lambda v: v / np.sqrt((v * v).mean(-1, keepdims=True) + 1e-6)

    def turn(v):
        half = v.shape[-1] // 2
        angle = np.arange(n)[:, None] / 10000.0 ** (np.arange(half) / half)
        a, b = v[:, :half], v[:, half:]
        return np.concatenate([a * np.cos(angle) - b * np.sin(angle), b * np.cos(angle) + a * np.sin(angle)], 1)

    h, outs = norm(x), []
    for head in range(heads):
        s = slice(head * 4, head * 4 + 4)
        q, k, v = norm(turn((h @ w["q"].T)[:, s])), norm(turn((h @ w["k"].T)[:, s])), (h @ w["v"].T)[:, s]
        e = np.exp(q @ k.T / 2) * valid
        outs.append((e / e.sum(1, keepdims=True)) @ v * valid[:, None])
    y = x + np.concatenate(outs, 1) @ w["out"].T
    up = norm(y) @ w["up"].T
    y = y + (0.5 * up * (1 + np.tanh(np.sqrt(2 / np.pi) * (up + 0.044715 * up**3)))) @ w["down"].T
    assert got == pytest.approx(y)
