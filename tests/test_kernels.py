import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import levels, network, scan


def samples(spark, values, key=1):
    return spark.createDataFrame([(key, t, float(x)) for t, x in enumerate(values)], "k int, t int, x double")


def listed(df, column):
    return [r[column] for r in df.orderBy("t").collect()]


def test_the_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True, timeout=120)


def test_snr_of_equal_energies(spark):
    got = levels.snr_mixed(samples(spark, [1, -1, 1, -1]), samples(spark, [1, 1, 1, 1]), ["k"], 20.0)
    assert listed(got, "y") == pytest.approx([1.1, -0.9, 1.1, -0.9])


def test_short_noise_is_filled_with_zeros(spark):
    got = listed(levels.snr_mixed(samples(spark, [1, 1, 1, 1]), samples(spark, [1]), ["k"], 0.0), "y")
    assert got == pytest.approx([3.0, 1.0, 1.0, 1.0])


def test_volume_is_limited_at_the_peak(spark):
    assert max(listed(levels.volume_normalised(samples(spark, [0, 0, 0, 5]), ["k"], 20.0), "x")) == pytest.approx(1.0)


def test_roll_takes_the_first_of_equal_peaks(spark):
    assert listed(levels.rolled_to_peak(samples(spark, [1, -3, 2, 3]), ["k"]), "x") == [-3, 2, 3, 1]


def test_border_trim_keeps_all_where_little_is_loud(spark):
    assert listed(levels.border_trimmed(samples(spark, [0, 0, 9, 0, 9, 0]), ["k"], 1.0), "x") == [9, 0, 9]
    assert levels.border_trimmed(samples(spark, [0] * 50 + [9] + [0] * 50), ["k"], 1.0).count() == 101
    assert levels.border_trimmed(samples(spark, [0] * 5), ["k"], 1.0).count() == 5


@pytest.mark.parametrize("width, want", [(4, [0, 1, 2, 3]), (2, [0.5, 2.5]), (8, [0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3])])
def test_linear_resample(spark, width, want):
    assert listed(levels.resampled(samples(spark, range(4)), ["k"], width, linear=True), "x") == pytest.approx(want)


def test_energy_clamp_must_be_positive(spark):
    with pytest.raises(ValueError):
        levels.energy_matched(samples(spark, [1]), ["k"], "x", "x", 0.0)


def test_residual_codes_of_a_code_leave_nothing(spark):
    frames = spark.createDataFrame([(0, [0.0, 2.0])], "frame long, v array<double>")
    book = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 2.0])], "code long, c array<double>")
    row = network.residual_codes(frames, [book, book]).first()
    assert row.codes == [6, 5] and row.quantised == [1.0, 2.0]  # a zero rest ties all codes: the first one


def test_attention_ignores_invalid_keys_and_zeroes_invalid_queries(spark):
    rows = spark.createDataFrame([(0, 0, [1.0], True), (0, 1, [3.0], False)], "item int, pos int, v array<double>, valid boolean")
    got = network.attention(rows.withColumn("q", F.col("v")).withColumn("k", F.col("v"))).orderBy("pos").collect()
    assert [r.out for r in got] == [[1.0], [0.0]]


def test_unmask_loop_follows_the_schedule(spark):
    rows = spark.range(10).select(F.lit(1).alias("item"), F.col("id").alias("frame"), F.lit(0.5).alias("p"), F.lit(True).alias("masked"))
    left = [network.unmask_loop(rows, 2, 0.5, 1, rounds=n).filter("not keep").count() for n in (1, 2)]
    assert left == [7, 0]


@pytest.mark.parametrize("kind", ["peaking", "low_shelf", "high_shelf"])
def test_biquads_without_gain_do_nothing(spark, kind):
    c = spark.range(1).select(network.biquad(kind, F.lit(0.0), F.lit(500.0), F.lit(0.7), 44100.0).alias("c")).select("c.*").first()
    assert (c.b0, c.b1, c.b2) == pytest.approx((1.0, c.a1, c.a2))


@pytest.mark.parametrize("kind, dc", [("low_shelf", 2.0), ("high_shelf", 1.0), ("low_pass", 1.0), ("high_pass", 0.0)])
def test_biquad_gain_at_zero_frequency(spark, kind, dc):
    c = spark.range(1).select(network.biquad(kind, F.lit(20 * np.log10(2.0)), F.lit(900.0), F.lit(0.7), 44100.0).alias("c")).select("c.*").first()
    assert (c.b0 + c.b1 + c.b2) / (1 + c.a1 + c.a2) == pytest.approx(dc, abs=1e-9)


def test_sections_agree_with_the_recursion():
    rng = np.random.RandomState(0)
    x, (b0, b1, b2, a1, a2) = rng.randn(200), (0.2, 0.1, 0.05, -0.5, 0.2)
    want = np.zeros(202)
    padded = np.concatenate([[0, 0], x])
    for t in range(2, 202):
        want[t] = b0 * padded[t] + b1 * padded[t - 1] + b2 * padded[t - 2] - a1 * want[t - 1] - a2 * want[t - 2]
    one = scan.System((b0, b1, b2, a1, a2), 256)
    assert one.output(x, np.zeros(2)) == pytest.approx(want[2:], abs=1e-9)
    assert len(one.output(x[:1], np.zeros(2))) == 1
