import math

import pytest

from cadenza.operators import filters

ROWS = [(1, t, math.sin(t) * 3 + t % 4) for t in range(30)] + [(2, 0, 5.0)]


def _brute(x, cutoff):
    taps = filters.sinc_taps(cutoff)
    half = len(taps) // 2
    return [sum(w * x[min(max(t + k - half, 0), len(x) - 1)] for k, w in enumerate(taps)) for t in range(len(x))]


def _got(df, key):
    return [r.x for r in df.filter(f"k = {key}").orderBy("t").collect()]


def test_low_and_high_pass_match_brute_force(spark):
    df = spark.createDataFrame(ROWS, "k int, t int, x double")
    x = [r[2] for r in ROWS if r[0] == 1]
    low, high = filters.low_passed(df, ["k"], 0.2), filters.high_passed(df, ["k"], 0.2)
    assert _got(low, 1) == pytest.approx(_brute(x, 0.2))
    assert _got(high, 1) == pytest.approx([a - b for a, b in zip(x, _brute(x, 0.2), strict=True)])
    # a constant passes whole, shorter than the taps as it is
    assert _got(low, 2) == pytest.approx([5.0])
    assert set(_got(filters.low_passed(df, ["k"], -1.0), 1)) == {0.0}


def test_band_pass_is_limited_and_checked(spark):
    df = spark.createDataFrame(ROWS, "k int, t int, x double")
    assert max(map(abs, _got(filters.band_passed(df, ["k"], 0.05, 0.4), 1))) <= 1 + 1e-12
    with pytest.raises(ValueError):
        filters.band_passed(df, ["k"], 0.4, 0.1)


def test_rate_change_keeps_constants_lengths_and_slow_waves(spark):
    df = spark.createDataFrame([(1, t, math.sin(t / 20)) for t in range(400)] + [(2, t, 7.0) for t in range(5)] + [(3, 0, 1.0)], "k int, t int, x double")
    out = filters.rate_changed(df, ["k"], 3, 2)
    assert [len(_got(out, k)) for k in (1, 2, 3)] == [266, 3, 0]
    assert _got(out, 2) == pytest.approx([7.0] * 3)
    wave = _got(out, 1)
    assert wave[60:200] == pytest.approx([math.sin(t * 1.5 / 20) for t in range(60, 200)], abs=1e-3)
    assert _got(filters.rate_changed(df, ["k"], 2, 2), 2) == [7.0] * 5
    assert len(_got(filters.rate_changed(df, ["k"], 2, 3), 2)) == 7


def test_noise_has_the_ratio_asked_for(spark):
    df = spark.createDataFrame(ROWS, "k int, t int, x double")
    rows = filters.noise_added(df, ["k"], 10.0, 5).filter("k = 1").collect()
    level = lambda v: sum(a * a for a in v) / len(v)
    assert 10 * math.log10(level([r.x for r in rows]) / level([r.y - r.x for r in rows])) == pytest.approx(10.0, abs=1e-4)
