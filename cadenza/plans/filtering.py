"""Registered queries of the filters, beside their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..operators import filters
from ..sources.tables import load, signals
from .catalogue import SIGNALS, query, r6

KEY = ["signal_id"]


def _low_pass_sql(name: str, rows: str, cutoff: float) -> str:
    """CTEs that end in ``name(signal_id, t, x, y)``: ``rows`` and their low pass ``y``."""
    half = int(4 / cutoff)
    return f"""{name}_k AS (SELECT k::INT AS k, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE sin(2 * pi() * {cutoff}::DOUBLE * k) / (2 * pi() * {cutoff}::DOUBLE * k) END * (0.5::DOUBLE + 0.5::DOUBLE * cos(pi() * k / {half})) AS w FROM range(-{half}, {half + 1}) r(k)),
  {name}_n AS (SELECT signal_id, max(t) AS last FROM {rows} GROUP BY 1),
  {name} AS (SELECT s.signal_id, s.t, any_value(s.x) AS x, sum(w * v.x) / (SELECT sum(w) FROM {name}_k) AS y FROM {rows} s JOIN {name}_n USING (signal_id) CROSS JOIN {name}_k
    JOIN {rows} v ON v.signal_id = s.signal_id AND v.t = least(greatest(s.t + k, 0), last) GROUP BY s.signal_id, s.t)"""


@query("SELECT event_id, round_even(value * 40 / 7, 0) * 7 AS hz FROM events")
def hz_quantise(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", filters.hz_quantised(F.col("value") * 40, 7.0).alias("hz"))


@query(f"WITH {SIGNALS}, {_low_pass_sql('lp', 'sg', 0.25)} SELECT signal_id, t, round(y, 6) AS x FROM lp")
def low_pass(spark, sf_dir):
    return filters.low_passed(signals(spark, sf_dir), KEY, 0.25, zeros=8).select("signal_id", "t", r6("x", "x"))


@query(f"WITH {SIGNALS}, {_low_pass_sql('lp', 'sg', 0.1)} SELECT signal_id, t, round(x - y, 6) AS x FROM lp")
def high_pass(spark, sf_dir):
    return filters.high_passed(signals(spark, sf_dir), KEY, 0.1, zeros=8).select("signal_id", "t", r6("x", "x"))


@query(f"""WITH {SIGNALS}, {_low_pass_sql('lo', 'sg', 0.1)}, h AS (SELECT signal_id, t, x - y AS x FROM lo), {_low_pass_sql('hi', 'h', 0.4)},
  p AS (SELECT *, max(abs(y)) OVER (PARTITION BY signal_id) AS p FROM hi) SELECT signal_id, t, round(CASE WHEN p > 1 THEN y / p ELSE y END, 6) AS x FROM p""")
def band_pass(spark, sf_dir):
    return filters.band_passed(signals(spark, sf_dir), KEY, 0.1, 0.4, zeros=8).select("signal_id", "t", r6("x", "x"))


@query(f"""WITH {SIGNALS}, n AS (SELECT signal_id, count(*) AS n FROM sg GROUP BY 1), o AS (SELECT signal_id, n, unnest(range(n * 2 // 3)) AS t FROM n),
  s AS (SELECT *, t * 3 / 2.0::DOUBLE AS p, unnest(range(ceil(t * 1.5::DOUBLE - 72 / 1.89::DOUBLE)::BIGINT, floor(t * 1.5::DOUBLE + 72 / 1.89::DOUBLE)::BIGINT + 1)) AS i FROM o),
  a AS (SELECT *, (i - p) * pi() * 1.89::DOUBLE / 3 AS a FROM s), w AS (SELECT *, CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE sin(a) / a END * power(cos(a / 48), 2) AS w FROM a)
  SELECT w.signal_id, w.t::INT AS t, round(sum(w * x) / sum(w), 6) AS x FROM w JOIN sg ON sg.signal_id = w.signal_id AND sg.t = least(greatest(i, 0), n - 1) GROUP BY ALL""")
def rate_change(spark, sf_dir):
    return filters.rate_changed(signals(spark, sf_dir), KEY, 3, 2).select("signal_id", "t", r6("x", "x"))


@query(f"""WITH {SIGNALS}, b AS (SELECT signal_id, t, x, sqrt(-2 * ln(greatest({uniform_sql(11, 'signal_id', 't')}, 1e-9))) * cos(2 * pi() * {uniform_sql(12, 'signal_id', 't')}) AS n FROM sg),
  g AS (SELECT signal_id, sqrt(power(10.0::DOUBLE, (10 * log10(avg(x * x) + 1e-8) - 10 * log10(avg(n * n) + 1e-8) - 15) / 10)) AS g FROM b GROUP BY 1)
  SELECT signal_id, t, round(x + g * n, 6) AS y FROM b JOIN g USING (signal_id)""")
def white_noise(spark, sf_dir):
    return filters.noise_added(signals(spark, sf_dir).select("signal_id", "t", "x"), KEY, 15.0, 11).select("signal_id", "t", r6("y", "y"))
