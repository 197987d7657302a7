"""Registered queries of recorded backgrounds and rooms and of transforms by chance, beside their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..operators import items, rooms
from ..sources.tables import signals
from .bands import _equaliser_sql, _gains, r5
from .catalogue import SIGNALS, query

KEY, RATE = ["signal_id"], 1000
#: The recording of each item, one for ten of them, has half the rate in every other case.
DRAWS = f"dw AS (SELECT DISTINCT signal_id, signal_id - signal_id % 10 AS rec, signal_id % 7 / 250.0::DOUBLE AS o, CASE WHEN signal_id // 10 % 2 = 0 THEN {RATE // 2} ELSE {RATE} END AS rate FROM sg)"
GAIN = "(signal_id * 3 + b * 5) % 13 - 6"
SINC = "CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE sin(a) / a END * power(cos(a / 48), 2)"


def _doubled(name: str, rows: str) -> str:
    """CTEs that end in ``name(signal_id, t, x)``: ``rows`` at twice the rate where theirs is half."""
    band = RATE // 2 * 0.945
    return f"""{name}_n AS (SELECT signal_id, any_value(rate) AS rate, count(*) AS n FROM {rows} GROUP BY 1), {name}_o AS (SELECT *, unnest(range(n * 2)) AS t FROM {name}_n WHERE rate = {RATE // 2}),
  {name}_i AS (SELECT *, t / 2.0::DOUBLE AS p, unnest(range(ceil(t / 2.0::DOUBLE - 24 * {RATE // 2} / {band}::DOUBLE)::BIGINT, floor(t / 2.0::DOUBLE + 24 * {RATE // 2} / {band}::DOUBLE)::BIGINT + 1)) AS i FROM {name}_o),
  {name}_a AS (SELECT *, (i - p) * pi() * {band}::DOUBLE / {RATE // 2} AS a FROM {name}_i), {name}_w AS (SELECT *, {SINC} AS w FROM {name}_a),
  {name} AS (SELECT w.signal_id, w.t, sum(w * x) / sum(w) AS x FROM {name}_w w JOIN {rows} r ON r.signal_id = w.signal_id AND r.t = least(greatest(i, 0), n - 1) GROUP BY ALL UNION ALL SELECT signal_id, t, x FROM {rows} WHERE rate = {RATE})"""


def _draws(s):
    i = F.col("signal_id")
    return s.select("signal_id").distinct().select("signal_id", (i - i % 10).alias("rec"), (i % 7 / 250).alias("offset"), (i % 20).cast("double").alias("snr"), (i % 9).cast("double").alias("drr"), _gains(3).alias("gains"))


def _recordings(s):
    rec = F.col("signal_id")
    info = s.select("signal_id").distinct().select(rec.alias("rec"), F.when(F.floor(rec / 10) % 2 == 0, RATE // 2).otherwise(RATE).alias("rate"))
    return s.select(rec.alias("rec"), "t", (F.col("x") / 100).alias("x")), info


@query(f"""WITH {SIGNALS}, {DRAWS}, nn AS (SELECT signal_id, count(*) AS n FROM sg GROUP BY 1),
  ex AS (SELECT d.signal_id, d.rate, s.t - floor(o * rate)::BIGINT AS t, s.x / 100 AS x FROM dw d JOIN nn USING (signal_id) JOIN sg s ON s.signal_id = d.rec AND s.t >= floor(o * rate) AND s.t < floor(o * rate) + floor(n * rate / {RATE}.0::DOUBLE)),
  {_doubled('up', 'ex')}, {_equaliser_sql('eq', 'up', 3, GAIN)},
  b AS (SELECT sg.signal_id, sg.t, sg.x / 100 AS x, coalesce(y, 0) AS n FROM sg LEFT JOIN eq USING (signal_id, t)),
  g AS (SELECT signal_id, sqrt(power(10.0::DOUBLE, (10 * log10(avg(x * x) + 1e-8) - 10 * log10(avg(n * n) + 1e-8) - signal_id % 20) / 10)) AS g FROM b GROUP BY 1),
  y AS (SELECT signal_id, t, x + g * n AS y FROM b JOIN g USING (signal_id)), p AS (SELECT *, max(abs(y)) OVER (PARTITION BY signal_id) AS p FROM y)
  SELECT signal_id, t, round(CASE WHEN p > 1 THEN y / p ELSE y END, 5) + 0.0 AS y FROM p""")
def background_noise(spark, sf_dir):
    s = signals(spark, sf_dir)
    rows = s.select("signal_id", F.lit(0).alias("channel"), "t", (F.col("x") / 100).alias("x"))
    return rooms.background_added(rows, _draws(s), *_recordings(s), KEY, RATE).select("signal_id", "t", r5("y", "y"))


HALF = int(0.0025 * RATE)


@query(f"""WITH {SIGNALS}, {DRAWS}, ex AS (SELECT d.signal_id, d.rate, s.t, s.x / 100 AS x FROM dw d JOIN sg s ON s.signal_id = d.rec AND s.t < rate), {_doubled('up', 'ex')}, {_equaliser_sql('eq', 'up', 3, GAIN)},
  pk AS (SELECT signal_id, arg_max(t, [abs(y), -t]) AS p FROM eq GROUP BY 1), wd AS (SELECT signal_id, t, y AS x, abs(t - p) <= {HALF} AS early, CASE WHEN abs(t - p) <= {HALF} THEN 0.5::DOUBLE + 0.5::DOUBLE * cos(pi() * abs(t - p) / {HALF}) ELSE 0 END AS w FROM eq JOIN pk USING (signal_id)),
  su AS (SELECT signal_id, sum(CASE WHEN early THEN w * x * w * x ELSE 0 END) AS a, sum(CASE WHEN early THEN 2 * w * (1 - w) * x * x ELSE 0 END) AS b, sum(CASE WHEN early THEN (1 - w) * x * (1 - w) * x ELSE 0 END) AS c, sum(CASE WHEN early THEN 0 ELSE x * x END) AS l FROM wd GROUP BY 1),
  gn AS (SELECT signal_id, (-b + sqrt(greatest(b * b - 4 * a * (c - power(10.0::DOUBLE, signal_id % 9 / 10.0::DOUBLE) * l), 0))) / (2 * greatest(a, 1e-20)) AS g FROM su),
  ir AS (SELECT signal_id, t AS k, CASE WHEN early THEN g * w * x + (1 - w) * x ELSE x END AS h FROM wd JOIN gn USING (signal_id)), sn AS (SELECT signal_id, count(*) AS n, max(abs(x)) AS px FROM sg GROUP BY 1),
  ci AS (SELECT * FROM ir JOIN sn USING (signal_id) WHERE k < n), cp AS (SELECT signal_id, arg_max(k, [abs(h), -k]) AS p FROM ci GROUP BY 1),
  y AS (SELECT ci.signal_id, (sg.t + k - p + n) % n AS t, sum(h * x) AS y, any_value(px) AS px FROM ci JOIN cp USING (signal_id) JOIN sg USING (signal_id) GROUP BY ALL)
  SELECT signal_id, t::INT AS t, round(y * px / max(abs(y)) OVER (PARTITION BY signal_id), 4) + 0.0 AS y FROM y""")
def recorded_room(spark, sf_dir):
    s = signals(spark, sf_dir)
    return rooms.room_applied(s, _draws(s), *_recordings(s), KEY, RATE).select("signal_id", "t", (F.round("y", 4) + 0.0).alias("y"))


@query(f"""WITH {SIGNALS}, u AS (SELECT *, {uniform_sql('61:all', 'signal_id')} < 0.8 AS f, {uniform_sql('61:0', 'signal_id')} < 0.5 AS a, {uniform_sql('61:1', 'signal_id')} < 0.7 AS b, {uniform_sql(62, 'signal_id')} AS c FROM sg),
  s AS (SELECT signal_id, t, c, CASE WHEN f AND a THEN tanh(x / 100) * 100 ELSE x END AS x, f AND b AS b FROM u), g AS (SELECT signal_id, t, c, CASE WHEN b THEN x * 0.5 ELSE x END AS x FROM s)
  SELECT signal_id, t, round(CASE WHEN c < 0.75 THEN -x ELSE x + 1 END, 6) AS x FROM g""")
def transforms_by_chance(spark, sf_dir):
    s = signals(spark, sf_dir).select("signal_id", "t", "x")
    changed = lambda f: (lambda d: d.withColumn("x", f(F.col("x"))))
    both = rooms.composed(s, KEY, [(changed(lambda x: items.shaped(x / 100, F.lit(1.0), F.lit(1.0), False) * 100), 0.5), (changed(lambda x: x * 0.5), 0.7)], 61, 0.8)
    return rooms.chosen(both, KEY, [changed(lambda x: -x), changed(lambda x: x + 1)], 62, [3.0, 1.0]).select("signal_id", "t", F.round("x", 6).alias("x"))
