"""Registered queries of filter banks, beside their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..operators import bands as bk
from ..sources.tables import signals
from .catalogue import SIGNALS, query

KEY = ["signal_id"]
RATE, ZEROS = 1000, 8


def r5(c, name):
    return (F.round(c, 5) + 0.0).alias(name)


def _equaliser_sql(name: str, rows: str, count: int, gain: str) -> str:
    """CTEs that end in ``name(signal_id, t, x, y)``; ``gain`` is a band's dB by signal_id and band ``b``."""
    return f"""{name}_e AS (SELECT b, 700 * (power(10.0::DOUBLE, 2595 * log10(1 + {RATE} / 1400.0::DOUBLE) * (b + 1) / {count} / 2595) - 1) / {RATE} AS c FROM range({count - 1}) r(b)),
  {name}_h AS (SELECT trunc({ZEROS}.0::DOUBLE / min(c) / 2)::INT AS h FROM {name}_e),
  {name}_k AS (SELECT b, c, h, unnest(range(-h, h + 1)) AS k FROM {name}_e, {name}_h), {name}_t AS (SELECT b, k, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE sin(2 * pi() * c * k) / (2 * pi() * c * k) END * (0.5::DOUBLE + 0.5::DOUBLE * cos(pi() * k / h)) AS w FROM {name}_k),
  {name}_w AS (SELECT b, k, w / sum(w) OVER (PARTITION BY b) AS w FROM {name}_t), {name}_n AS (SELECT signal_id, max(t) AS last FROM {rows} GROUP BY 1),
  {name}_g AS (SELECT signal_id, b, power(10.0::DOUBLE, ({gain}) / 20.0::DOUBLE) AS g FROM {name}_n, range({count}) r(b)),
  {name}_d AS (SELECT p.signal_id, w.k, sum((p.g - q.g) * w) AS w FROM {name}_g p JOIN {name}_g q ON q.signal_id = p.signal_id AND q.b = p.b + 1 JOIN {name}_w w ON w.b = p.b GROUP BY ALL),
  {name} AS (SELECT s.signal_id, s.t, any_value(s.x) AS x, sum(w * v.x) + any_value(g) * any_value(s.x) AS y FROM {rows} s JOIN {name}_n USING (signal_id) JOIN {name}_d USING (signal_id) JOIN {name}_g l ON l.signal_id = s.signal_id AND l.b = {count - 1}
    JOIN {rows} v ON v.signal_id = s.signal_id AND v.t = least(greatest(s.t + k, 0), last) GROUP BY s.signal_id, s.t)"""


def _gains(count: int):
    return F.array(*[((F.col("signal_id") * 3 + b * 5) % 13 - 6).cast("double") for b in range(count)])


GAIN = "(signal_id * 3 + b * 5) % 13 - 6"


@query(f"WITH {SIGNALS}, {_equaliser_sql('eq', 'sg', 6, GAIN)} SELECT signal_id, t, round(y, 5) + 0.0 AS y FROM eq")
def band_equaliser(spark, sf_dir):
    s = signals(spark, sf_dir)
    return bk.band_equalised(s, s.select("signal_id").distinct().withColumn("gains", _gains(6)), KEY, RATE, ZEROS).select("signal_id", "t", r5("y", "y"))


@query(f"""WITH {SIGNALS}, nz AS (SELECT signal_id, t, sqrt(-2 * ln(greatest({uniform_sql(41, 'signal_id', 't')}, 1e-9))) * cos(2 * pi() * {uniform_sql(42, 'signal_id', 't')}) AS x FROM sg), {_equaliser_sql('eq', 'nz', 4, GAIN)},
  b AS (SELECT sg.signal_id, sg.t, sg.x / 100 AS x, y AS n FROM sg JOIN eq USING (signal_id, t)),
  g AS (SELECT signal_id, sqrt(power(10.0::DOUBLE, (10 * log10(avg(x * x) + 1e-8) - 10 * log10(avg(n * n) + 1e-8) - signal_id % 20) / 10)) AS g FROM b GROUP BY 1),
  y AS (SELECT signal_id, t, x + g * n AS y FROM b JOIN g USING (signal_id)), p AS (SELECT *, max(abs(y)) OVER (PARTITION BY signal_id) AS p FROM y)
  SELECT signal_id, t, round(CASE WHEN p > 1 THEN y / p ELSE y END, 5) + 0.0 AS y FROM p""")
def filtered_noise(spark, sf_dir):
    s = signals(spark, sf_dir).select("signal_id", F.lit(0).alias("channel"), "t", (F.col("x") / 100).alias("x"))
    params = s.select("signal_id").distinct().select("signal_id", _gains(4).alias("gains"), (F.col("signal_id") % 20).alias("snr"))
    return bk.equalised_noise_added(s, params, KEY, RATE, 41).select("signal_id", "t", r5("y", "y"))


TAPS, HALF = 63, 22050


@query(f"""WITH {SIGNALS}, bd AS (SELECT 0 AS band, 0.0::DOUBLE AS lo, 12.0::DOUBLE / {HALF} AS hi UNION ALL SELECT i, c / sqrt(2) / {HALF}, least(c * sqrt(2) / {HALF}, 0.999) FROM (SELECT unnest([31.5, 63, 125, 250, 500, 1000, 2000, 4000, 8000, 16000])::DOUBLE AS c, unnest(range(1, 11)) AS i)
    UNION ALL SELECT 11, 18000.0::DOUBLE / {HALF}, 1.0),
  tp AS (SELECT band, lo, hi, j, CASE WHEN j = {TAPS // 2} THEN hi - lo ELSE (sin(pi() * hi * (j - {TAPS // 2})) - sin(pi() * lo * (j - {TAPS // 2}))) / (pi() * (j - {TAPS // 2})) END * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * j / {TAPS - 1})) AS h FROM bd, range({TAPS}) r(j)),
  tn AS (SELECT band, j, h / sum(h * cos(pi() * (j - {TAPS // 2}) * CASE WHEN lo = 0 THEN 0 WHEN hi = 1 THEN 1 ELSE (lo + hi) / 2 END)) OVER (PARTITION BY band) AS h FROM tp),
  sn AS (SELECT signal_id, count(*) AS n, max(abs(x)) AS px, 12 + signal_id % 3 * 6 AS m FROM sg GROUP BY 1),
  nb AS (SELECT signal_id, n, px, m, band, unnest(range(m + {TAPS - 1})) AS t FROM sn, bd), nz AS (SELECT *, sqrt(-2 * ln(greatest({uniform_sql(51, 'signal_id', 'band', 't')}, 1e-9))) * cos(2 * pi() * {uniform_sql(52, 'signal_id', 'band', 't')}) AS x FROM nb),
  fl AS (SELECT signal_id, n, px, m, nz.band, nz.t - j AS t, sum(h * x) AS y FROM nz JOIN tn ON tn.band = nz.band AND j <= nz.t AND nz.t - j < m GROUP BY ALL),
  ir AS (SELECT signal_id, n, px, t AS k, sum(y * exp(-t / 44100.0::DOUBLE / (0.0002::DOUBLE + 0.0001::DOUBLE * band)) * CASE WHEN band % 2 = 0 THEN 1.0 ELSE least(t / 44100.0::DOUBLE / 0.0001::DOUBLE, 1.0) END * ((signal_id + band) % 4 / 4.0::DOUBLE)) / 12 AS h FROM fl GROUP BY ALL),
  ci AS (SELECT * FROM ir WHERE k < n), y AS (SELECT ci.signal_id, (sg.t + k) % n AS t, sum(h * x) AS y, any_value(px) AS px FROM ci JOIN sg USING (signal_id) GROUP BY ALL),
  w AS (SELECT signal_id, t, y * px / max(abs(y)) OVER (PARTITION BY signal_id) AS y FROM y), mx AS (SELECT signal_id, sg.t, (1 - (signal_id % 5) / 4.0::DOUBLE) * x + (signal_id % 5) / 4.0::DOUBLE * y AS y FROM sg JOIN w USING (signal_id, t)),
  p AS (SELECT *, max(abs(y)) OVER (PARTITION BY signal_id) AS p FROM mx) SELECT signal_id, t, round(CASE WHEN p > 1 THEN y / p ELSE y END, 5) + 0.0 AS y FROM p""")
def octave_reverb(spark, sf_dir):
    s, i = signals(spark, sf_dir), F.col("signal_id")
    of = lambda f: F.array(*[f(b) for b in range(12)])
    # a tenth of a sample less than the length that is meant
    params = s.select("signal_id").distinct().select(
        "signal_id", ((12 + i % 3 * 6 - 0.1) / 44100).alias("duration"), of(lambda b: (i + b) % 4 / 4).alias("gains"),
        of(lambda b: F.lit(0.0002) + F.lit(0.0001) * b).alias("decays"), of(lambda b: F.lit(0.0 if b % 2 == 0 else 0.0001)).alias("attacks"), (i % 5 / 4).alias("mix"),
    )
    return bk.octave_reverb(s, params, KEY, 44100.0, 51, TAPS).select("signal_id", "t", r5("y", "y"))
