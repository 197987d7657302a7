"""Registered queries of framed transforms, beside their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, images
from ..sources.tables import signals
from .catalogue import SIGNALS, query, r6

KEY = ["signal_id"]


def _stft_sql(size: int, hop: int, root: bool = False, mirror: bool = True) -> str:
    """CTEs that end in ``st(signal_id, n, f, b, re, im)``, and ``wn(j, w)`` of the window."""
    w = f"0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {size})"
    at = "CASE WHEN p % k < n THEN p % k ELSE k - p % k END" if mirror else "CASE WHEN q < 0 OR q >= n THEN -1 ELSE q END"
    return f"""{SIGNALS}, sn AS (SELECT signal_id, count(*) AS n, greatest(2 * count(*) - 2, 1) AS k FROM sg GROUP BY 1),
  wn AS (SELECT j, {f'sqrt({w})' if root else w} AS w FROM range({size}) r(j)),
  sf AS (SELECT signal_id, n, k, unnest(range((n - {size % 2}) // {hop} + 1)) AS f FROM sn),
  sp AS (SELECT *, f * {hop} - {size // 2} + j AS q, f * {hop} - {size // 2} + j + k * {size} AS p FROM sf, wn),
  sx AS (SELECT p.signal_id, n, f, j, w * coalesce(x, 0) AS v FROM (SELECT *, {at} AS i FROM sp) p LEFT JOIN sg ON sg.signal_id = p.signal_id AND sg.t = p.i),
  st AS (SELECT signal_id, n, f, b, sum(v * cos(2 * pi() * (b * j % {size}) / {size})) AS re, -sum(v * sin(2 * pi() * (b * j % {size}) / {size})) AS im FROM sx, range({size // 2 + 1}) r(b) GROUP BY ALL)"""


def _istft_sql(name: str, spectra: str, size: int, hop: int) -> str:
    """CTEs that end in ``name(signal_id, t, y)`` of all times from 0, from ``spectra(signal_id, f, b, re, im)``."""
    return f"""{name}_f AS (SELECT signal_id, f, j, any_value(w) AS w, sum(CASE WHEN b = 0 OR 2 * b = {size} THEN 1 ELSE 2 END * (re * cos(2 * pi() * (b * j % {size}) / {size}) - CASE WHEN b = 0 OR 2 * b = {size} THEN 0 ELSE im END * sin(2 * pi() * (b * j % {size}) / {size}))) / {size} AS z FROM {spectra}, wn GROUP BY ALL),
  {name} AS (SELECT signal_id, f * {hop} - {size // 2} + j AS t, CASE WHEN sum(w * w) > 1e-11 THEN sum(w * z) / sum(w * w) ELSE 0.0 END AS y FROM {name}_f WHERE f * {hop} - {size // 2} + j >= 0 GROUP BY ALL)"""


@query(f"WITH {_stft_sql(16, 4)} SELECT signal_id, f::BIGINT AS frame, b::INT AS bin, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM st")
def spectrogram(spark, sf_dir):
    s = frames.stft(signals(spark, sf_dir), KEY, 16, 4)
    cells = s.select("signal_id", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "c"))
    return cells.select("signal_id", "frame", "bin", (F.round("c.re", 5) + 0.0).alias("re"), (F.round("c.im", 5) + 0.0).alias("im"))


@query(f"WITH {SIGNALS} SELECT signal_id, t, round(x, 6) AS x FROM sg")
def spectrum_round_trip(spark, sf_dir):
    """The inverse of the spectra is the signal."""
    return frames.istft(frames.stft(signals(spark, sf_dir), KEY, 32, 8), KEY, 32, 8).select("signal_id", "t", r6("x", "x"))


@query(f"""WITH {_stft_sql(16, 4, True)}, sh AS (SELECT *, (signal_id % 13 - 6) / 2.0::DOUBLE AS s FROM st), tu AS (SELECT signal_id, f, b, re * cos(s) - im * sin(s) AS re, re * sin(s) + im * cos(s) AS im FROM sh),
  {_istft_sql('ph', 'tu', 16, 4)} SELECT signal_id, t::INT AS t, round(y, 5) + 0.0 AS x FROM ph JOIN sn USING (signal_id) WHERE t < n""")
def phase_shift(spark, sf_dir):
    s = signals(spark, sf_dir)
    shifts = s.select("signal_id").distinct().withColumn("shift", (F.col("signal_id") % 13 - 6) / 2)
    return frames.phase_shifted(s, shifts, KEY, 16, 4).select("signal_id", "t", (F.round("x", 5) + 0.0).alias("x"))


@query(f"""WITH {_stft_sql(16, 1)}, ra AS (SELECT signal_id, n, 4 + signal_id % 3 AS num, 4 + signal_id % 5 // 2 AS den FROM sn),
  ks AS (SELECT *, unnest(range(((n + 1) * num + den - 1) // den)) AS k FROM ra),
  vo AS (SELECT s.signal_id, s.num, s.den, s.n, k, a.b, (k * den % num) / num::DOUBLE * sqrt(coalesce(c.re * c.re + c.im * c.im, 0)) + (1 - (k * den % num) / num::DOUBLE) * sqrt(a.re * a.re + a.im * a.im) AS m,
    CASE WHEN k = 0 THEN atan2(a.im, a.re) END AS p0, atan2(coalesce(c.im, 0), coalesce(c.re, 0)) - atan2(a.im, a.re) AS d FROM ks s JOIN st a ON a.signal_id = s.signal_id AND a.f = k * den // num LEFT JOIN st c ON c.signal_id = a.signal_id AND c.f = a.f + 1 AND c.b = a.b),
  ac AS (SELECT *, max(p0) OVER (PARTITION BY signal_id, b) + coalesce(sum(d) OVER (PARTITION BY signal_id, b ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM vo),
  sy AS (SELECT signal_id, k AS f, b, m * cos(p) AS re, m * sin(p) AS im FROM ac), {_istft_sql('lo', 'sy', 16, 1)},
  lg AS (SELECT lo.* FROM lo JOIN ra USING (signal_id) WHERE t < n * num // den),
  rt AS (SELECT *, greatest(1, round_even(1024 * den / num::DOUBLE, 0))::BIGINT AS nw, n * num // den AS l FROM ra),
  o AS (SELECT *, unnest(range(l * nw // 1024)) AS t FROM rt WHERE nw <> 1024),
  s AS (SELECT *, t * 1024 / nw::DOUBLE AS p, least(1024, nw) * 0.945::DOUBLE AS band FROM o),
  i AS (SELECT *, unnest(range(ceil(p - 24 * 1024 / band)::BIGINT, floor(p + 24 * 1024 / band)::BIGINT + 1)) AS i FROM s), a AS (SELECT *, (i - p) * pi() * band / 1024 AS a FROM i),
  w AS (SELECT *, CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE sin(a) / a END * power(cos(a / 48), 2) AS w FROM a),
  rs AS (SELECT w.signal_id, w.t, sum(w * y) / sum(w) AS y FROM w JOIN lg ON lg.signal_id = w.signal_id AND lg.t = least(greatest(i, 0), l - 1) GROUP BY ALL
    UNION ALL SELECT signal_id, t, y FROM lg JOIN rt USING (signal_id) WHERE nw = 1024),
  al AS (SELECT sg.signal_id, sg.t, coalesce(y, 0) AS y FROM sg LEFT JOIN rs ON rs.signal_id = sg.signal_id AND rs.t = sg.t), pk AS (SELECT *, max(abs(y)) OVER (PARTITION BY signal_id) AS p FROM al)
  SELECT signal_id, t, round(CASE WHEN p > 1 THEN y / p ELSE y END, 5) + 0.0 AS x FROM pk""")
def pitch_shift(spark, sf_dir):
    s = signals(spark, sf_dir)
    i = F.col("signal_id")
    ratios = s.select("signal_id").distinct().select("signal_id", (4 + i % 3).alias("num"), (4 + F.floor(i % 5 / 2)).alias("den"))
    return frames.pitch_shifted(s, ratios, KEY, 1024).select("signal_id", "t", (F.round("x", 5) + 0.0).alias("x"))


MELS, WIDTH = 6, 24


@query(f"""WITH {_stft_sql(32, 4, mirror=False)}, me AS (SELECT b AS band, CASE WHEN m < 15 THEN m * 200 / 3.0::DOUBLE ELSE 1000 * exp(ln(6.4::DOUBLE) / 27 * (m - 15)) END AS hz, e FROM (SELECT b, e, (b + e) * (15 + ln(4.0::DOUBLE) / (ln(6.4::DOUBLE) / 27)) / {MELS + 1} AS m FROM range({MELS}) b(b), range(3) e(e))),
  tr AS (SELECT band, max(hz) FILTER (WHERE e = 0) AS a, max(hz) FILTER (WHERE e = 1) AS c, max(hz) FILTER (WHERE e = 2) AS z FROM me GROUP BY 1),
  bk AS (SELECT band, b, least((b * 250.0::DOUBLE - a) / (c - a), (z - b * 250.0::DOUBLE) / (z - c)) * 2 / (z - a) AS w FROM tr JOIN range(17) r(b) ON b * 250 > a AND b * 250 < z),
  mp AS (SELECT signal_id, f, tr.band, coalesce(sum(w * (re * re + im * im)), 0) AS p FROM st CROSS JOIN tr LEFT JOIN bk ON bk.b = st.b AND bk.band = tr.band GROUP BY ALL),
  lv AS (SELECT signal_id, f, band, floor(round(255 * (greatest(10 * log10(greatest(p, 1e-10)) - 10 * log10(greatest(max(p) OVER (PARTITION BY signal_id), 1e-10)), -80) + 80) / 80, 6))::INT AS l FROM mp),
  fm AS (SELECT signal_id, f, max(l) AS m FROM lv GROUP BY ALL), en AS (SELECT signal_id, min(f) FILTER (WHERE m > 2) AS a, max(f) FILTER (WHERE m > 2) AS z, count(*) AS w FROM fm GROUP BY 1),
  eb AS (SELECT signal_id, CASE WHEN k THEN 0 ELSE a END AS a, CASE WHEN k THEN w ELSE z - a + 1 END AS w FROM (SELECT *, coalesce(z - a + 1, 0) < least(8, w // 10) OR coalesce(z - a + 1, 0) = 0 AS k FROM en)),
  sl AS (SELECT *, x * (w - 1) / {WIDTH - 1}::DOUBLE AS p FROM eb, range({WIDTH}) r(x)), im AS (SELECT s.signal_id, x, lv.band, sum(CASE WHEN lv.f - a = floor(p) THEN 1 - (p - floor(p)) ELSE p - floor(p) END * l) AS l
    FROM sl s JOIN lv ON lv.signal_id = s.signal_id AND lv.f - a IN (floor(p), floor(p) + 1) AND lv.f - a < w GROUP BY ALL)
  SELECT signal_id, ({MELS - 1} - band)::INT AS "row", x::INT AS col, floor(round(l, 6))::INT AS level FROM im""")
def mel_image(spark, sf_dir):
    s = frames.stft(signals(spark, sf_dir), KEY, 32, 4, ends="zero")
    return images.mel_image(s, KEY, 8000, 32, MELS, WIDTH)
