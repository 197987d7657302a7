"""Registered queries of levels, network layers and spectral kernels, beside their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import above, uniform, uniform_sql
from ..operators import levels, network, spectral
from ..sources.tables import grid, load, signals
from .catalogue import GRID, SIGNALS, query, r6

KEY = ["signal_id"]


@query("""WITH c AS (SELECT user_id AS signal_id, event_type, day(ts)::INT AS t, round(sum(value), 6) AS x FROM events GROUP BY ALL)
  SELECT signal_id, t, round(avg(x), 6) AS x FROM c GROUP BY ALL""")
def channel_downmix(spark, sf_dir):
    c = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("signal_id"), "event_type", F.dayofmonth("ts").alias("t")).agg(F.round(F.sum("value"), 6).alias("x"))
    return levels.downmix(c, KEY).select("signal_id", "t", r6("x", "x"))


@query(f"""WITH {SIGNALS}, v AS (SELECT signal_id, t, x * 0.15848931924611134::DOUBLE / sqrt(greatest(avg(x * x) OVER (PARTITION BY signal_id), 1e-8)) AS x FROM sg),
  p AS (SELECT *, max(abs(x)) OVER (PARTITION BY signal_id) AS p FROM v) SELECT signal_id, t, round(CASE WHEN p > 1 THEN x / p ELSE x END, 6) AS x FROM p""")
def volume_norm(spark, sf_dir):
    return levels.volume_normalised(signals(spark, sf_dir), KEY, -16.0).select("signal_id", "t", r6("x", "x"))


@query(f"""WITH {SIGNALS}, b AS (SELECT s.signal_id, s.t, s.x, coalesce(n.x, 0.0) AS n FROM sg s LEFT JOIN sg n ON n.signal_id = xor(s.signal_id, 1) AND n.t = s.t),
  g AS (SELECT signal_id, sqrt(power(10.0::DOUBLE, (10 * log10(avg(x * x) + 1e-8) - 10 * log10(avg(n * n) + 1e-8) - 20) / 10)) AS g, avg(n * n) AS en FROM b GROUP BY 1)
  SELECT signal_id, t, round(x + g * n, 6) AS y FROM b JOIN g USING (signal_id)""")
def snr_mix(spark, sf_dir):
    s = signals(spark, sf_dir).select("signal_id", "t", "x")
    return levels.snr_mixed(s, s.withColumn("signal_id", F.col("signal_id").bitwiseXOR(F.lit(1))), KEY, 20.0).select("signal_id", "t", r6("y", "y"))


@query(f"""WITH {SIGNALS}, w AS (SELECT signal_id, t, x, tanh(x / 100) * 30 AS y FROM sg), e AS (SELECT signal_id, sqrt((avg(x * x) + 1e-8) / greatest(avg(y * y) + 1e-8, 1e-8)) AS g FROM w GROUP BY 1)
  SELECT signal_id, t, round(y * least(greatest(g, 1.0 / 6), 6.0), 6) AS y FROM w JOIN e USING (signal_id)""")
def energy_match(spark, sf_dir):
    w = signals(spark, sf_dir).withColumn("y", F.tanh(F.col("x") / 100) * 30)
    return levels.energy_matched(w, KEY, "x", "y", 6.0).select("signal_id", "t", r6("y", "y"))


@query(f"""WITH {SIGNALS}, p AS (SELECT signal_id, arg_max(t, [abs(x), -t]) AS p, count(*) AS n FROM sg GROUP BY 1)
  SELECT signal_id, ((t - p + n) % n)::INT AS t, x FROM sg JOIN p USING (signal_id)""")
def roll_to_peak(spark, sf_dir):
    return levels.rolled_to_peak(signals(spark, sf_dir), KEY).select("signal_id", "t", "x")


@query(f"WITH {SIGNALS} SELECT signal_id, t, lead(x, 3, 1.0) OVER (PARTITION BY signal_id ORDER BY t) AS x FROM sg")
def look_ahead(spark, sf_dir):
    return levels.looked_ahead(signals(spark, sf_dir), KEY, 3).select("signal_id", "t", "x")


@query(f"""WITH {SIGNALS} SELECT signal_id, t, round(1 / (1 + exp(-(x - avg(x) OVER w) / greatest(stddev_samp(x) OVER w, 1e-8))), 6) AS y FROM sg WINDOW w AS (PARTITION BY signal_id)""")
def standard_score_sigmoid(spark, sf_dir):
    return levels.standardised(signals(spark, sf_dir), KEY).select("signal_id", "t", r6("y", "y"))


@query(f"""WITH {SIGNALS}, b AS (SELECT signal_id, min(t) FILTER (WHERE x > 60) AS a, max(t) FILTER (WHERE x > 60) AS b, count(*) AS n FROM sg GROUP BY 1)
  SELECT signal_id, t, x FROM sg JOIN b USING (signal_id) WHERE a IS NULL OR b - a + 1 < least(8, n // 10) OR t BETWEEN a AND b""")
def border_trim(spark, sf_dir):
    return levels.border_trimmed(signals(spark, sf_dir), KEY, 60.0).select("signal_id", "t", "x")


@query(f"""WITH {SIGNALS}, n AS (SELECT signal_id, max(t) AS last FROM sg GROUP BY 1),
  s AS (SELECT signal_id AS item, floor({uniform_sql(8, 'signal_id')} * greatest(last - 7, 1))::INT AS start FROM n)
  SELECT s.item, e.stem, k.k::INT AS t, coalesce(x, 0.0) AS x FROM s CROSS JOIN (VALUES ('click'), ('purchase'), ('absent')) e(stem) CROSS JOIN range(8) k(k)
  LEFT JOIN sg ON sg.signal_id = s.item AND sg.channel = e.stem AND sg.t = s.start + k.k""")
def aligned_excerpt(spark, sf_dir):
    s = signals(spark, sf_dir).select(F.col("signal_id").alias("item"), F.col("channel").alias("stem"), "t", "x")
    starts = s.groupBy("item").agg(F.max("t").alias("last")).select("item", F.floor(uniform(8, F.col("item")) * F.greatest(F.col("last") - 7, F.lit(1))).cast("int").alias("start"))
    return levels.aligned_excerpts(s, ["click", "purchase", "absent"], starts, 8)


@query(f"""WITH {SIGNALS}, n AS (SELECT signal_id, count(*) AS n FROM sg GROUP BY 1)
  SELECT n.signal_id, k.k::INT AS t, x FROM n CROSS JOIN range(40) k(k) JOIN sg ON sg.signal_id = n.signal_id AND sg.t = (k.k * n.n) // 40""")
def resample_nearest(spark, sf_dir):
    return levels.resampled(signals(spark, sf_dir), KEY, 40).select("signal_id", "t", "x")


@query(f"""WITH {SIGNALS}, n AS (SELECT signal_id, count(*) AS n FROM sg GROUP BY 1), p AS (SELECT signal_id, n, k.k::INT AS t, greatest((k.k + 0.5::DOUBLE) * n / 40 - 0.5::DOUBLE, 0) AS p FROM n, range(40) k(k))
  SELECT p.signal_id, p.t, round(a.x * (1 - (p - floor(p))) + b.x * (p - floor(p)), 6) AS x FROM p JOIN sg a ON a.signal_id = p.signal_id AND a.t = floor(p)
  JOIN sg b ON b.signal_id = p.signal_id AND b.t = least(floor(p) + 1, n - 1)""")
def resample_linear(spark, sf_dir):
    return levels.resampled(signals(spark, sf_dir), KEY, 40, linear=True).select("signal_id", "t", r6("x", "x"))


@query("""SELECT p.p AS pos, c.c::INT AS channel, round(CASE WHEN c.c < 8 THEN sin(p.p / power(10000.0::DOUBLE, (c.c % 8) / 8.0::DOUBLE)) ELSE cos(p.p / power(10000.0::DOUBLE, (c.c % 8) / 8.0::DOUBLE)) END, 6) AS value
  FROM range(128) p(p), range(16) c(c)""")
def position_table(spark, sf_dir):
    return network.position_table(spark, 128, 16).select("pos", "channel", r6("value", "value"))


VEC = "ev AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 8) AS v FROM embeddings)"


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 8).alias("v"))


@query(f"WITH {VEC}, n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v) / len(v) + 1e-6) AS n FROM ev) SELECT vec_id, (i - 1)::INT AS dim, round(v[i] / n, 6) AS x FROM n, range(1, 65) r(i)")
def rms_norm(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(network.rms_norm(F.col("v"))).alias("dim", "x")).select("vec_id", "dim", r6("x", "x"))


@query("SELECT event_id, round(value / 100 + power(sin(1.5::DOUBLE * value / 100), 2) / (1.5::DOUBLE + 1e-9), 6) AS y FROM events")
def snake_activation(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", r6(network.snake(F.col("value") / 100, 1.5), "y"))


@query(f"WITH {VEC} SELECT vec_id, (i - 1)::INT AS dim, round(v[65 - i] + 2.5 * (v[i] - v[65 - i]), 6) AS x FROM ev, range(1, 65) r(i)")
def guidance(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(F.zip_with("v", F.reverse("v"), lambda c, u: network.guided(c, u, 2.5))).alias("dim", "x")).select("vec_id", "dim", r6("x", "x"))


@query(f"""WITH {VEC}, a AS (SELECT vec_id // 10 AS item, vec_id AS pos, v, vec_id % 7 <> 3 AS valid FROM ev),
  s AS (SELECT q.item, q.pos, k.v, list_dot_product(q.v, k.v) / 8 AS s FROM a q JOIN a k USING (item) WHERE q.valid AND k.valid),
  e AS (SELECT item, pos, v, exp(s - max(s) OVER (PARTITION BY item, pos)) AS e FROM s)
  SELECT a.item, a.pos, (i - 1)::INT AS dim, round(coalesce(sum(e.e * e.v[i]) / sum(e.e), 0.0), 6) AS x FROM a CROSS JOIN range(1, 65) r(i) LEFT JOIN e ON e.item = a.item AND e.pos = a.pos GROUP BY ALL""")
def masked_attention(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 10).alias("item"), F.col("vec_id").alias("pos"), F.col("v").alias("q"), F.col("v").alias("k"), "v", (F.col("vec_id") % 7 != 3).alias("valid"))
    return network.attention(rows).select("item", "pos", F.posexplode("out").alias("dim", "x")).select("item", "pos", "dim", r6("x", "x"))


NEAR = "round(list_dot_product(f.r, c.v) / (greatest(sqrt(list_dot_product(f.r, f.r)), 1e-12) * greatest(sqrt(list_dot_product(c.v, c.v)), 1e-12)), 9)"


@query(f"""WITH {VEC}, f AS (SELECT vec_id AS frame, v, v AS r FROM ev),
  a AS (SELECT f.frame, any_value(f.v) AS v, any_value(f.r) AS r, arg_max(c.vec_id, [{NEAR}, -c.vec_id]) AS one FROM f, ev c WHERE c.vec_id BETWEEN 16 AND 31 GROUP BY f.frame),
  g AS (SELECT frame, a.v, one, list_transform(list_zip(r, c.v), lambda z: z[1] - z[2]) AS r FROM a JOIN ev c ON c.vec_id = one),
  b AS (SELECT f.frame, any_value(f.v) AS v, any_value(f.one) AS one, any_value(f.r) AS r, arg_max(c.vec_id, [{NEAR}, -c.vec_id]) AS two FROM g f, ev c WHERE c.vec_id BETWEEN 32 AND 47 GROUP BY f.frame)
  SELECT frame, one, two, round(list_dot_product(list_transform(list_zip(r, c.v), lambda z: z[1] - z[2]), list_transform(list_zip(r, c.v), lambda z: z[1] - z[2])), 6) AS error FROM b JOIN ev c ON c.vec_id = two""")
def residual_vq(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    book = lambda a, b: v.filter(F.col("vec_id").between(a, b)).select(F.col("vec_id").alias("code"), F.col("v").alias("c"))
    got = network.residual_codes(v.select(F.col("vec_id").alias("frame"), "v"), [book(16, 31), book(32, 47)])
    return got.select("frame", F.col("codes")[0].alias("one"), F.col("codes")[1].alias("two"), r6(network.dot(F.col("residual"), F.col("residual")), "error"))


@query(f"WITH {VEC} SELECT l_orderkey AS item, l_linenumber AS line, l_partkey % 1024 AS code, round(list_sum(coalesce(v, [0.0::DOUBLE])), 6) AS total FROM lineitem LEFT JOIN ev ON ev.vec_id = l_partkey % 1024")
def code_lookup(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 1024).alias("code"))
    book = _vectors(spark, sf_dir).filter("vec_id < 1024")  # a codebook: 1024 rows at most
    found = rows.join(F.broadcast(book), F.col("code") == F.col("vec_id"), "left")
    return found.select("item", "line", "code", r6(F.coalesce(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), F.lit(0.0)), "total"))


RATIOS = "dv AS (SELECT i FROM range(1, 44101) r(i) WHERE 44100 % i = 0), ra AS (SELECT DISTINCT a.i // gcd(a.i, b.i) AS num, b.i // gcd(a.i, b.i) AS den FROM dv a, dv b WHERE a.i <> b.i AND b.i <= 2 * a.i AND a.i <= 2 * b.i)"


@query(f"WITH {RATIOS} SELECT num::BIGINT AS num, den::BIGINT AS den FROM ra")
def fast_ratios(spark, sf_dir):
    return network.fast_ratios(spark, 44100)


@query(f"""WITH {RATIOS}, t AS (SELECT p_partkey, (p_size - 25) / 4.0::DOUBLE AS semitones FROM part)
  SELECT p_partkey, arg_min(num, [round(abs(12 * log2(num::DOUBLE / den) - semitones), 9), num::DOUBLE / den])::BIGINT AS num, arg_min(den, [round(abs(12 * log2(num::DOUBLE / den) - semitones), 9), num::DOUBLE / den])::BIGINT AS den FROM t, ra GROUP BY 1""")
def nearest_ratio(spark, sf_dir):
    items = load(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - 25) / 4).alias("semitones"))
    return network.nearest_ratio(items, network.fast_ratios(spark, 44100)).select("p_partkey", "num", "den")


@query("""WITH c AS (SELECT event_id, power(10.0::DOUBLE, (event_id % 13 - 6) / 40.0::DOUBLE) AS a, 2 * pi() * (value + 50) / 44100 AS w FROM events), d AS (SELECT *, sin(w) / 1.4::DOUBLE AS al FROM c)
  SELECT event_id, round((1 + al * a) / (1 + al / a), 6) AS b0, round(-2 * cos(w) / (1 + al / a), 6) AS b1, round((1 - al * a) / (1 + al / a), 6) AS b2, round(-2 * cos(w) / (1 + al / a), 6) AS a1, round((1 - al / a) / (1 + al / a), 6) AS a2 FROM d""")
def biquad_peaking(spark, sf_dir):
    c = network.biquad("peaking", (F.col("event_id") % 13 - 6).cast("double"), F.col("value") + 50, F.lit(0.7), 44100.0)
    return load(spark, sf_dir, "events").select("event_id", c.alias("c")).select("event_id", *[r6(f"c.{n}", n) for n in ("b0", "b1", "b2", "a1", "a2")])


@query("""WITH d AS (SELECT doc_id, source FROM documents), a AS (SELECT doc_id AS k, 'wav' AS f FROM labels), b AS (SELECT item_id * 3 AS k, 'aiff' AS f FROM benchmark)
  SELECT d.doc_id, coalesce(a.f, b.f) AS file FROM d LEFT JOIN a ON a.k = d.doc_id LEFT JOIN b ON b.k = d.doc_id WHERE coalesce(a.f, b.f) IS NOT NULL""")
def priority_lookup(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id")
    a = load(spark, sf_dir, "labels").select("doc_id", F.lit("wav").alias("first"))
    b = load(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("doc_id"), F.lit("aiff").alias("second"))
    return d.join(a, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", F.coalesce("first", "second").alias("file")).filter("file is not null")


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_id FROM n""")
def prefix_offsets(spark, sf_dir):
    n = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))  # a row a source
    return n.select("source", "n", F.coalesce(F.sum("n").over(W.orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first_id"))


@query("""WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn) AS l FROM conversations GROUP BY 1)
  SELECT conv_id, conv_id // 8 AS batch_id, len(l)::INT AS n, array_to_string(list_resize(l, max(len(l)) OVER (PARTITION BY conv_id // 8), 0), ',') AS padded FROM c""")
def collate_padded(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda s: s["n"]).alias("l"))
    c = c.withColumn("batch_id", F.floor(F.col("conv_id") / 8)).withColumn("width", F.max(F.size("l")).over(W.partitionBy("batch_id")))
    padded = F.concat("l", F.array_repeat(F.lit(0), F.col("width") - F.size("l")))
    return c.select("conv_id", "batch_id", F.size("l").alias("n"), F.array_join(padded.cast("array<string>"), ",").alias("padded"))


@query(f"""WITH {GRID}, m AS (SELECT *, {uniform_sql(12, 'item', 'codebook', 'frame')} > 0.6 AS keep, item % 100 + 1 AS len FROM gr)
  SELECT item, codebook, count(*) FILTER (WHERE NOT keep) AS masked, count(*) FILTER (WHERE NOT keep AND frame < len AND codebook = item % 9) AS in_loss FROM m GROUP BY ALL""")
def masked_counts(spark, sf_dir):
    keep = above(0.6, 12, F.col("item"), F.col("codebook"), F.col("frame"))
    m = grid(spark, sf_dir).withColumn("keep", keep)
    loss = ~F.col("keep") & (F.col("frame") < F.col("item") % 100 + 1) & (F.col("codebook") == F.col("item") % 9)
    return m.groupBy("item", "codebook").agg(F.count_if(~F.col("keep")).alias("masked"), F.count_if(loss).alias("in_loss"))


def _round_sql(i: int, before: str) -> str:
    share, temperature = max(math.cos(i / 3 * math.pi / 2), 1e-10), 0.5 * (1 - i / 3)
    noise = f"(-ln(-ln(least(greatest({uniform_sql(20 + i, 'item', 'frame')}, 1e-6), 1 - 1e-6))))"
    score = f"round(ln(greatest(p, 1e-12)) + {temperature!r}::DOUBLE * {noise}, 9)"
    return f"""s{i} AS (SELECT item, frame, p, begun, masked, sum(masked::INT) OVER (PARTITION BY item) AS m, row_number() OVER (PARTITION BY item ORDER BY masked DESC, {score} DESC, frame) AS r FROM {before}),
  r{i} AS (SELECT item, frame, p, begun, masked AND r > greatest(m - floor(round(begun * {share!r}::DOUBLE, 6)), 0) AS masked FROM s{i})"""


@query(f"""WITH {GRID}, r0 AS (SELECT item, frame, {uniform_sql(4, 'item', 'frame')} AS p, frame % 3 <> 0 AS masked, sum((frame % 3 <> 0)::INT) OVER (PARTITION BY item) AS begun FROM gr WHERE codebook = 0),
  {_round_sql(1, "r0")}, {_round_sql(2, "r1")} SELECT item, frame, NOT masked AS keep FROM r2""")
def unmask_loop(spark, sf_dir):
    """Two of three rounds, so that some positions are still masked."""
    g = grid(spark, sf_dir).filter("codebook = 0").select("item", "frame", uniform(4, F.col("item"), F.col("frame")).alias("p"), (F.col("frame") % 3 != 0).alias("masked"))
    return network.unmask_loop(g, 3, 0.5, 20, rounds=2).select("item", "frame", "keep")


@query(f"""WITH {SIGNALS}, p AS (SELECT a.signal_id, a.t, sum(0.4::DOUBLE * power(0.6::DOUBLE, a.t - b.t) * b.x) AS y FROM sg a JOIN sg b ON a.signal_id = b.signal_id AND b.t <= a.t AND b.t > a.t - 60 GROUP BY ALL)
  SELECT signal_id, t, round(y, 5) AS y FROM p""")
def one_pole_smoothing(spark, sf_dir):
    return spectral.one_pole(signals(spark, sf_dir), KEY, 0.6).select("signal_id", "t", F.round("y", 5).alias("y"))


@query(f"""WITH {SIGNALS}, n AS (SELECT signal_id, count(*) AS n FROM sg GROUP BY 1)
  SELECT signal_id, ((t + k) % n)::INT AS t, round(sum(x * [0.5, 0.25, -0.125, 0.0625][k + 1]), 6) AS y FROM sg JOIN n USING (signal_id), range(4) k(k) GROUP BY ALL""")
def fft_convolution(spark, sf_dir):
    return spectral.fft_convolve(signals(spark, sf_dir), KEY, [0.5, 0.25, -0.125, 0.0625]).select("signal_id", "t", r6("y", "y"))
