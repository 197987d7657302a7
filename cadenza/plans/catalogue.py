"""Registered queries of the engine, each beside the DuckDB SQL that gives the same rows.

Doubles are rounded to six places at the outermost select of both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import above, uniform, uniform_sql
from ..operators import decode, features, manifest, metrics
from ..operators import signal as sig
from ..sources.tables import grid, grid_items, load, logits, positions, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


SIGNALS = "sg AS (SELECT user_id AS signal_id, event_type AS channel, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS t, value AS x FROM events)"
LOGITS = "lg AS (SELECT vec_id AS pos, label AS target, (vec_id % 9)::INT AS codebook, (i - 1)::INT AS cls, round(embedding[i]::DOUBLE * 8, 6) AS logit FROM embeddings, range(1, 65) r(i))"
GRID = "gr AS (SELECT c_custkey AS item, k.k::INT AS codebook, f.f::INT AS frame FROM customer, range(9) k(k), range(100) f(f))"
ITEM_GRID = "mg AS (SELECT t.event_type AS item, m.m AS mel, h.h::INT AS frame, coalesce(e, 0.0) AS e FROM (SELECT DISTINCT event_type FROM events) t, (SELECT DISTINCT user_id % 40 AS m FROM events) m, range(720) h(h) LEFT JOIN (SELECT event_type, user_id % 40 AS mel, floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600)::INT AS frame, round(sum(value), 6) AS e FROM events GROUP BY ALL) s ON s.event_type = t.event_type AND s.mel = m.m AND s.frame = h.h)"


def mel_grid(spark, sf_dir) -> DataFrame:
    ev = load(spark, sf_dir, "events").select(F.col("event_type").alias("item"), (F.col("user_id") % 40).alias("mel"), F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 3600).cast("int").alias("frame"), "value")
    sums = ev.groupBy("item", "mel", "frame").agg(F.round(F.sum("value"), 6).alias("e"))
    cells = ev.select("item").distinct().join(ev.select("mel").distinct()).select("*", F.explode(F.sequence(F.lit(0), F.lit(719))).alias("frame"))
    return cells.join(sums, ["item", "mel", "frame"], "left").fillna(0.0, ["e"])


@query(f"""WITH {ITEM_GRID}, c AS (SELECT item, mel, frame, round(ln(1 + least(greatest(e, 0.0), 50.0)) / ln(51.0), 9) AS e FROM mg),
  m AS (SELECT item, mel, round(avg(e), 6)::DECIMAL(38,6) AS m FROM c GROUP BY ALL),
  u AS (SELECT *, sum(m) OVER (PARTITION BY item ORDER BY mel) - m AS before, sum(m) OVER (PARTITION BY item) AS total FROM m),
  b AS (SELECT item, mel, CASE WHEN before * 2 >= total THEN 1 ELSE 0 END AS band FROM u),
  s AS (SELECT item, band, frame, sum(e::DECIMAL(38,9))::DOUBLE AS x FROM c JOIN b USING (item, mel) GROUP BY ALL),
  x AS (SELECT g.item, r.r::INT AS band, g.frame, coalesce(s.x, 0.0) AS x FROM (SELECT DISTINCT item, frame FROM c) g CROSS JOIN range(2) r(r) LEFT JOIN s ON s.item = g.item AND s.band = r.r AND s.frame = g.frame),
  a1 AS (SELECT p.item, p.band, p.frame, round(any_value(p.x) - sum(q.x) / 7, 9) AS d FROM x p, range(-3, 4) o(o), x q
     WHERE p.item = q.item AND p.band = q.band AND q.frame = CASE WHEN p.frame + o < 0 THEN -(p.frame + o) WHEN p.frame + o > 719 THEN 1438 - (p.frame + o) ELSE p.frame + o END GROUP BY ALL),
  t AS (SELECT item, band, frame, greatest(d, 0.0) AS x FROM a1),
  a2 AS (SELECT p.item, p.band, p.frame, round(sum(q.x) / 3, 9) AS x FROM t p, range(-1, 2) o(o), t q
     WHERE p.item = q.item AND p.band = q.band AND q.frame = CASE WHEN p.frame + o < 0 THEN -(p.frame + o) WHEN p.frame + o > 719 THEN 1438 - (p.frame + o) ELSE p.frame + o END GROUP BY ALL),
  q AS (SELECT item, band, greatest(quantile_cont(x, 0.98), 1e-8) AS q FROM a2 GROUP BY ALL)
  SELECT item, band, frame, round_even(least(round(x / q, 6), 1.0)::DOUBLE * 4, 0) / 4 AS value FROM a2 JOIN q USING (item, band)""")
def rhythm_features(spark, sf_dir):
    return features.rhythm_features(mel_grid(spark, sf_dir))


@query("""SELECT doc_id, CASE WHEN p = '' THEN '' WHEN starts_with(p, '/') THEN p ELSE '/data/' || p END AS path FROM
  (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 5 = 0 THEN '/abs/' || doc_id ELSE source || '/' || doc_id || '.wav' END AS p FROM documents)""")
def manifest_paths(spark, sf_dir):
    return _manifest(spark, sf_dir).select("doc_id", manifest.full_path(F.col("drums"), "/data").alias("path"))


def _manifest(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 7 == 0, "  ").when(F.col("doc_id") % 5 == 0, F.concat(F.lit("/abs/"), F.col("doc_id").cast("string"))).otherwise(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")))
    bass = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("/b/"), F.col("doc_id").cast("string")))
    return d.select("doc_id", "source", raw.alias("drums"), bass.alias("bass"), (F.col("n_chars") / 1000).alias("drums_s"), (F.col("n_chars") / 2000).alias("bass_s"))


@query("SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 3 <> 0")
def manifest_strict(spark, sf_dir):
    m = _manifest(spark, sf_dir).withColumn("drums", manifest.full_path(F.col("drums"), "/data"))
    return manifest.strict(m, ["drums", "bass"]).select("doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN n_chars / 2000 ELSE n_chars / 1000 END AS min_duration FROM documents
  WHERE (doc_id % 7 <> 0 OR doc_id % 3 <> 0) AND n_chars > 0""")
def manifest_lenient(spark, sf_dir):
    m = _manifest(spark, sf_dir).withColumn("drums", manifest.full_path(F.col("drums"), "/data"))
    return manifest.lenient(m, {"drums": "drums_s", "bass": "bass_s"}).select("doc_id", "min_duration")


@query("SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def semi_exists(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def anti_missing(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), substr((SELECT min(p_name) FROM part), 1, 3))
  AND NOT regexp_matches(lower(p_name), 'guitar|vocal|piano')""")
def tag_filter(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    wanted = part.agg(F.substring(F.min("p_name"), 1, 3).alias("wanted"))  # one row
    return part.join(F.broadcast(wanted)).filter(manifest.tag_filter(F.col("p_name"), F.col("wanted"), ["guitar", "vocal", "piano"])).select("p_partkey", "p_name")


@query("SELECT page_id, regexp_extract(list_last(string_split(url, '/')), '[0-9]+') AS id FROM pages WHERE regexp_matches(list_last(string_split(url, '/')), '[0-9]+')")
def url_id_extract(spark, sf_dir):
    last = F.element_at(F.split("url", "/"), -1)
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract(last, "[0-9]+", 0).alias("id")).filter("id <> ''")


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_meta(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
  SELECT doc_id, CASE WHEN r <= floor(0.8::DOUBLE * n) THEN 'train' WHEN r <= floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM r""")
def split_proportional(spark, sf_dir):
    return manifest.proportional_split(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", (0.8, 0.1, 0.1), 0)


WEIGHTS = "wt AS (SELECT event_type AS source, greatest(min(value) - 0.02, 0.0) AS c FROM events GROUP BY 1), ws AS (SELECT source, CASE WHEN sum(c) OVER () > 0 THEN c / sum(c) OVER () ELSE 1.0 / count(*) OVER () END AS w FROM wt)"


def _weights(spark, sf_dir) -> DataFrame:
    s = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg((F.min("value") - 0.02).alias("raw"))
    return manifest.source_weights(s, "raw")


@query(f"WITH {WEIGHTS} SELECT source, round(w, 6) AS w FROM ws")
def source_weights(spark, sf_dir):
    return _weights(spark, sf_dir).select("source", r6("w", "w"))


@query(f"""WITH n AS (SELECT source, count(*) AS raw FROM documents GROUP BY 1), w AS (SELECT source, raw::DOUBLE / sum(raw) OVER () AS w FROM n),
  s AS (SELECT source, round(sum(w) OVER (ORDER BY source), 9) AS hi FROM w), l AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY source), 0.0) AS lo FROM s),
  d AS (SELECT o_orderkey AS idx, {uniform_sql(5, 'o_orderkey')} AS u FROM orders) SELECT idx, source FROM d JOIN l ON u >= lo AND u < hi""")
def weighted_pick(spark, sf_dir):
    n = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("double").alias("raw"))
    return manifest.weighted_pick(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx")), manifest.source_weights(n, "raw"), 5).select("idx", "source")


@query(f"""SELECT doc_id, round(CASE WHEN n_chars / 1000 - 2.0 <= 0 THEN 0.0 ELSE greatest(0.0, least({uniform_sql(3, 'doc_id')} * (n_chars / 1000 - 2.0), n_chars / 1000 - 2.0 - 1.0 / 44100)) END, 6) AS "offset" FROM documents""")
def offset_pick(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", r6(manifest.excerpt_offset(uniform(3, F.col("doc_id")), F.col("n_chars") / 1000, 2.0, 44100), "offset"))


@query("""WITH g AS (SELECT o_custkey AS item, o_orderkey AS try_no, 10 * log10(o_totalprice) AS db FROM orders),
  r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY (db >= 50) DESC, CASE WHEN db >= 50 THEN try_no END, db DESC, try_no) AS r FROM g)
  SELECT item, try_no, round(db, 6) AS db FROM r WHERE r = 1""")
def salience(spark, sf_dir):
    g = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("try_no"), (10 * F.log10("o_totalprice")).alias("db"))
    ok = F.col("db") >= 50
    best = F.min(F.struct((~ok).alias("a"), F.coalesce(F.when(ok, F.col("try_no")), F.lit(0)).alias("b"), (-F.col("db")).alias("c"), F.col("try_no").alias("d"))).alias("m")
    return g.groupBy("item").agg(best).select("item", F.col("m.d").alias("try_no"), r6(-F.col("m.c"), "db"))


@query(f"WITH {SIGNALS} SELECT signal_id, round(20 * log10(greatest(sqrt(avg(x * x) + 1e-12), 1e-12)), 6) AS db FROM sg GROUP BY 1")
def rms_db(spark, sf_dir):
    return signals(spark, sf_dir).groupBy("signal_id").agg(r6(sig.rms_db(F.col("x")), "db"))


@query(f"""WITH {SIGNALS}, n AS (SELECT signal_id, max(t) AS last FROM sg GROUP BY 1)
  SELECT p.signal_id, p.t, round(sum(q.x) / 4, 6) AS ma FROM sg p JOIN n ON n.signal_id = p.signal_id, range(-1, 3) o(o), sg q WHERE q.signal_id = p.signal_id
  AND q.t = CASE WHEN p.t + o < 0 THEN -(p.t + o) WHEN p.t + o > last THEN 2 * last - (p.t + o) ELSE p.t + o END GROUP BY ALL""")
def moving_avg_reflect(spark, sf_dir):
    return sig.moving_average(signals(spark, sf_dir).select("signal_id", "t", "x"), 4, ["signal_id"]).select("signal_id", "t", r6("ma", "ma"))


@query(f"""WITH {SIGNALS} SELECT signal_id, t, round(0.7 * x + 0.3 * (
  coalesce(lag(x, 2) OVER w, 0) * 0.5 + coalesce(lag(x, 4) OVER w, 0) * 0.25 + coalesce(lag(x, 6) OVER w, 0) * 0.125), 6) AS y FROM sg WINDOW w AS (PARTITION BY signal_id ORDER BY t)""")
def delay_taps(spark, sf_dir):
    return sig.delay(signals(spark, sf_dir), 2, 0.5, 3, 0.3, ["signal_id"]).select("signal_id", "t", r6("y", "y"))


@query(f"""WITH {SIGNALS}, n AS (SELECT signal_id, count(*) AS n FROM sg GROUP BY 1)
  SELECT signal_id, ((t + k) % n)::INT AS t, round(sum(x * [0.5, 0.25, -0.125][k + 1]), 6) AS y FROM sg JOIN n USING (signal_id), range(3) k(k) GROUP BY ALL""")
def short_convolve(spark, sf_dir):
    return sig.convolve(signals(spark, sf_dir), [0.5, 0.25, -0.125], ["signal_id"]).select("signal_id", "t", r6("y", "y"))


@query(f"""WITH {SIGNALS}, q AS (SELECT signal_id, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM sg GROUP BY 1)
  SELECT signal_id, t, round(least(greatest(x, lo), hi), 6) AS y FROM sg JOIN q USING (signal_id)""")
def clip_quantile(spark, sf_dir):
    s = signals(spark, sf_dir)
    q = s.groupBy("signal_id").agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return s.join(q, "signal_id").select("signal_id", "t", r6(F.least(F.greatest("x", F.col("q")[0]), F.col("q")[1]), "y"))


@query("SELECT event_id, round(tanh(value / 100) / tanh(1.0), 6) AS y FROM events")
def waveshaper(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", r6(F.tanh(F.col("value") / 100) / F.tanh(F.lit(1.0)), "y"))


@query("""SELECT event_id, round(CASE WHEN abs(o) * 2 <= 6 THEN l + (1 / 4.0 - 1) * power(o + 3, 2) / 12 WHEN o > 0 THEN -20 + o / 4 ELSE l END, 6) AS db
  FROM (SELECT event_id, l, l + 20 AS o FROM (SELECT event_id, 20 * log10(value / 500) AS l FROM events))""")
def compressor_curve(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", r6(sig.compressor_db(sig.decibels(F.col("value") / 500), -20.0, 4.0, 6.0), "db"))


@query("""WITH l AS (SELECT l_orderkey, l_returnflag, l_quantity, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
  SELECT n_name AS track, l_returnflag AS stem, round(sum(l_quantity), 6) AS total, count(*) AS n FROM l GROUP BY ROLLUP (n_name, l_returnflag)""")
def stem_sum_rollup(spark, sf_dir):
    li, o, c, n = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup(F.col("n_name").alias("track"), F.col("l_returnflag").alias("stem")).agg(r6(F.sum("l_quantity"), "total"), F.count("*").alias("n"))


@query(f"WITH {LOGITS}, r AS (SELECT *, rank() OVER (PARTITION BY pos ORDER BY logit DESC) AS r FROM lg) SELECT pos, cls, logit FROM r WHERE r <= 10")
def top_k_ties(spark, sf_dir):
    return decode.top_k(logits(spark, sf_dir), 10).select("pos", "cls", "logit")


SOFT = "e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY pos)) AS e FROM lg), sm AS (SELECT *, e / sum(e) OVER (PARTITION BY pos) AS p FROM e)"


@query(f"""WITH {LOGITS}, {SOFT}, c AS (SELECT *, round(sum(p) OVER w, 9) AS cum, row_number() OVER (PARTITION BY pos ORDER BY logit DESC, cls) AS r FROM sm
  WINDOW w AS (PARTITION BY pos ORDER BY logit DESC, cls ROWS UNBOUNDED PRECEDING)) SELECT pos, cls, round(p, 6) AS p FROM c WHERE cum <= 0.85 OR r = 1""")
def top_p_nucleus(spark, sf_dir):
    return decode.top_p(logits(spark, sf_dir), 0.85).select("pos", "cls", r6("p", "p"))


@query(f"""WITH {LOGITS}, {SOFT}, c AS (SELECT *, round(sum(p) OVER (PARTITION BY pos ORDER BY cls ROWS UNBOUNDED PRECEDING), 9) AS cum FROM sm)
  SELECT pos, min(cls) AS cls FROM c WHERE cum > {uniform_sql(9, 'pos')} OR cls = 63 GROUP BY pos""")
def sample_inverse_cdf(spark, sf_dir):
    return decode.draw(logits(spark, sf_dir), 9).select("pos", "cls")


@query(f"""WITH {GRID}, s AS (SELECT *, ((0.25::DOUBLE + 0.5::DOUBLE * {uniform_sql('1:prop', 'item')}) * 100)::DOUBLE AS d, {uniform_sql('1:start', 'item')} AS u FROM gr),
  a AS (SELECT *, trunc(d)::INT AS span FROM s), b AS (SELECT *, floor(u * greatest(100 - span, 1))::INT AS st FROM a)
  SELECT item, codebook, frame, NOT (frame >= st AND frame < st + span) AS keep FROM b""")
def span_mask(spark, sf_dir):
    spans = decode.drawn_spans(grid_items(spark, sf_dir), 0.25, 0.75, 100, 1)
    return positions(spans).select("item", "codebook", "frame", decode.span_mask(F.col("frame")).alias("keep"))


@query(f"""WITH {GRID}, b AS (SELECT *, (item % 9)::INT AS cur, {uniform_sql(2, 'item', 'codebook', 'frame')} > 0.4 AS rand, frame < 20 AS span FROM gr)
  SELECT item, codebook, frame, (NOT (codebook > cur OR (codebook = cur AND NOT rand))) OR span AS keep FROM b""")
def combine_masks(spark, sf_dir):
    g = grid(spark, sf_dir)
    rand = above(0.4, 2, F.col("item"), F.col("codebook"), F.col("frame"))
    return g.select("item", "codebook", "frame", decode.combined_mask(F.col("frame") < 20, F.col("codebook"), (F.col("item") % 9).cast("int"), rand).alias("keep"))


@query(f"""WITH {GRID}, b AS (SELECT item, frame, {uniform_sql(4, 'item', 'frame')} AS p, frame % 3 <> 0 AS masked FROM gr WHERE codebook = 0),
  s AS (SELECT *, round(ln(greatest(p, 1e-12)) + 0.5 * (-ln(-ln(least(greatest({uniform_sql(6, 'item', 'frame')}, 1e-6), 1 - 1e-6)))), 9) AS s FROM b),
  r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY masked DESC, s DESC, frame) AS r, sum(masked::INT) OVER (PARTITION BY item) AS m FROM s)
  SELECT item, frame, NOT masked OR r <= greatest(m - 40, 0) AS keep FROM r""")
def confidence_unmask(spark, sf_dir):
    g = grid(spark, sf_dir).filter("codebook = 0").select("item", "frame", uniform(4, F.col("item"), F.col("frame")).alias("p"), (F.col("frame") % 3 != 0).alias("masked"))
    return decode.unmask_by_confidence(g, F.lit(40), 0.5, 6).select("item", "frame", "keep")


@query("SELECT i::BIGINT AS step, round(least(greatest(cos(i / 64.0::DOUBLE * pi() / 2), 1e-10), 1.0), 6) AS share FROM range(65) r(i)")
def cosine_schedule(spark, sf_dir):
    return spark.range(65).select(F.col("id").alias("step"), r6(decode.cosine_schedule(F.col("id") / 64), "share"))


CE = "g AS (SELECT pos, codebook, target, max(logit) AS m, avg(logit) AS mean, max(logit) FILTER (WHERE cls = target) AS hit, arg_max(cls, [logit, -cls]) AS best FROM lg GROUP BY ALL), ls AS (SELECT pos, any_value(g.m) + ln(sum(exp(logit - g.m))) AS lse FROM lg JOIN g USING (pos) GROUP BY pos), ce AS (SELECT pos, codebook, -(0.9 * (hit - lse) + 0.1 * (mean - lse)) AS loss, (best = target)::INT AS correct FROM g JOIN ls USING (pos))"


@query(f"WITH {LOGITS}, {CE} SELECT pos, round(loss, 6) AS loss, correct FROM ce")
def softmax_ce_smoothed(spark, sf_dir):
    return metrics.cross_entropy(logits(spark, sf_dir), 0.1).select("pos", r6("loss", "loss"), "correct")


@query(f"WITH {LOGITS}, {CE}, i AS (SELECT pos % 10 AS item, codebook, avg(loss) AS l FROM ce GROUP BY ALL) SELECT codebook, round(avg(l), 6) AS loss FROM i GROUP BY 1")
def metric_by_codebook(spark, sf_dir):
    ce = metrics.cross_entropy(logits(spark, sf_dir), 0.1).withColumn("item", F.col("pos") % 10)
    return metrics.macro(ce, "item", "codebook", "loss").select("codebook", r6("loss", "loss"))


@query(f"""WITH {LOGITS}, {CE} SELECT codebook, round(avg(loss * (pos % 4 <> 0)::INT), 6) AS unnormalised, round(sum(loss * (pos % 4 <> 0)::INT) / greatest(sum((pos % 4 <> 0)::INT), 1), 6) AS normalised,
  round(sum(correct * (pos % 4 <> 0)::INT)::DOUBLE / greatest(sum((pos % 4 <> 0)::INT), 1), 6) AS accuracy FROM ce GROUP BY 1""")
def masked_losses(spark, sf_dir):
    k = (F.col("pos") % 4 != 0).cast("int")
    n = F.greatest(F.sum(k), F.lit(1))
    return metrics.cross_entropy(logits(spark, sf_dir), 0.1).groupBy("codebook").agg(r6(F.avg(F.col("loss") * k), "unnormalised"), r6(F.sum(F.col("loss") * k) / n, "normalised"), r6(F.sum(F.col("correct") * k) / n, "accuracy"))


@query(f"""WITH {LOGITS}, te AS (SELECT pos, cls, logit, max(logit) OVER p AS m FROM lg WINDOW p AS (PARTITION BY pos)), st AS (SELECT pos, 63 - cls AS cls, logit, m FROM te),
  t AS (SELECT pos, cls, (logit - m) / 2 - ln(sum(exp((logit - m) / 2)) OVER (PARTITION BY pos)) AS t FROM te), s AS (SELECT pos, cls, (logit - m) / 2 - ln(sum(exp((logit - m) / 2)) OVER (PARTITION BY pos)) AS s FROM st)
  SELECT pos, round(sum(exp(t) * (t - s)) * 4, 6) AS kl FROM t JOIN s USING (pos, cls) GROUP BY pos""")
def distill_kl(spark, sf_dir):
    t = logits(spark, sf_dir).select("pos", "cls", "logit")
    return metrics.distill_kl(t.withColumn("cls", 63 - F.col("cls")), t, 2.0).select("pos", r6("kl", "kl"))


@query("""WITH f AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, i, v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS x FROM f, range(1, 65) r(i)),
  d AS (SELECT a.vec_id AS frame, b.vec_id AS code, round(sum(a.x * b.x), 9) AS dot FROM u a JOIN u b USING (i) WHERE b.vec_id < 16 GROUP BY ALL)
  SELECT frame, arg_max(code, [dot, -code]) AS code FROM d GROUP BY frame""")
def vq_nearest(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("v"))
    return metrics.nearest_code(v, v.filter("frame < 16").withColumnRenamed("frame", "code")).select("frame", "code")


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS step, sum(o_totalprice) AS loss FROM orders GROUP BY 1)
  SELECT strftime(step, '%Y-%m') AS step, round(loss, 2) AS loss, round(loss, 2) <= min(round(loss, 2)) OVER (ORDER BY step) AS best FROM m""")
def best_so_far(spark, sf_dir):
    m = load(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("step")).agg(F.round(F.sum("o_totalprice"), 2).alias("loss"))
    return m.select("step", "loss", (F.col("loss") <= F.min("loss").over(W.orderBy("step"))).alias("best"))


@query("""WITH c AS (SELECT conv_id // 8 AS batch_id, conv_id, count(*) AS n FROM conversations GROUP BY ALL)
  SELECT batch_id::BIGINT AS batch_id, max(n) AS width, sum(n)::BIGINT AS used, round(1 - sum(n)::DOUBLE / (count(*) * max(n)), 6) AS pad_share FROM c GROUP BY 1""")
def pad_share(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").groupBy(F.floor(F.col("conv_id") / 8).alias("batch_id"), "conv_id").agg(F.count("*").alias("n"))
    return c.groupBy("batch_id").agg(F.max("n").alias("width"), F.sum("n").alias("used"), r6(1 - F.sum("n") / (F.count("*") * F.max("n")), "pad_share"))
