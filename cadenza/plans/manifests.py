"""Registered queries of files, manifests and small projections, beside their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import files
from ..operators import items as it
from ..sources.tables import load
from .catalogue import query, r6

PATHS = "pa AS (SELECT doc_id, source, lang, n_chars, source || '/' || CASE WHEN doc_id % 6 = 0 THEN '.hidden/' WHEN doc_id % 4 = 1 THEN 'Noise/' ELSE '' END || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.wav' WHEN doc_id % 3 = 1 THEN '_mixture.wav' ELSE '.aiff' END AS path FROM documents)"


def _paths(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 6 == 0, ".hidden/").when(F.col("doc_id") % 4 == 1, "Noise/").otherwise("")
    end = F.when(F.col("doc_id") % 3 == 0, ".wav").when(F.col("doc_id") % 3 == 1, "_mixture.wav").otherwise(".aiff")
    return d.select("doc_id", "source", "lang", "n_chars", F.concat("source", F.lit("/"), folder, F.col("doc_id").cast("string"), end).alias("path"))


@query(f"WITH {PATHS} SELECT doc_id, path, lower(path) AS sort_key FROM pa WHERE suffix(path, '.wav')")
def scan_suffix(spark, sf_dir):
    return files.in_path_order(files.with_suffix(_paths(spark, sf_dir), ".wav")).select("doc_id", "path", F.lower("path").alias("sort_key"))


@query(f"WITH {PATHS} SELECT doc_id, regexp_extract(path, '^(.*/)?[^/]*$', 1) || 'drums' || regexp_extract(path, '[^/](\\.[^./]*)$', 1) AS drums FROM pa")
def sibling_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", files.sibling(F.col("path"), F.lit("drums")).alias("drums"))


@query("""WITH p AS (SELECT doc_id, source || '/' || lang || '/mixture.wav' AS path FROM documents),
  f AS (SELECT DISTINCT source || '/' || lang || '/' || CASE WHEN doc_id // 40 % 2 = 0 THEN 'drums' ELSE 'bass' END || '.wav' AS path FROM documents WHERE doc_id % 3 <> 0 AND lang <> 'es')
  SELECT doc_id, path FROM p WHERE replace(path, 'mixture', 'drums') IN (SELECT path FROM f) AND replace(path, 'mixture', 'bass') IN (SELECT path FROM f)""")
def sibling_existing(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    folder = F.concat("source", F.lit("/"), "lang", F.lit("/"))
    rows = d.select("doc_id", F.concat(folder, F.lit("mixture.wav")).alias("path"))
    there = d.filter("doc_id % 3 <> 0 and lang <> 'es'").select(F.concat(folder, F.when(F.floor(F.col("doc_id") / 40) % 2 == 0, "drums").otherwise("bass"), F.lit(".wav")).alias("path"))
    return files.with_all_siblings(rows, there, ["drums", "bass"]).select("doc_id", "path")


@query("SELECT doc_id, 'lang=' || lang || ';n_chars=' || n_chars AS meta FROM documents")
def meta_map(spark, sf_dir):
    m = load(spark, sf_dir, "documents").select("doc_id", files.meta_map(["n_chars", "lang"]).alias("m"))
    return m.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("meta"))


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars / 1000 END AS s FROM documents WHERE doc_id % 5 <> 0)
  SELECT d.doc_id, least(a.s, b.s) AS min_duration FROM documents d JOIN f a ON a.doc_id = d.doc_id JOIN f b ON b.doc_id = d.doc_id + 1 WHERE a.s IS NOT NULL AND b.s IS NOT NULL AND least(a.s, b.s) > 0""")
def strict_files(spark, sf_dir):
    return _with_files(spark, sf_dir, True)


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars / 1000 END AS s FROM documents WHERE doc_id % 5 <> 0)
  SELECT d.doc_id, least(a.s, b.s) AS min_duration FROM documents d LEFT JOIN f a ON a.doc_id = d.doc_id LEFT JOIN f b ON b.doc_id = d.doc_id + 1 WHERE least(a.s, b.s) > 0""")
def lenient_files(spark, sf_dir):
    return _with_files(spark, sf_dir, False)


def _with_files(spark, sf_dir, strict):
    d = load(spark, sf_dir, "documents")
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    there = d.filter("doc_id % 5 <> 0").select(name(F.col("doc_id")).alias("path"), F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") / 1000).alias("duration"))
    rows = d.select("doc_id", name(F.col("doc_id")).alias("drums"), name(F.col("doc_id") + 1).alias("bass"))
    return files.existing(rows, there, {"drums": "drums", "bass": "bass"}, strict).select("doc_id", "min_duration")


@query("SELECT doc_id FROM documents WHERE n_chars / 1000 >= 4.0 AND 8000 * (1 + doc_id % 4) >= 22050")
def rate_predicate(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("duration"), (8000 * (1 + F.col("doc_id") % 4)).alias("sample_rate"))
    return it.long_and_fast(d, 4.0, 22050).select("doc_id")


@query(f"""WITH {PATHS}, n AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '.x' WHEN doc_id % 5 = 0 THEN 'Drum ' || lang WHEN doc_id % 7 = 0 THEN lang || ' PERCUSSION' ELSE lang END AS name FROM pa)
  SELECT doc_id, CASE WHEN contains(lower(name), 'drum') THEN 'drums' WHEN contains(lower(name), 'percussion') THEN 'percussion' ELSE 'other' END AS class FROM n WHERE NOT starts_with(name, '.')""")
def directory_class(spark, sf_dir):
    i = F.col("doc_id")
    name = F.when(i % 9 == 0, ".x").when(i % 5 == 0, F.concat(F.lit("Drum "), "lang")).when(i % 7 == 0, F.concat("lang", F.lit(" PERCUSSION"))).otherwise(F.col("lang"))
    return load(spark, sf_dir, "documents").select("doc_id", files.drum_class(name).alias("class")).filter("class is not null")


@query(f"WITH {PATHS} SELECT doc_id, CASE WHEN contains(lower(path), 'noise') THEN 'noise' ELSE 'response' END AS kind FROM pa")
def noise_split(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", it.noise_or_response(F.col("path")).alias("kind"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'val' ELSE 'test' END AS split FROM documents")
def named_split(spark, sf_dir):
    of = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "fr", "val").otherwise("test")
    return load(spark, sf_dir, "documents").select("doc_id", files.named_split(of).alias("split"))


@query("""SELECT 0 AS source_idx, doc_id AS id, lang FROM documents UNION ALL SELECT 1, item_id, NULL FROM benchmark UNION ALL SELECT 0, doc_id, lang FROM documents""")
def united_manifests(spark, sf_dir):
    a = load(spark, sf_dir, "documents").select(F.lit(0).alias("source_idx"), F.col("doc_id").alias("id"), "lang")
    b = load(spark, sf_dir, "benchmark").select(F.lit(1).alias("source_idx"), F.col("item_id").alias("id"))
    return files.united([a, b, a])


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def other_directories(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    bad = d.join(load(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("source")
    return it.all_but(d.select("source"), bad)


@query("SELECT lang || '/' || source AS path FROM documents UNION SELECT lang || '/' || (doc_id % 3) FROM documents")
def file_union(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    a, b = d.select(F.concat("lang", F.lit("/"), "source").alias("path")), d.select(F.concat("lang", F.lit("/"), (F.col("doc_id") % 3).cast("string")).alias("path"))
    return files.in_path_order(files.united([a, b]).distinct())


@query("SELECT doc_id, e.e::INT AS epoch FROM documents, range(3) e(e)")
def repeated_epochs(spark, sf_dir):
    return files.repeated(load(spark, sf_dir, "documents").select("doc_id"), 3)


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, round(sum(o_totalprice), 2) AS loss FROM orders GROUP BY 1),
  s AS (SELECT row_number() OVER (ORDER BY month) AS step, loss FROM m)
  SELECT step, loss, concat_ws(',', 'latest', CASE WHEN loss <= min(loss) OVER (ORDER BY step) THEN 'best' END, CASE WHEN step IN (5, 20, 40) THEN step::VARCHAR END) AS tags FROM s""")
def checkpoint_tags(spark, sf_dir):
    from pyspark.sql import Window as W

    m = load(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("loss"))
    steps = m.select(F.row_number().over(W.orderBy("month")).cast("long").alias("step"), "loss")  # a row a month
    return it.checkpoint_tags(steps, [5, 20, 40])


@query("SELECT event_id, nullif(nullif(round(value / 490, 1), 0), 1) AS top_p, nullif(event_id % 5, 0) AS top_k, nullif((event_id % 3)::DOUBLE, 0) AS guidance FROM events")
def disabled_sentinels(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.round(F.col("value") / 490, 1).alias("top_p"), (F.col("event_id") % 5).alias("top_k"), (F.col("event_id") % 3).cast("double").alias("guidance"))
    return e.select("event_id", it.off_at(F.col("top_p"), 0, 1).alias("top_p"), it.off_at(F.col("top_k"), 0).alias("top_k"), it.off_at(F.col("guidance"), 0).alias("guidance"))


@query("""SELECT event_id, coalesce(nullif(round(value / 490, 1), 0), 1.0) AS temperature, greatest(coalesce(nullif(event_id % 4, 0), 1), 1) AS iterations,
  CASE WHEN event_id % 2 = 0 THEN '7,7,7' ELSE '1,2,3' END AS steps FROM events""")
def sampling_arguments(spark, sf_dir):
    steps = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(7))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    e = load(spark, sf_dir, "events")
    return e.select("event_id", it.or_default(F.round(F.col("value") / 490, 1), 1.0).alias("temperature"), F.greatest(it.or_default(F.col("event_id") % 4, 1), F.lit(1)).alias("iterations"), F.array_join(it.per_codebook(steps, 3).cast("array<string>"), ",").alias("steps"))


@query("SELECT doc_id, toxic IS NOT NULL AS known FROM documents LEFT JOIN labels USING (doc_id)")
def known_value(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.select("doc_id", it.is_known(F.col("toxic")).alias("known"))


@query("SELECT conv_id, turn, floor(100 * length(text) / (max(length(text)) OVER (PARTITION BY conv_id // 8))::DOUBLE)::BIGINT AS tokens FROM conversations WHERE length(text) > 0")
def token_length(spark, sf_dir):
    from pyspark.sql import Window as W

    c = load(spark, sf_dir, "conversations").filter(F.length("text") > 0).withColumn("n", F.length("text"))
    longest = F.max("n").over(W.partitionBy(F.floor(F.col("conv_id") / 8)))
    return c.select("conv_id", "turn", it.token_length(100, F.col("n"), longest).alias("tokens"))


@query("""SELECT l_returnflag AS stem, max(trunc(l_quantity * l_discount * 441))::BIGINT AS longest, count(*) FILTER (WHERE l_tax > 0.04) AS written, count(DISTINCT CASE WHEN l_tax > 0.04 THEN l_orderkey END) AS tracks FROM lineitem GROUP BY 1""")
def stem_counters(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), F.col("l_returnflag").alias("stem"), (F.col("l_quantity") * F.col("l_discount")).alias("seconds"), (F.col("l_tax") > 0.04).alias("written"))
    return it.stem_counters(li, 441)


@query("""WITH b AS (SELECT o_orderstatus AS run, o_orderkey // 100 AS batch, round(avg(o_totalprice), 4) AS metric FROM orders GROUP BY ALL)
  SELECT run, arg_max(metric, batch) AS last, round(avg(metric), 4) AS mean FROM b GROUP BY 1""")
def last_batch(spark, sf_dir):
    b = load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("run"), F.floor(F.col("o_orderkey") / 100).alias("batch")).agg(F.round(F.avg("o_totalprice"), 4).alias("metric"))
    return it.last_and_mean(b, "run", "batch", "metric").select("run", "last", F.round("mean", 4).alias("mean"))


@query("""WITH c AS (SELECT user_id AS signal_id, day(ts)::INT AS t, event_type, round(sum(value) - 250, 6) AS x FROM events GROUP BY ALL)
  SELECT signal_id, t, round(sum(x), 6) AS total, round(max(abs(x)), 6) AS peak FROM c GROUP BY ALL""")
def side_chain(spark, sf_dir):
    c = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("signal_id"), F.dayofmonth("ts").alias("t"), "event_type").agg(F.round(F.sum("value") - 250, 6).alias("x"))
    a, b = (it.side_chain(c, ["signal_id"], kind) for kind in ("sum", "peak"))
    return a.select("signal_id", "t", r6("x", "total")).join(b.select("signal_id", "t", r6("x", "peak")), ["signal_id", "t"])


@query("SELECT sum(len(embedding))::BIGINT AS parameters FROM embeddings")
def parameter_count(spark, sf_dir):
    return it.parameter_count(load(spark, sf_dir, "embeddings").select(F.array(F.size("embedding")).alias("shape")))


@query("SELECT event_id, greatest(1, round_even(value / 1000.0::DOUBLE * 44100 / 512, 0))::BIGINT AS frames FROM events")
def ms_to_frames(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", it.ms_to_frames(F.col("value"), 44100, 512).alias("frames"))


@query("SELECT source, min(n_chars) AS shortest, count(*) AS uses FROM documents GROUP BY source")
def work_per_value(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("source", "n_chars")
    return it.per_distinct(d, ["source"], F.min("n_chars").alias("shortest"))


@query("""WITH p AS (SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cum FROM events),
  c AS (SELECT item, unnest([5, 10, 20]) AS i FROM (SELECT DISTINCT item FROM p)) SELECT c.item, c.i::INT AS i, round(cum, 6) AS cum FROM c JOIN p USING (item, i)""")
def gather_by_index(spark, sf_dir):
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    p = load(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.row_number().over(order).alias("i"), F.sum("value").over(order).alias("cum"))
    cuts = p.select("item").distinct().select("item", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))).alias("i"))
    return it.gathered(p, cuts, ["item"], "i").select("item", "i", r6("cum", "cum"))
