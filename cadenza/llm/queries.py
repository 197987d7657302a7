"""Registered queries opN_<name> of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, exact_dedup, minhash, mixing, ngram_join, packing, repair, runs, sharding, toxicity, url_filter, warc
from .common import WORD, table


def held_out() -> Column:
    """Whether crc32(doc_id as text) leaves 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are all pages, fetched in 2024 on a day that the id decides. The list has, for every host
    and parent domain that occurs, alone and with each leading directory, entries on days that the MD5
    of the pattern decides."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")).alias("fetched"))
    patterns = pages.select(F.explode(url_filter.covering_patterns(F.col("url"))).alias("pattern")).distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (F.conv(F.substring(F.md5("pattern"), 4 * n + 1, 4), 16, 10).cast("int") % 365))
    flip = F.substring(F.md5("pattern"), 32, 1) < "8"
    entries = None
    for n, act in enumerate(("block", "allow", "block")):
        part = patterns.filter(flip if n else F.lit(True)).select("pattern", F.lit(act).alias("action"), day(n).alias("at"))
        entries = part if entries is None else entries.unionByName(part)
    return url_filter.decide(captures, entries)


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a chosen one; in its rejected twin the last turn's text is the last
    turn's text of the conversation next to it (ids that differ in the lowest bit), or empty."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("last"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.coalesce("last", F.lit("")).alias("reply"))
    ends = last.select("conv_id", F.col("turn").alias("end")).join(other, "conv_id", "left")
    rejected = turns.join(ends, "conv_id").select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(F.col("turn") == F.col("end"), F.coalesce("reply", F.lit(""))).otherwise(F.col("text")).alias("text"))
    pairs = chat.preference_pairs(turns.withColumnRenamed("conv_id", "pair_id"), rejected)
    flat = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return pairs.select("pair_id", "n_common", "prompt", "chosen", "rejected", flat("chosen_spans").alias("chosen_spans"), flat("rejected_spans").alias("rejected_spans"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"), 24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of conversations with faults that crc32 of ``conv_id:turn`` decides."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", one_space("role").alias("role"), one_space("text").alias("text"), h.alias("h")).filter("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    conversations, repaired = repair.repairs(damaged(turns))
    every = turns.select("conv_id").distinct().withColumn("thread", repair.thread_of(F.col("conv_id")))
    found = every.join(conversations.drop("conv_id"), "thread", "left").join(repair.digests(repaired), "thread", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def looped(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``; in a tenth of them, by crc32 of the id, the words after a place go round with a period that it decides.

    A null id has no crc32 and leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(words: Column) -> Column:
        n = F.size(words)
        a = F.when(n > 0, g % n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: words[at(i)]), " ")).otherwise("")

    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(words), turned)[0]).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(looped(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    period = -F.col("best.period")
    return found.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("best.length") / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_warc, op3_toxicity, op4_ngram_jaccard, op5_source_mix, op6_nn_descent, op7_packing, op8_url_filter, op9_preferences, op10_kd_shards, op11_repair, op12_minhash_bayes, op13_periodic_runs)}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
        g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)""",
    "op2_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, url FROM pages),
        r AS (SELECT *, payload_bytes >= 100 AND row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, encode(url) NULLS FIRST) > 1 AS again, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, payload_bytes, sha256(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r""",
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(id, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.v = e.a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
        JOIN (SELECT id, min(v) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id""",
    "op5_source_mix": r"""
        WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
        t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
        w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM t),
        l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
            sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
            (sum(source_size) OVER ()) * 1.5::DOUBLE AS total,
            row_number() OVER (ORDER BY cap / w, encode(source) NULLS LAST) AS i FROM w),
        v AS (SELECT arg_min((total - before) / after, i) FILTER (WHERE (total - before) / after <= cap / w) AS level FROM l),
        r AS (SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target FROM l, v),
        b AS (SELECT *, floor(target + 1e-9)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 1e-9)::BIGINT // source_size ELSE 0 END AS epochs FROM r),
        c AS (SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
            sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS fin
            FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - (fin - size))))::BIGINT AS taken FROM c""",
    "op8_url_filter": r"""
        WITH u AS (SELECT page_id, url, (DATE '2024-01-01' + (page_id % 365)::INT)::DATE AS fetched,
            lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages),
        v AS (SELECT *, unnest(range(1, greatest(2, len(string_split(host, '.'))))) AS k,
            list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1)), '/'), lambda x: x <> '') AS parts FROM u WHERE coalesce(host, '') <> ''),
        y AS (SELECT page_id, fetched, k, parts, array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.') AS domain FROM v),
        d AS (SELECT page_id, fetched, 1000000000 + k AS i, domain AS pattern FROM y
            UNION ALL SELECT page_id, fetched, 100000 * k - n, domain || '/' || array_to_string(list_slice(parts, 1, n), '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM y)),
        p AS (SELECT DISTINCT pattern, md5(pattern) AS m FROM d),
        e AS (SELECT pattern, action, (DATE '2024-01-01' + (('0x' || substr(m, 4 * n + 1, 4))::INT % 365))::DATE AS since
            FROM p, (VALUES (0, 'block'), (1, 'allow'), (2, 'block')) v(n, action) WHERE n = 0 OR substr(m, 32, 1) < '8'),
        o AS (SELECT pattern, since, max(action) AS action FROM e GROUP BY ALL),
        s AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM o),
        h AS (SELECT u.page_id, d.i, s.pattern, s.action, s.since FROM u LEFT JOIN d USING (page_id)
            LEFT JOIN s ON d.pattern = s.pattern AND u.fetched >= s.since AND (s.until IS NULL OR u.fetched < s.until))
        SELECT page_id, coalesce(arg_min(action, i) FILTER (WHERE pattern IS NOT NULL) <> 'block', true) AS allowed,
          arg_min(pattern, i) FILTER (WHERE pattern IS NOT NULL) AS pattern, arg_min(action, i) FILTER (WHERE pattern IS NOT NULL) AS action,
          arg_min(since, i) FILTER (WHERE pattern IS NOT NULL) AS since, count(pattern) AS n_active
        FROM h GROUP BY page_id""",
    "op9_preferences": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, max(turn) OVER (PARTITION BY conv_id) AS fin FROM conversations),
        l AS (SELECT xor(conv_id, 1) AS conv_id, text AS reply FROM t WHERE turn = fin),
        r AS (SELECT t.conv_id, turn, role, text, CASE WHEN turn = fin THEN coalesce(reply, '') ELSE text END AS other FROM t LEFT JOIN l ON t.conv_id = l.conv_id),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
            '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS a, '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) AS b FROM r),
        m AS (SELECT *, coalesce(min(CASE WHEN text <> other THEN i END) OVER (PARTITION BY conv_id) - 1, count(*) OVER (PARTITION BY conv_id)) AS n_common FROM n),
        z AS (SELECT *, i > n_common AS tail,
            coalesce(sum(CASE WHEN i > n_common THEN length(a) END) OVER (PARTITION BY conv_id ORDER BY i), 0) AS za,
            coalesce(sum(CASE WHEN i > n_common THEN length(b) END) OVER (PARTITION BY conv_id ORDER BY i), 0) AS zb FROM m)
        SELECT conv_id AS pair_id, max(n_common)::INT AS n_common, coalesce(string_agg(a, '' ORDER BY i) FILTER (WHERE NOT tail), '') AS prompt,
          coalesce(string_agg(a, '' ORDER BY i) FILTER (WHERE tail), '') AS chosen, coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE tail), '') AS rejected,
          coalesce(string_agg((za - length(a) + length(role) + 5)::BIGINT || '-' || (za - 1)::BIGINT, ',' ORDER BY i) FILTER (WHERE tail AND role = 'assistant'), '') AS chosen_spans,
          coalesce(string_agg((zb - length(b) + length(role) + 5)::BIGINT || '-' || (zb - 1)::BIGINT, ',' ORDER BY i) FILTER (WHERE tail AND role = 'assistant'), '') AS rejected_spans
        FROM z GROUP BY conv_id""",
}

# the same rule with another threshold, and whether a row is the one that stays
ORACLES["op12_minhash_bayes"] = ORACLES["op4_ngram_jaccard"].replace("100 * c >= 90 *", "100 * c >= 85 *").replace("c.component_id FROM", "c.component_id, d.doc_id = c.component_id AS kept FROM")


def _repair_sql() -> str:
    """Forward over the turns of each conversation, with the least (cost, audit, text) of every grammar state."""
    least = lambda *x: f"list_min([{', '.join(x)}])"
    more = lambda s, cost, letter, line: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'z': {s}.z || {line}}} END"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    inserted2 = least("s2", *(more(s, 3, "I", user) for s in ("s0", "s1", "s3")))
    inserted3 = least("s3", more("s2", 3, "I", assistant), *(more(s, 6, "II", f"{user} || {assistant}") for s in ("s0", "s1")))
    cut = "CASE WHEN fault = 't' THEN 3 ELSE 0 END"
    gone = lambda s: more(s, 4, "D", "''")
    keep = lambda s, letter: f"CASE WHEN fault IN ('', 't') AND initial = '{letter}' THEN {more(s, cut, 'K', "chr(10) || role || ':' || text")} END"
    turn = lambda s, role: f"CASE WHEN fault IN ('', 't') THEN {more(s, f'3 + {cut}', 'R', f"{role} || text")} END"
    return rf"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS cs, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(turn::VARCHAR, ' ') AS ts FROM conversations),
        c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(cs || ':' || ts, ''), lambda x: ord(x)::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS h FROM k),
        d AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN '-' ELSE '+' || cs END AS thread, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
            CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE h <> 0),
        e AS (SELECT *, left(role, 1) AS initial, regexp_extract(text, '([^ 	-
])[ 	-
]*\z', 1) AS fin, length(thread) || ':' || thread || length(role) || ':' || role || text AS said FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY turn NULLS FIRST, encode(role), sha256(said), copy) AS i FROM e),
        m AS (SELECT *, row_number() OVER (PARTITION BY thread, role, text ORDER BY i) AS nth FROM r),
        f AS (SELECT *, CASE WHEN fin = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN fin NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
            lag(initial) OVER (PARTITION BY thread ORDER BY i) || initial AS pair FROM m),
        n AS (SELECT thread, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'b')::BIGINT AS blank, count_if(fault = 'd')::BIGINT AS duplicate,
            count_if(fault = 't')::BIGINT AS truncated, count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS turns FROM f GROUP BY thread),
        w AS (SELECT thread, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'z': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, z VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, z VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, z VARCHAR) AS s3 FROM n
            UNION ALL SELECT thread, i, {gone("s0")}, {least(gone("s1"), keep("s0", "s"))},
                {least(gone("s2"), *(keep(s, "u") for s in ("s0", "s1", "s3")), *(turn(s, "chr(10) || 'user:'") for s in ("s0", "s1", "s3")))},
                {least(gone("s3"), keep("s2", "a"), turn("s2", "chr(10) || 'assistant:'"))}
            FROM (SELECT thread, f.i, role, text, initial, fault, s0, s1, {inserted2} AS s2, {inserted3} AS s3 FROM w JOIN f USING (thread) WHERE f.i = w.i + 1)),
        a AS (SELECT thread, {least("s0", inserted3)} AS x FROM w JOIN n USING (thread) WHERE w.i = n.turns)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
          coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(substr(x.z, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN '-' ELSE '+' || conv_id END AS thread FROM conversations) o LEFT JOIN n USING (thread) LEFT JOIN a USING (thread)"""


ORACLES["op11_repair"] = _repair_sql()
