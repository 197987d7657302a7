"""Registered queries of the residual quantiser, of batches in splits and of a transformer layer, beside their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generation, quantise, transformer
from ..sources.tables import load
from .catalogue import query, r6
from .kernels import VEC, _vectors

LEVELS, WIDTH, CODES = 3, 8, 16


def _tables(v):
    """Projections and codebooks of the first vectors: rows 16 to 63 are codes of three levels, 64 to 87 projections, forth and back."""
    i = F.col("vec_id")
    books = v.filter(i.between(16, 15 + LEVELS * CODES)).select(F.floor((i - 16) / CODES).cast("int").alias("level"), i.alias("code"), F.slice("v", 1, WIDTH).alias("c"))
    rows = v.filter(i.between(64, 63 + LEVELS * WIDTH)).groupBy(F.floor((i - 64) / WIDTH).cast("int").alias("level")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("r"))
    inward = F.transform("r", lambda x: F.transform(x["v"], lambda y: y / WIDTH))
    back = F.transform(F.sequence(F.lit(0), F.size(F.col("r")[0]["v"]) - 1), lambda d: F.transform("r", lambda x: F.get(x["v"], d)))
    levels = rows.select("level", inward.alias("inward"), F.array_repeat(F.lit(0.01), WIDTH).alias("inward_bias"), back.alias("outward"), F.array_repeat(F.lit(-0.01), F.size(F.col("r")[0]["v"])).alias("outward_bias"))
    return levels, books


def _levels_sql() -> str:
    """CTEs that end in ``l3(frame, v, r, k0, k1, k2)``."""
    norm = lambda x: f"greatest(sqrt(list_dot_product({x}, {x})), 1e-12)"
    parts = [f"{VEC}, l0 AS (SELECT vec_id AS frame, v, v AS r FROM ev), ow AS (SELECT vec_id AS code, v[1:{WIDTH}] AS c, (vec_id - 16) // {CODES} AS level FROM ev WHERE vec_id BETWEEN 16 AND {15 + LEVELS * CODES})",
             f"pj AS (SELECT (vec_id - 64) // {WIDTH} AS level, list(v ORDER BY vec_id) AS m FROM ev WHERE vec_id BETWEEN 64 AND {63 + LEVELS * WIDTH} GROUP BY 1)",
             "oo AS (SELECT level, code, c, list_transform(range(1, 65), lambda d: list_dot_product(c, list_transform(m, lambda w: w[d])) - 0.01::DOUBLE) AS o FROM ow JOIN pj USING (level))"]
    for i in range(LEVELS):
        had = "".join(f", k{j}" for j in range(i))
        parts += [f"z{i} AS (SELECT frame, v, r{had}, list_transform(m, lambda w: list_dot_product(r, w) / {WIDTH} + 0.01::DOUBLE) AS z FROM l{i}, pj WHERE level = {i})",
                  f"b{i} AS (SELECT frame, arg_max(code, [round(list_dot_product(z, c) / ({norm('z')} * {norm('c')}), 9), -code]) AS k{i} FROM z{i}, ow WHERE level = {i} GROUP BY frame)",
                  f"l{i + 1} AS (SELECT frame, v, list_transform(list_zip(r, o), lambda x: x[1] - x[2]) AS r{had}, k{i} FROM z{i} JOIN b{i} USING (frame) JOIN oo ON code = k{i} AND level = {i})"]
    return ", ".join(parts)


@query(f"WITH {_levels_sql()} SELECT frame, k0 || ',' || k1 || ',' || k2 AS codes, round(list_dot_product(r, r), 6) AS error FROM l3")
def residual_encode(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    got = quantise.encoded(v.select(F.col("vec_id").alias("frame"), "v"), *_tables(v))
    return got.select("frame", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), r6(F.aggregate("residual", F.lit(0.0), lambda a, x: a + x * x), "error"))


@query(f"WITH {_levels_sql()} SELECT frame, (i - 1)::INT AS dim, round(v[i] - r[i], 6) + 0.0 AS x FROM l3, range(1, 65) d(i)")
def residual_decode(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    levels, books = _tables(v)
    codes = quantise.encoded(v.select(F.col("vec_id").alias("frame"), "v"), levels, books).select("frame", "codes")
    return quantise.decoded(codes, levels, books).select("frame", F.posexplode("quantised").alias("dim", "x")).select("frame", "dim", (F.round("x", 6) + 0.0).alias("x"))


@query("""WITH c AS (SELECT conv_id // 8 AS batch, conv_id AS item, list(length(text)::DOUBLE ORDER BY turn) AS v FROM conversations GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY item) - 1 AS i, count(*) OVER (PARTITION BY batch) AS n, 1 + batch % 4 AS s FROM c), p AS (SELECT *, (i // ((n + s - 1) // s))::INT AS part FROM n)
  SELECT batch, part, item, len(v)::INT AS length, array_to_string(list_transform(list_resize(v, max(len(v)) OVER (PARTITION BY batch, part), 0.0::DOUBLE), lambda x: x::BIGINT), ',') AS v FROM p""")
def collate_splits(spark, sf_dir):
    """Lengths of turns, eight conversations a batch, in one to four parts by batch."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("double").alias("n")))), lambda s: s["n"])
    rows = load(spark, sf_dir, "conversations").groupBy(F.floor(F.col("conv_id") / 8).alias("batch"), F.col("conv_id").alias("item")).agg(turns.alias("v"))
    return quantise.collated(rows, 1 + F.col("batch") % 4).withColumn("v", F.array_join(F.col("v").cast("array<bigint>").cast("array<string>"), ","))


#: Matrices of a layer of 64 channels, with rows and columns; their cells follow from their places, for want of trained ones.
MATRICES = [("q", 64, 64), ("k", 64, 64), ("v", 64, 64), ("out", 64, 64), ("cross_q", 64, 64), ("cross_k", 64, 64), ("cross_v", 64, 64), ("cross_out", 64, 64), ("up", 128, 64), ("down", 64, 128)]
HEADS = 4


def _weights(spark):
    names = spark.createDataFrame([(n, *m) for n, m in enumerate(MATRICES)], "n int, name string, rows int, columns int")
    rows = names.select("n", "name", "columns", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    cell = lambda j: ((F.col("row") * 31 + j * 17 + F.col("n") * 7) % 23 - 11) / 184.0
    return rows.select(F.lit(0).alias("layer"), "name", "row", F.transform(F.sequence(F.lit(0), F.col("columns") - 1), cell).alias("w"))


def _layer_sql() -> str:
    size = 64 // HEADS
    linear = lambda x, name: f"list_transform((SELECT m FROM mt WHERE name = '{name}'), lambda w: list_dot_product({x}, w))"
    norm = lambda x: f"list_transform({x}, lambda v: (v - list_aggregate({x}, 'avg')) / sqrt(list_aggregate({x}, 'var_pop') + 1e-5::DOUBLE))"
    part = lambda x: f"{x}[1 + h * {size}:{size} + h * {size}]"
    rms = lambda x: f"list_transform({x}, lambda v: v / sqrt(list_dot_product({x}, {x}) / {size} + 1e-8::DOUBLE))"
    angle = f"(pos / power(10000.0::DOUBLE, (i - 1) / {size // 2}.0::DOUBLE))"
    turned = lambda x: f"list_concat(list_transform(range(1, {size // 2 + 1}), lambda i: {x}[i] * cos({angle}) - {x}[i + {size // 2}] * sin({angle})), list_transform(range(1, {size // 2 + 1}), lambda i: {x}[i + {size // 2}] * cos({angle}) + {x}[i] * sin({angle})))"
    gelu = f"list_transform({linear('g', 'up')}, lambda u: 0.5::DOUBLE * u * (1 + (1 - 2 / (exp(2 * sqrt(2 / pi()) * (u + 0.044715::DOUBLE * u * u * u)) + 1))))"

    def attention(name: str, queries: str, keys: str) -> str:
        """CTEs that end in ``name(item, pos, o)``; both have rows item, pos, h and arrays."""
        return f"""{name}_s AS (SELECT a.item, a.pos, a.h, list_dot_product(a.q, b.k) / sqrt({size}) AS s, b.v FROM {queries} a JOIN {keys} b ON a.item = b.item AND a.h = b.h AND b.valid WHERE a.valid),
  {name}_e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY item, pos, h)) AS e FROM {name}_s),
  {name}_d AS (SELECT item, pos, h, d, sum(e * v[d]) / sum(e) AS o FROM {name}_e, range(1, {size + 1}) r(d) GROUP BY ALL),
  {name} AS (SELECT item, pos, list(o ORDER BY h, d) AS o FROM {name}_d GROUP BY ALL)"""

    zeros = "list_transform(range(64), lambda z: 0.0::DOUBLE)"
    add = lambda x, o, name: f"list_transform(list_zip({x}, {linear(f'coalesce({o}, {zeros})', name)}), lambda z: z[1] + z[2])"
    names = ", ".join(f"({n}, '{name}', {a}, {b})" for n, (name, a, b) in enumerate(MATRICES))
    return f"""{VEC}, nm AS (SELECT * FROM (VALUES {names}) v(n, name, a, b)), mr AS (SELECT name, n, unnest(range(a)) AS i, b FROM nm),
  mt AS (SELECT name, list(list_transform(range(b), lambda j: ((i * 31 + j * 17 + n * 7) % 23 - 11) / 184.0::DOUBLE) ORDER BY i) AS m FROM mr GROUP BY 1),
  rw AS (SELECT vec_id // 10 AS item, vec_id % 10 AS pos, v AS x, vec_id % 7 <> 3 AS valid FROM ev), cx AS (SELECT vec_id // 20 AS item, vec_id % 20 AS pos, v AS x, vec_id % 5 <> 1 AS valid FROM ev),
  n1 AS (SELECT *, {norm('x')} AS g FROM rw), p1 AS (SELECT *, {linear('g', 'q')} AS q, {linear('g', 'k')} AS k, {linear('g', 'v')} AS v FROM n1),
  h0 AS (SELECT item, pos, valid, h, {part('q')} AS q, {part('k')} AS k, {part('v')} AS v FROM p1, range({HEADS}) r(h)), h1 AS (SELECT item, pos, valid, h, {turned('q')} AS q, {turned('k')} AS k, v FROM h0),
  h2 AS (SELECT item, pos, valid, h, {rms('q')} AS q, {rms('k')} AS k, v FROM h1), {attention('sa', 'h2', 'h2')},
  r1 AS (SELECT rw.item, rw.pos, valid, {add('x', 'o', 'out')} AS x FROM rw LEFT JOIN sa ON sa.item = rw.item AND sa.pos = rw.pos),
  n2 AS (SELECT *, {norm('x')} AS g FROM r1), p2 AS (SELECT *, {linear('g', 'cross_q')} AS q FROM n2), c2 AS (SELECT *, {linear('x', 'cross_k')} AS k, {linear('x', 'cross_v')} AS v FROM cx),
  h3 AS (SELECT item, pos, valid, h, {part('q')} AS q FROM p2, range({HEADS}) r(h)), h4 AS (SELECT item, pos, valid, h, {rms('q')} AS q FROM h3),
  k3 AS (SELECT item, pos, valid, h, {part('k')} AS k, {part('v')} AS v FROM c2, range({HEADS}) r(h)), k4 AS (SELECT item, pos, valid, h, {rms('k')} AS k, v FROM k3), {attention('cr', 'h4', 'k4')},
  r2 AS (SELECT r1.item, r1.pos, {add('x', 'o', 'cross_out')} AS x FROM r1 LEFT JOIN cr ON cr.item = r1.item AND cr.pos = r1.pos),
  n3 AS (SELECT *, {norm('x')} AS g FROM r2), u3 AS (SELECT item, pos, x, {gelu} AS u FROM n3), r3 AS (SELECT item, pos, {add('x', 'u', 'down').replace(f"coalesce(u, {zeros})", "u")} AS x FROM u3)
  SELECT item, pos, (d - 1)::INT AS dim, round(x[d], 6) + 0.0 AS x FROM r3, range(1, 65) r(d)"""


@query(f"WITH {_layer_sql()}")
def transformer_layer(spark, sf_dir):
    """A layer of 64 channels and four heads over ten positions an item, with attention to a context of twenty."""
    v, i = _vectors(spark, sf_dir), F.col("vec_id")
    rows = v.select(F.floor(i / 10).alias("item"), (i % 10).alias("pos"), F.col("v").alias("x"), (i % 7 != 3).alias("valid"))
    context = v.select(F.floor(i / 20).alias("item"), (i % 20).alias("pos"), F.col("v").alias("x"), (i % 5 != 1).alias("valid"))
    out = transformer.stack(rows, transformer.Weights(_weights(spark)), HEADS, context)
    return out.select("item", "pos", F.posexplode("x").alias("dim", "x")).select("item", "pos", "dim", (F.round("x", 6) + 0.0).alias("x"))


@query()
def generated_tokens(spark, sf_dir):
    """Two codebooks of 16 classes, all of two rounds each with guidance, on ten frames an item; the first three frames are given."""
    v, i = _vectors(spark, sf_dir), F.col("vec_id")
    at = [F.floor(i / 10).alias("item"), (i % 10).cast("int").alias("frame")]
    tokens = v.select(*at, F.explode(F.array(F.lit(0), F.lit(1))).alias("codebook"), i).select("item", "codebook", "frame", ((i * 7 + F.col("codebook")) % 16).cast("int").alias("token"), (F.col("frame") < 3).alias("keep"))
    cells = spark.range(33).select((F.col("id") - 1).alias("id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: ((F.col("id") * 13 + j * 29) % 31 - 15) / 15.0).alias("v"))
    more = spark.createDataFrame([(n, *m) for n, m in enumerate([("features", 64, 64), ("head0", 16, 64), ("head1", 16, 64)], 20)], "n int, name string, rows int, columns int")
    rows = more.select("n", "name", "columns", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    extra = rows.select(F.lit(0).alias("layer"), "name", "row", F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: ((F.col("row") * 31 + j * 17 + F.col("n") * 7) % 23 - 11) / 184.0).alias("w"))
    model = generation.Model(transformer.Weights(_weights(spark).unionByName(extra)), cells, 16, 64, HEADS)
    how = [generation.Sampling(iterations=2, temperature=0.9, mask_temperature=1.0, k=8, p=0.9, guidance=1.5, causal=0.5)] * 2
    return generation.generated(model, tokens, v.select(*at, F.col("v").alias("f")), how, 5)
