"""Transformer layers over rows ``item, pos, x`` (x: array), with given weights: matrices as tuples of rows.

Weights go along with the plan as literals, so they are for small layers; positions meet within an item.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .items import rotary
from .network import attention, dot, rms_norm


def matrix(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def projected(v: Column, weights: Column) -> Column:
    """The vector times a matrix given by its output rows."""
    return F.transform(weights, lambda r: dot(v, r))


def gelu(x: Column) -> Column:
    """By the tanh approximation."""
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * F.pow(x, 3))))


def multi_head(rows: DataFrame, q: Column, k: Column, v: Column, heads: int, out: Column | None = None, qk_norm: bool = True, positions: bool = True) -> DataFrame:
    """``item, pos, out``: attention of ``rows(item, pos, x, valid)`` by heads: project, turn by position, then norm.

    Invalid positions are no keys and get zeros.
    """
    p = rows.select("item", "pos", "valid", projected(F.col("x"), q).alias("q"), projected(F.col("x"), k).alias("k"), projected(F.col("x"), v).alias("v"))
    width = (F.size("q") / heads).cast("int")
    cut = lambda c: F.slice(c, F.col("head") * width + 1, width)
    p = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head"))
    p = p.select("item", "pos", "valid", "head", cut("q").alias("q"), cut("k").alias("k"), cut("v").alias("v"))
    turn = lambda c: rotary(F.col(c), F.col("pos")) if positions else F.col(c)
    norm = rms_norm if qk_norm else (lambda c: c)
    p = p.select(F.struct("item", "head").alias("item"), "pos", "valid", turn("q").alias("q"), turn("k").alias("k"), "v").withColumn("q", norm(F.col("q"))).withColumn("k", norm(F.col("k")))
    got = attention(p).groupBy("item.item", "pos").agg(F.array_sort(F.collect_list(F.struct("item.head", "out"))).alias("h"))
    joined = F.flatten(F.transform("h", lambda h: h["out"]))
    return got.select("item", "pos", (joined if out is None else projected(joined, out)).alias("out"))


def block(rows: DataFrame, weights: dict[str, list[list[float]]], heads: int) -> DataFrame:
    """``item, pos, x, valid`` after a pre-norm block: attention, then a two-layer perceptron, each added on.

    ``weights`` has ``q, k, v, out, up, down``.
    """
    w = {n: matrix(m) for n, m in weights.items()}
    attended = multi_head(rows.withColumn("x", rms_norm(F.col("x"))), w["q"], w["k"], w["v"], heads, w["out"])
    both = rows.join(attended, ["item", "pos"]).withColumn("x", F.zip_with("x", "out", lambda a, b: a + b)).drop("out")
    hidden = F.transform(projected(F.col("_n"), w["up"]), gelu)
    both = both.withColumn("_n", rms_norm(F.col("x"))).withColumn("_m", projected(hidden, w["down"]))
    return both.withColumn("x", F.zip_with("x", "_m", lambda a, b: a + b)).select("item", "pos", "x", "valid")


def stack(rows: DataFrame, layers: list[dict[str, list[list[float]]]], heads: int) -> DataFrame:
    """Blocks one after the other."""
    for weights in layers:
        rows = block(rows, weights, heads)
    return rows
