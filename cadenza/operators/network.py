"""Layers that need no trained weights, residual quantisation, ratios and the unmasking loop."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .decode import unmask_by_confidence
from .metrics import bounded


def position_table(spark, length: int, channels: int) -> DataFrame:
    """``pos, channel, value``: sines in the first half of the channels, cosines in the second."""
    if channels % 2:
        raise ValueError("channels must be even")
    half = channels // 2
    cells = spark.range(length).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    angle = F.col("pos") / F.pow(F.lit(10000.0), (F.col("channel") % half) / half)
    return cells.select("pos", "channel", F.when(F.col("channel") < half, F.sin(angle)).otherwise(F.cos(angle)).alias("value"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def rms_norm(v: Column, gain: float = 1.0, eps: float = 1e-6) -> Column:
    """Vector over its root mean square."""
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v) / F.size(v) + eps) * gain)


def snake(x: Column, alpha: float) -> Column:
    return x + F.pow(F.sin(alpha * x), 2) / (alpha + 1e-9)


def guided(conditional: Column, unconditional: Column, scale: float) -> Column:
    return unconditional + scale * (conditional - unconditional)


def attention(rows: DataFrame) -> DataFrame:
    """``item, pos, out`` from ``item, pos, q, k, v, valid``: softmax attention within an item.

    Invalid keys take no part; an invalid query, or one without valid keys, gives zeros. Work grows
    with the square of an item's length, as attention does.
    """
    keys = rows.filter("valid").select("item", F.col("pos").alias("_j"), "k", "v")
    scores = rows.filter("valid").select("item", "pos", "q").join(keys, "item").select("item", "pos", "v", (dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q"))).alias("s"))
    got = scores.groupBy("item", "pos").agg(F.max("s").alias("m"), F.collect_list(F.struct("s", "v")).alias("l"))
    weight = F.transform("l", lambda e: F.exp(e["s"] - F.col("m")))
    total = F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)
    width = F.size(F.col("l")[0]["v"])
    out = F.transform(F.sequence(F.lit(1), width), lambda d: F.aggregate("l", F.lit(0.0), lambda a, e: a + F.exp(e["s"] - F.col("m")) * F.element_at(e["v"], d.cast("int"))) / total)
    zeros = F.transform("v", lambda x: F.lit(0.0))
    return rows.select("item", "pos", "v").join(got.select("item", "pos", out.alias("out")), ["item", "pos"], "left").select("item", "pos", F.coalesce("out", zeros).alias("out"))


def residual_codes(frames: DataFrame, books: list[DataFrame]) -> DataFrame:
    """``frame, codes, residual, quantised``: each level takes the code nearest in direction and hands on the rest.

    ``frames(frame, v)``; a book has ``code, c`` and 65,536 rows at most, which is checked before it is
    broadcast. Ties go to the smaller code. One pass, no shuffle of frames.
    """
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    rows = frames.select("frame", F.col("v").alias("r"), F.array().cast("array<bigint>").alias("codes"), F.col("v"))
    for book in books:
        bounded(book, 65_536)
        one = book.agg(F.array_sort(F.collect_list(F.struct("code", "c"))).alias("book"))
        near = F.array_max(F.transform("book", lambda b: F.struct(F.round(dot(F.col("r"), b["c"]) / (norm(F.col("r")) * norm(b["c"])), 9).alias("s"), (-b["code"]).alias("code"), b["c"].alias("c"))))
        rows = rows.join(F.broadcast(one)).select("frame", "v", "r", "codes", near.alias("b"))
        rows = rows.select("frame", "v", F.zip_with("r", "b.c", lambda x, y: x - y).alias("r"), F.concat("codes", F.array(-F.col("b.code"))).alias("codes"))
    return rows.select("frame", "codes", F.col("r").alias("residual"), F.zip_with("v", "r", lambda x, y: x - y).alias("quantised"))


def fast_ratios(spark, rate: int) -> DataFrame:
    """``num, den``: reduced ratios of divisors of ``rate`` between a half and two, one excepted.

    The divisors are the products of its prime factors: a few dozen rows, with both sides so bounded.
    """
    d = [i for i in range(1, rate + 1) if rate % i == 0]
    found = sorted({(a // math.gcd(a, b), b // math.gcd(a, b)) for a in d for b in d if a != b and b <= 2 * a and a <= 2 * b})
    return spark.createDataFrame(found, "num long, den long")


def nearest_ratio(items: DataFrame, ratios: DataFrame) -> DataFrame:
    """``num, den`` of the ratio nearest to ``semitones`` in semitones; ties to the smaller ratio."""
    bounded(ratios, 10_000)
    table = F.broadcast(ratios.agg(F.collect_list(F.struct("num", "den")).alias("_r")))
    far = lambda r: F.round(F.abs(12 * F.log2(r["num"] / r["den"]) - F.col("semitones")), 9)
    best = F.array_min(F.transform("_r", lambda r: F.struct(far(r).alias("far"), (r["num"] / r["den"]).alias("ratio"), r["num"].alias("num"), r["den"].alias("den"))))
    return items.join(table).withColumn("_b", best).select(*items.columns, "_b.num", "_b.den")


def biquad(kind: str, gain_db: Column, cutoff: Column, q: Column, rate: float) -> Column:
    """Struct of b0, b1, b2, a1, a2, divided by a0: peaking, low or high shelf, low or high pass."""
    a = F.pow(F.lit(10.0), gain_db / 40)
    w = 2 * math.pi * cutoff / rate
    cos, alpha, root = F.cos(w), F.sin(w) / (2 * q), F.sqrt(a)
    one = F.lit(1.0)
    if kind == "peaking":
        c = (1 + alpha * a, -2 * cos, 1 - alpha * a, 1 + alpha / a, -2 * cos, 1 - alpha / a)
    elif kind in ("low_shelf", "high_shelf"):
        s = 1.0 if kind == "low_shelf" else -1.0
        up, down, slope = a + 1, a - 1, 2 * root * alpha
        c = (a * (up - s * down * cos + slope), s * 2 * a * (down - s * up * cos), a * (up - s * down * cos - slope), up + s * down * cos + slope, -s * 2 * (down + s * up * cos), up + s * down * cos - slope)
    elif kind in ("low_pass", "high_pass"):
        s = 1.0 if kind == "low_pass" else -1.0
        c = ((one - s * cos) / 2, s * (one - s * cos), (one - s * cos) / 2, 1 + alpha, -2 * cos, 1 - alpha)
    else:
        raise ValueError(f"unknown kind {kind}")
    return F.struct(*[(v / c[3]).alias(n) for v, n in zip((*c[:3], *c[4:]), ("b0", "b1", "b2", "a1", "a2"), strict=True)])


def unmask_loop(df: DataFrame, iterations: int, temperature: float, seed: int, rounds: int | None = None) -> DataFrame:
    """``keep`` after all ``iterations`` of the cosine schedule, or the first ``rounds``, from ``item, frame, p, masked``.

    Round i leaves floor(masked at the start * cos(i / iterations * pi / 2)) masked; the plan has one
    window a round, over the same partitioning, and none of its rows is broadcast.
    """
    rows = df.withColumn("_start", F.sum(F.col("masked").cast("int")).over(W.partitionBy("item")))
    for i in range(1, (rounds or iterations) + 1):
        left = F.floor(F.round(F.col("_start") * max(math.cos(i / iterations * math.pi / 2), 1e-10), 6))
        rows = unmask_by_confidence(rows, left, temperature * (1 - i / iterations), seed + i).withColumn("masked", ~F.col("keep"))
    return rows.drop("_start")
