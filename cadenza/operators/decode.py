"""Logits, truncation, draws, masks and confidence-ranked unmasking. True in a mask means keep."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import gumbel, uniform


def cosine_schedule(t: Column) -> Column:
    return F.least(F.greatest(F.cos(t * 3.141592653589793 / 2), F.lit(1e-10)), F.lit(1.0))


def top_k(df: DataFrame, k: int) -> DataFrame:
    """Rows whose logit is at least the k-th of their position; ties stay."""
    return df.withColumn("_r", F.rank().over(W.partitionBy("pos").orderBy(F.desc("logit")))).filter(F.col("_r") <= k).drop("_r")


def softmax(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """``p`` per row of a position."""
    each = W.partitionBy("pos")
    e = F.exp((F.col("logit") - F.max("logit").over(each)) / temperature)
    return df.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(each)).drop("_e")


def top_p(df: DataFrame, p: float) -> DataFrame:
    """Rows of the nucleus: the row that crosses ``p`` goes too, the first row never."""
    order = W.partitionBy("pos").orderBy(F.desc("logit"), "cls")
    rows = softmax(df).withColumn("_cum", F.round(F.sum("p").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), 9)).withColumn("_r", F.row_number().over(order))
    return rows.filter((F.col("_cum") <= p) | (F.col("_r") == 1)).drop("_cum", "_r")


def draw(df: DataFrame, seed: int) -> DataFrame:
    """One class per position by inverse CDF in order of class, with its probability."""
    order = W.partitionBy("pos").orderBy("cls")
    rows = softmax(df).withColumn("_cum", F.round(F.sum("p").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), 9))
    rows = rows.withColumn("_last", F.lead("cls").over(order).isNull()).filter((F.col("_cum") > uniform(seed, F.col("pos"))) | F.col("_last"))
    return rows.groupBy("pos").agg(F.min_by("cls", "cls").alias("cls"), F.min_by("p", "cls").alias("p"))


def drawn_spans(items: DataFrame, low: float, high: float, length: int, seed: int) -> DataFrame:
    """``start, end`` of a random span of each item; the start's upper bound is exclusive."""
    span = ((low + (high - low) * uniform(f"{seed}:prop", F.col("item"))) * length).cast("int")
    start = F.floor(uniform(f"{seed}:start", F.col("item")) * F.greatest(F.lit(length) - F.col("_span"), F.lit(1))).cast("int")
    rows = items.withColumn("_span", span).withColumn("start", start)
    return rows.withColumn("end", F.col("start") + F.col("_span")).drop("_span")


def span_mask(frame: Column) -> Column:
    """False (masked) within the row's ``start, end``."""
    return ~((frame >= F.col("start")) & (frame < F.col("end")))


def combined_mask(span: Column, codebook: Column, current: Column, rand: Column, leak: bool = False) -> Column:
    """Above the current codebook: masked (``leak``: where rand is not set); current: by rand; below: kept. ``rand`` comes last, it is the dearest."""
    higher = (codebook > current) & ~rand if leak else codebook > current
    return span | ~(higher | ((codebook == current) & ~rand))


def unmask_by_confidence(df: DataFrame, n: Column, temperature: float, seed: int) -> DataFrame:
    """``keep``: masked rows (``masked``) of best noisy log-probability are kept until ``n`` remain."""
    score = F.round(F.log(F.greatest(F.col("p"), F.lit(1e-12))) + temperature * gumbel(uniform(seed, F.col("item"), F.col("frame"))), 9)
    each = W.partitionBy("item")
    rows = df.withColumn("_s", score).withColumn("_m", F.sum(F.col("masked").cast("int")).over(each))
    order = W.partitionBy("item").orderBy(F.desc("masked"), F.desc("_s"), "frame")
    return rows.withColumn("keep", ~F.col("masked") | (F.row_number().over(order) <= F.greatest(F.col("_m") - n, F.lit(0)))).drop("_s", "_m")
