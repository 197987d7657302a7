"""Losses and accuracies over logits in long layout, and vector quantisation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_entropy(df: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """``pos, codebook, loss, correct``: label-smoothed cross-entropy and whether arg-max is the target.

    One aggregation per position: maximum first, then a stable log-sum-exp over the gathered classes
    (as many as the vocabulary).
    """
    g = df.groupBy("pos", "codebook", "target").agg(F.max("logit").alias("m"), F.collect_list("logit").alias("l"), F.avg("logit").alias("mean"), F.max(F.when(F.col("cls") == F.col("target"), F.col("logit"))).alias("hit"), F.max_by("cls", F.struct("logit", -F.col("cls"))).alias("best"))
    lse = F.col("m") + F.log(F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m"))))
    loss = -((1 - smoothing) * (F.col("hit") - lse) + smoothing * (F.col("mean") - lse))
    return g.select("pos", "codebook", loss.alias("loss"), (F.col("best") == F.col("target")).cast("int").alias("correct"))


def macro(df: DataFrame, item: str, key: str, value: str) -> DataFrame:
    """Average per key of per-item averages."""
    return df.groupBy(item, key).agg(F.avg(value).alias("_v")).groupBy(key).agg(F.avg("_v").alias(value))


def distill_kl(student: DataFrame, teacher: DataFrame, temperature: float) -> DataFrame:
    """``pos, kl``: sum of p_t (log p_t - log p_s) at a temperature, times its square."""

    def logp(df: DataFrame, out: str) -> DataFrame:
        m = df.groupBy("pos").agg(F.max("logit").alias("m"), F.collect_list("logit").alias("l"))
        lse = F.log(F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp((x - F.col("m")) / temperature)))
        return df.join(m.select("pos", "m", lse.alias("lse")), "pos").select("pos", "cls", ((F.col("logit") - F.col("m")) / temperature - F.col("lse")).alias(out))

    both = logp(teacher, "t").join(logp(student, "s"), ["pos", "cls"])
    return both.groupBy("pos").agg((F.sum(F.exp("t") * (F.col("t") - F.col("s"))) * temperature**2).alias("kl"))


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be broadcast; raises ValueError if it has more than ``most`` rows, of which it reads one beyond."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows, too many to send to every executor")
    return F.broadcast(df)


def nearest_code(frames: DataFrame, codes: DataFrame) -> DataFrame:
    """``frame, code, dot``: the code of largest cosine, the first on ties.

    ``frames(frame, v)``, ``codes(code, v)``; codes are a codebook, of 65,536 rows at most, which is
    checked before it is broadcast as one row.
    """
    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)))
    bounded(codes, 65_536)
    book = codes.select("code", unit(F.col("v")).alias("c")).agg(F.array_sort(F.collect_list(F.struct("code", "c"))).alias("book"))
    dot = lambda b: F.round(F.aggregate(F.zip_with("u", b["c"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 9)
    rows = frames.select("frame", unit(F.col("v")).alias("u")).join(F.broadcast(book))
    scored = F.transform("book", lambda b: F.struct(dot(b).alias("dot"), (-b["code"]).alias("code")))
    return rows.select("frame", F.array_max(scored).alias("b")).select("frame", (-F.col("b.code")).alias("code"), F.col("b.dot").alias("dot"))
