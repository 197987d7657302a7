"""Forward pass over token grids and iterative generation, codebook by codebook, with the state in the shared folder.

``tokens(item, codebook, frame, token, keep)``; ``features(item, frame, f)``; ``embeddings(id, v)`` has a vector for each token +
codebook * classes, and the mask's under -1. Weights are those of ``transformer``, with ``features`` and ``head0``, ``head1``, ... at layer 0.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from . import transformer
from .items import remasked, sampled, summed_embeddings, truncated


class Model(NamedTuple):
    weights: transformer.Weights
    embeddings: DataFrame
    classes: int
    width: int
    heads: int


class Sampling(NamedTuple):
    """How a codebook is generated: rounds, temperatures of draws and of masks, truncation, guidance and a bias to early frames."""

    iterations: int = 8
    temperature: float = 1.0
    mask_temperature: float = 0.0
    k: int | None = None
    p: float | None = None
    guidance: float = 0.0
    causal: float = 0.0
    argmax: bool = False


def forward(model: Model, tokens: DataFrame, features: DataFrame, current: int) -> DataFrame:
    """``pos, cls, logit`` of codebook ``current``, by position ``(item, frame)``.

    A frame is the sum of its kept tokens' vectors, the mask's where the current codebook has none, and its projected features.
    """
    mask = F.broadcast(model.embeddings.filter("id = -1").select(F.col("v").alias("_mask")))
    rows = tokens.join(mask).withColumn("current", F.col("codebook") == current)
    summed = summed_embeddings(rows, model.embeddings, F.col("_mask"), model.classes, model.width)
    rows = summed.join(features.select("item", "frame", "f"), ["item", "frame"]).select("item", F.col("frame").alias("pos"), F.lit(True).alias("valid"), F.col("v").alias("x"), "f")
    sent = model.weights.sent
    rows = transformer.by_rows(rows, ["x", "f"], lambda pos, x, f: [x + f @ sent.value[0, "features"].T], ["x"])
    out = transformer.stack(rows, model.weights, model.heads)
    logits = transformer.by_rows(out, ["x"], lambda pos, x: [x @ sent.value[0, f"head{current}"].T], ["logits"])
    return logits.select(F.struct("item", F.col("pos").alias("frame")).alias("pos"), F.posexplode("logits").alias("cls", "logit"))


def generated(model: Model, tokens: DataFrame, features: DataFrame, how: list[Sampling], seed: int) -> DataFrame:
    """``tokens`` with all those that are not kept filled in, a codebook of ``how`` after the other.

    In each round the logits follow from the tokens of the round before. Of the draws, the most confident are kept, so that
    floor(masked at the start * cos(i / rounds * pi / 2)) remain. With guidance, logits of absent features count as the
    unguided branch. A round's tokens are written to the shared folder, which cuts the lineage.
    """
    spark = tokens.sparkSession
    frames = (tokens.agg(F.max("frame")).first()[0] or 0) + 1

    def stored(df: DataFrame) -> DataFrame:
        path = shared_path(spark, "generation")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    state = stored(tokens.select("item", "codebook", "frame", "token", "keep"))
    absent = features.withColumn("f", F.transform("f", lambda x: F.lit(0.0)))
    for codebook, s in enumerate(how):
        mine = F.col("codebook") == codebook
        start = state.filter(mine).groupBy("item").agg(F.count_if(~F.col("keep")).alias("_start"))
        for i in range(1, s.iterations + 1):
            logits = forward(model, state, features, codebook)
            if s.guidance:
                other = forward(model, state, absent, codebook).withColumnRenamed("logit", "_u")
                logits = logits.join(other, ["pos", "cls"]).select("pos", "cls", (F.col("_u") + s.guidance * (F.col("logit") - F.col("_u"))).alias("logit"))
            drawn = sampled(truncated(logits, s.k, s.p), s.temperature, f"{seed}:{codebook}:{i}", s.argmax).select("pos.item", "pos.frame", F.col("cls").alias("_new"), "p")
            rows = state.filter(mine).join(drawn, ["item", "frame"]).join(start, "item").withColumn("masked", ~F.col("keep"))
            left = F.floor(F.round(F.col("_start") * max(math.cos(i / s.iterations * math.pi / 2), 1e-10), 6))
            rows = remasked(rows.drop("keep"), left, s.mask_temperature * (1 - i / s.iterations), s.causal, frames, f"{seed}:{codebook}:{i}:mask")
            token = F.when(F.col("masked") & F.col("keep"), F.col("_new")).otherwise(F.col("token")).cast(dict(state.dtypes)["token"])
            state = stored(state.filter(~mine).unionByName(rows.select("item", "codebook", "frame", token.alias("token"), "keep")))
    return state
