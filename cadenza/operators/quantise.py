"""Residual vector quantisation with a projection into each codebook's space and back, and batches in splits.

Weights are tables: ``levels(level, inward, inward_bias, outward, outward_bias)``, matrices as arrays of rows,
and ``books(level, code, c)``. Both are bounded, and checked before they are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import bounded
from .network import dot

MOST_LEVELS, MOST_CODES = 64, 65_536


def _weights(levels: DataFrame, books: DataFrame) -> list[tuple]:
    """For each level in order: the four projections, the codes and their vectors."""
    bounded(levels, MOST_LEVELS)
    bounded(books, MOST_LEVELS * MOST_CODES)
    of = {}
    for r in books.orderBy("level", "code").toLocalIterator():
        of.setdefault(r["level"], []).append((r["code"], r["c"]))
    return [(*(np.array(r[c], float) for c in ("inward", "inward_bias", "outward", "outward_bias")), np.array([c for c, _ in of[r["level"]]]), np.array([v for _, v in of[r["level"]]], float)) for r in levels.orderBy("level").collect()]


def encoded(frames: DataFrame, levels: DataFrame, books: DataFrame) -> DataFrame:
    """``frame, codes, latents, residual, quantised`` of ``frames(frame, v)``, all arrays; no frame moves.

    Each level projects what is left, takes the code nearest in direction (the first of equals, to nine places) and
    takes off the code's vector projected back. ``latents`` are the projections of all levels in a row.
    """
    sent = frames.sparkSession.sparkContext.broadcast(_weights(levels, books))
    kind = dict(frames.dtypes)["frame"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            rest, codes, latents = v.copy(), [], []
            for inward, inward_bias, outward, outward_bias, names, book in sent.value:
                z = rest @ inward.T + inward_bias
                best = np.argmax(np.round(unit(z) @ unit(book).T, 9), axis=1)
                rest -= book[best] @ outward.T + outward_bias
                codes.append(names[best])
                latents.append(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(np.stack(codes, 1), pa.int64()), *(lists(x, pa.float64()) for x in (np.concatenate(latents, 1), rest, v - rest))], ["frame", "codes", "latents", "residual", "quantised"])

    return frames.select("frame", "v").mapInArrow(run, f"frame {kind}, codes array<bigint>, latents array<double>, residual array<double>, quantised array<double>")


def outward_vectors(levels: DataFrame, books: DataFrame) -> DataFrame:
    """``level, code, o``: vectors of the codes, projected back."""
    both = books.join(levels.select("level", "outward", "outward_bias"), "level")
    return both.select("level", "code", F.zip_with(F.transform("outward", lambda row: dot(row, F.col("c"))), "outward_bias", lambda a, b: a + b).alias("o"))


def decoded(codes: DataFrame, levels: DataFrame, books: DataFrame) -> DataFrame:
    """``frame, quantised`` of ``codes(frame, codes)``: the sum of the levels' vectors, one lookup a level; fewer codes than levels will do.

    A code that its level lacks is an error.
    """
    table = outward_vectors(levels, books)
    bounded(books, MOST_LEVELS * MOST_CODES)
    rows = codes.select("frame", "codes", F.lit(None).cast("array<double>").alias("quantised"))
    for i, r in enumerate(levels.select("level").orderBy("level").collect()):
        here = bounded(table.filter(F.col("level") == r["level"]).select(F.col("code").alias("_code"), F.col("o").alias("_o")), MOST_CODES)
        rows = rows.join(here, F.get("codes", F.lit(i)) == F.col("_code"), "left")
        missing = F.raise_error(F.concat(F.lit(f"level {r['level']} has no code "), F.get("codes", F.lit(i)).cast("string"))).cast("array<double>")
        term = F.when(F.size("codes") > i, F.coalesce("_o", missing))
        total = F.when(F.col("quantised").isNull(), term).when(term.isNull(), F.col("quantised")).otherwise(F.zip_with("quantised", term, lambda a, b: a + b))
        rows = rows.select("frame", "codes", total.alias("quantised"))
    return rows.select("frame", "quantised")


def collated(rows: DataFrame, splits: Column, fill: float = 0.0) -> DataFrame:
    """``batch, part, item, length, v``: batches in ``splits`` parts of neighbouring items, padded to the longest of their part.

    ``rows(batch, item, v)``; ``splits`` is an expression that is the same for a batch's rows. Parts have ceil(items / splits)
    items, the last what is left, so that there may be fewer parts.
    """
    each = W.partitionBy("batch")
    at = (F.row_number().over(each.orderBy("item")) - 1).alias("_i")
    counted = rows.select("batch", "item", "v", splits.alias("_s"), at, F.count("*").over(each).alias("_n"))
    cut = counted.withColumn("part", F.floor(F.col("_i") / F.ceil(F.col("_n") / F.col("_s"))).cast("int"))
    wide = cut.withColumn("_w", F.max(F.size("v")).over(W.partitionBy("batch", "part")))
    return wide.select("batch", "part", "item", F.size("v").alias("length"), F.concat("v", F.array_repeat(F.lit(fill), F.col("_w") - F.size("v"))).alias("v"))
