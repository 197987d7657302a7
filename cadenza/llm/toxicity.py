"""Toxicity: a bag of subword embeddings, averaged, into a linear softmax; trained jointly in NumPy.

Features of a text are its whole words and character n-grams (hashed into buckets), so unseen
misspellings share most of their vectors with the words they come from. The hidden state is the
mean of the feature embeddings over the whole text; two logits follow from it. After training, an
embedding matters only through its projection on the difference of the two output rows, so scoring
needs one number per bucket, which is what executors receive: a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, lean
from .textkernels import pieces, subword_features, utf8


@dataclass(frozen=True)
class SubwordModel:
    """``logit = shift + mean over features of weight[bucket]``."""

    weight: np.ndarray
    shift: float
    sizes: tuple[int, ...]

    def logits(self, column) -> np.ndarray:
        buf, offsets = utf8(column)
        mask = len(self.weight) - 1
        out = np.empty(len(offsets) - 1)
        for a, b in pieces(offsets, 1 << 18):
            part = offsets[a : b + 1]
            total, count = np.zeros(b - a), np.zeros(b - a)
            for row, bucket in subword_features(buf[part[0] : part[-1]], part - part[0], self.sizes, mask):
                total += np.bincount(row, self.weight[bucket], b - a)
                count += np.bincount(row, minlength=b - a)
            out[a:b] = total / np.maximum(count, 1)
        return out + self.shift


def fit_subword_model(texts, toxic: np.ndarray, buckets: int = 1 << 18, dim: int = 8, sizes: tuple[int, ...] = (3, 4, 5), epochs: int = 10, rate: float = 0.3, batch: int = 64, seed: int = 7, least_docs: int = 3, decay: float = 8e-4) -> SubwordModel:
    """Train embeddings and softmax together by Adagrad on class-balanced cross-entropy.

    Features of fewer than ``least_docs`` texts are left out and touched embeddings decay, both
    against learning texts by heart. A fifth of the texts is kept from training and sets scale and
    shift of the logit (Platt scaling), so that a score is a probability. ``texts`` is an Arrow string column. With one class only, or no rows, the model is constant at
    the share of toxic rows (0.1 without rows).
    """
    toxic = np.asarray(toxic, np.int64)
    share = float(toxic.mean()) if len(toxic) else 0.1
    if len(toxic) == 0 or share in (0.0, 1.0):
        share = min(max(share, 0.01), 0.99)
        return SubwordModel(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))), sizes)
    indptr, index, value = _bags(texts, sizes, buckets - 1)
    docs_with = np.bincount(index, minlength=buckets)
    used = np.flatnonzero(docs_with)
    value *= (docs_with >= least_docs)[index]
    name = np.zeros(buckets, np.int32)
    name[used] = np.arange(len(used))
    code = name[index]
    del index
    rng = np.random.RandomState(seed)
    emb = ((rng.rand(len(used), dim) - 0.5) / dim).astype(np.float32)
    out = ((rng.rand(2, dim) - 0.5) / dim).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_out, g_bias = np.full(len(used), 1e-8, np.float32), np.full((2, dim), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    held = _calibration_part(toxic, rng)
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(~held))
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            spans = [np.arange(indptr[d], indptr[d + 1]) for d in docs]
            at = np.concatenate(spans)
            who = np.repeat(np.arange(len(docs)), [len(s) for s in spans])
            c, v = code[at], value[at]
            rows = emb[c] * v[:, None]
            starts = np.concatenate([[0], np.cumsum([len(s) for s in spans])[:-1]])
            hidden = np.add.reduceat(rows, np.minimum(starts, max(len(rows) - 1, 0)), axis=0) if len(rows) else np.zeros((len(docs), dim), np.float32)
            hidden[[i for i, s in enumerate(spans) if not len(s)]] = 0
            z = hidden @ out.T + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), toxic[docs]] -= 1
            delta = p * weight[docs][:, None]
            grad_hidden = delta @ out
            grad = delta.T @ hidden
            g_out += grad * grad
            out -= rate * grad / np.sqrt(g_out)
            grad = delta.sum(0)
            g_bias += grad * grad
            bias -= 0.1 * rate * grad / np.sqrt(g_bias)
            # a bucket may occur in several texts of the batch: add up first
            cells, inverse = np.unique(c, return_inverse=True)
            push = grad_hidden[who] * v[:, None]
            each = np.stack([np.bincount(inverse, push[:, j], len(cells)) for j in range(dim)], 1).astype(np.float32)
            each += decay * emb[cells]
            g_emb[cells] += (each * each).mean(1)
            emb[cells] -= rate * each / np.sqrt(g_emb[cells])[:, None]
    scalar = np.zeros(buckets, np.float32)
    slope = emb @ (out[1] - out[0])
    scalar[used] = slope
    shift = float(bias[1] - bias[0])
    if held.any():
        spans = [slice(indptr[d], indptr[d + 1]) for d in np.flatnonzero(held)]
        mean = np.array([(slope[code[s]] * value[s]).sum() for s in spans])
        scale, shift = _platt(mean, shift, toxic[held], math.sqrt((1 - share) / share))
        scalar *= scale
    return SubwordModel(scalar, shift, sizes)


def _calibration_part(toxic: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
    """A fifth of each class, or nothing where a class has fewer than 20 texts."""
    held = np.zeros(len(toxic), bool)
    if np.bincount(toxic, minlength=2).min() >= 20:
        for c in (0, 1):
            rows = rng.permutation(np.flatnonzero(toxic == c))
            held[rows[: len(rows) // 5]] = True
    return held


def _platt(mean: np.ndarray, shift: float, toxic: np.ndarray, weight: float, steps: int = 50) -> tuple[float, float]:
    """Scale and shift of the logit that fit the rows best, by Newton steps with a weak prior."""
    x = np.stack([mean + shift, np.ones(len(mean))], 1)
    w = np.where(toxic == 1, weight, 1.0)
    at, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (w * (p - toxic)) + 0.1 * (at - prior)
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        at = at - np.clip(np.linalg.solve(curve, slope), -1, 1)
    scale = max(float(at[0]), 1e-3)
    return scale, scale * shift + float(at[1])


def _bags(texts, sizes, mask) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR of the feature shares of each text."""
    buf, offsets = utf8(texts)
    counts, index, value = [], [], []
    for a, b in pieces(offsets, 1 << 18):
        part = offsets[a : b + 1]
        keys = [row.astype(np.int64) * (mask + 1) + bucket for row, bucket in subword_features(buf[part[0] : part[-1]], part - part[0], sizes, mask)]
        cells, n = np.unique(np.concatenate(keys), return_counts=True)
        row = cells // (mask + 1)
        total = np.bincount(row, n, b - a)
        counts.append(np.bincount(row, minlength=b - a))
        index.append((cells % (mask + 1)).astype(np.int32))
        value.append((n / total[row]).astype(np.float32))
    # one list at a time, as the driver holds both
    whole = np.concatenate(index)
    del index
    return np.concatenate([[0], np.cumsum(np.concatenate(counts))]), whole, np.concatenate(value)


def fit_sample(docs: DataFrame, labels: DataFrame, usable: Column, max_docs: int, max_bytes: int, id_col: str, text_col: str, label_col: str) -> pa.Table:
    """At most ``max_docs`` labelled texts of at most ``max_bytes`` bytes, the first by hashed id.

    Labels of one id that disagree count as toxic; null ids and null labels are not used, and a label
    whose id has several texts counts for each of them. Only the
    sample reaches the driver: ``max_docs * max_bytes`` bytes at most, whole texts.
    """
    chosen = labels.filter(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    # twice as many ids as texts are wanted, as some texts are too long or absent
    chosen = chosen.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(2 * max_docs)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).filter(F.octet_length("text") <= max_bytes)
    rows = texts.join(F.broadcast(chosen), "_id")
    return rows.orderBy(F.md5(F.col("_id").cast("string")), "_id", "text").limit(max_docs).select("text", "toxic").toArrow()


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_docs: int = 6000,
    max_bytes: int = 16_384,
    **training,
) -> DataFrame:
    """All columns of ``docs`` and, last, ``_score``: the probability that the text is toxic.

    Where ``docs`` has a column of that name, underscores are added to the score's name.

    The model sees labelled texts only (``usable`` filters ``labels``); ids, languages and sources
    are never inputs. Null and empty texts have no features and get the score of the bias. Every
    text is scored whole. No rows give no rows. Repeated rows get equal scores.
    """
    spark = docs.sparkSession
    sample = fit_sample(docs, labels, F.lit(True) if usable is None else usable, max_docs, max_bytes, id_col, text_col, label_col)
    model = fit_subword_model(sample.column("text"), sample.column("toxic").to_numpy(), **training)
    shared = spark.sparkContext.broadcast(model)
    bounded_batches(spark)
    names = docs.columns
    position = names.index(text_col)
    score_col = free_name(docs, "_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logit = shared.value.logits(batch.column(position))
            score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*names, score_col])

    schema = docs.withColumn(score_col, F.lit(0.0)).schema
    return docs.mapInArrow(lean(run), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``docs`` without the texts scored at ``threshold`` or more; columns unchanged."""
    scored = toxicity_scores(docs, labels, **options)
    return scored.filter(F.col(scored.columns[-1]) < threshold).select(*[f"`{c}`" for c in docs.columns])
