"""Transformer layers over rows ``item, pos, x``, with weights as a table and attention by blocks of keys.

``weights(layer, name, row, w)`` has the rows of each layer's matrices: q, k, v, out (and cross_q, cross_k, cross_v, cross_out),
up, down; and as row 0 the vectors that are not ones or zeros: norm, cross_norm, mlp_norm and, as ``{name}_bias``, what is added
to a norm or a product. The table is bounded, which is checked before it is sent to all tasks; none of it is in a plan.

Attention deals blocks of queries against blocks of keys of the same item and head. A pair of blocks gives
for each query its largest score, the sum of exponents relative to it and the sum of values so weighted; those of all blocks are
put together at the scale of the largest. So no task holds all keys of an item, nor its scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import bounded

#: Queries and keys of a block, and rows of weights at most.
BLOCK, MOST_WEIGHTS = 256, 1 << 20


class Weights:
    """Matrices and vectors of all layers, as they are sent to the tasks."""

    def __init__(self, table: DataFrame):
        bounded(table, MOST_WEIGHTS)
        rows: dict[tuple[int, str], list] = {}
        for r in table.orderBy("layer", "name", "row").toLocalIterator():
            rows.setdefault((r["layer"], r["name"]), []).append(r["w"])
        self.layers = 1 + max((layer for layer, _ in rows), default=-1)
        self.sent = table.sparkSession.sparkContext.broadcast({k: np.array(v, float) for k, v in rows.items()})
        self.names = set(rows)


def layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * gain + bias


def rms_norm(x: np.ndarray, gain: np.ndarray | float = 1.0, eps: float = 1e-8) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * gain


def gelu(x: np.ndarray) -> np.ndarray:
    """By the tanh approximation."""
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


def turned(x: np.ndarray, pos: np.ndarray, base: float = 10000.0) -> np.ndarray:
    """Vectors turned by their position: pairs (i, i + half) by pos / base**(i / half)."""
    half = x.shape[-1] // 2
    angle = pos.reshape(-1, *[1] * (x.ndim - 1)) / base ** (np.arange(half) / half)
    a, b = x[..., :half], x[..., half:]
    return np.concatenate([a * np.cos(angle) - b * np.sin(angle), b * np.cos(angle) + a * np.sin(angle)], -1)


def _table(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def by_rows(rows: DataFrame, inputs: list[str], kernel: Callable[..., list[np.ndarray]], outputs: list[str]) -> DataFrame:
    """All columns but ``inputs`` and the arrays ``outputs``; ``kernel`` gets positions and the inputs as matrices, and gives matrices."""
    rest = [c for c in rows.columns if c not in inputs]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = kernel(batch.column("pos").to_numpy(zero_copy_only=False), *(_table(batch.column(c)) for c in inputs))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(_lists(m) for m in made)], [*rest, *outputs])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), *(f"`{c}` array<double>" for c in outputs)])
    return rows.select(*rest, *inputs).mapInArrow(run, schema)


def attended(queries: DataFrame, keys: DataFrame, heads: int, bias: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``item, pos, o``: softmax of scaled products over the valid keys of each item, by head, heads in a row.

    ``queries(item, pos, q)`` and ``keys(item, pos, k, v, valid)``, arrays of all heads. ``bias(query positions, key positions)`` is added
    to the scores; -inf masks. A query without any key gets zeros, and so
    do those that are not ``valid``, where queries have that column.
    """
    block = BLOCK
    asking = queries.filter("valid") if "valid" in queries.columns else queries
    q = asking.groupBy("item", F.floor(F.col("pos") / block).alias("_a")).agg(F.collect_list(F.struct("pos", "q")).alias("_q"))
    k = keys.filter("valid").groupBy("item", F.floor(F.col("pos") / block).alias("_b")).agg(F.collect_list(F.struct("pos", "k", "v")).alias("_k"))
    pairs = q.join(k, "item").select("item", F.col("_q.pos").alias("qp"), F.flatten("_q.q").alias("q"), F.col("_k.pos").alias("kp"), F.flatten("_k.k").alias("k"), F.flatten("_k.v").alias("v"))
    kind = dict(queries.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qp, q, kp, k, v = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(1, 6))
                split = lambda x, n: x.reshape(n, heads, -1).transpose(1, 0, 2)
                q, k, v = split(q, len(qp)), split(k, len(kp)), split(v, len(kp))
                scores = q @ k.transpose(0, 2, 1) / math.sqrt(q.shape[2])
                if bias is not None:
                    scores = scores + bias(qp, kp)
                top = scores.max(2)
                e = np.exp(scores - np.where(np.isfinite(top), top, 0.0)[:, :, None])
                flat = lambda x: np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(len(qp), -1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(qp))), pa.array(qp), _lists(top.T), _lists(e.sum(2).T), _lists(flat(e @ v))], ["item", "pos", "m", "l", "o"])

    parts = pairs.mapInArrow(run, f"item {kind['item']}, pos {kind['pos']}, m array<double>, l array<double>, o array<double>")
    # one row a block of keys
    sets = queries.select("item", "pos", F.size("q").alias("_n")).join(parts.groupBy("item", "pos").agg(F.collect_list(F.struct("m", "l", "o")).alias("p")), ["item", "pos"], "left")
    sets = sets.select("item", "pos", "_n", F.size("p").alias("_c"), *[F.flatten(f"p.{c}").alias(f"_{c}") for c in "mlo"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, c, m, one, o in zip(*(batch.column(x).to_pylist() for x in range(2, 7)), strict=True):
                if m is None:
                    out.append(np.zeros(n))
                    continue
                m, one, o = np.array(m).reshape(c, heads), np.array(one).reshape(c, heads), np.array(o).reshape(c, heads, -1)
                top = m.max(0)
                scale = np.exp(m - np.where(np.isfinite(top), top, 0.0))
                total = (one * scale).sum(0)[:, None]
                out.append((np.where(total > 0, (o * scale[:, :, None]).sum(0) / np.where(total > 0, total, 1.0), 0.0)).ravel())
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(np.stack(out))], ["item", "pos", "o"])

    return sets.mapInArrow(together, f"item {kind['item']}, pos {kind['pos']}, o array<double>")


def layer(rows: DataFrame, weights: Weights, at: int, heads: int, context: DataFrame | None = None, norm: str = "layer", positions: bool = True, qk_norm: bool = True, bias=None) -> DataFrame:
    """``item, pos, x, valid`` after one layer: attention, attention to ``context(item, pos, x, valid)`` if given, and a perceptron, each of what is normed and added on.

    ``norm``: "layer" or "rms". Positions turn queries and keys of the layer's own attention, which are normed afterwards.
    Invalid positions are no keys.
    """
    sent = weights.sent

    def normed(x: np.ndarray, name: str) -> np.ndarray:
        gain = sent.value.get((at, name), np.ones((1, x.shape[1])))[0]
        bias_ = sent.value.get((at, f"{name}_bias"), np.zeros((1, x.shape[1])))[0]
        return layer_norm(x, gain, bias_) if norm == "layer" else rms_norm(x, gain)

    def linear(x: np.ndarray, name: str) -> np.ndarray:
        y = x @ sent.value[at, name].T
        return y + sent.value[at, f"{name}_bias"][0] if (at, f"{name}_bias") in sent.value else y

    def headed(x: np.ndarray, pos: np.ndarray, turn: bool) -> np.ndarray:
        x = x.reshape(len(x), heads, -1)
        x = turned(x, pos) if turn else x
        return (rms_norm(x) if qk_norm else x).reshape(len(x), -1)

    def own(pos, x):
        n = normed(x, "norm")
        return [headed(linear(n, "q"), pos, positions), headed(linear(n, "k"), pos, positions), linear(n, "v")]

    def added(name):
        return lambda pos, x, o: [x + linear(o, name)]

    def perceptron(pos, x):
        return [x + linear(gelu(linear(normed(x, "mlp_norm"), "up")), "down")]

    p = by_rows(rows, ["x"], own, ["q", "k", "v"])
    rows = by_rows(rows.join(attended(p, p, heads, bias), ["item", "pos"]), ["x", "o"], added("out"), ["x"])
    if context is not None:
        q = by_rows(rows, ["x"], lambda pos, x: [headed(linear(normed(x, "cross_norm"), "cross_q"), pos, False)], ["q"])
        kv = by_rows(context, ["x"], lambda pos, x: [headed(linear(x, "cross_k"), pos, False), linear(x, "cross_v")], ["k", "v"])
        rows = by_rows(rows.join(attended(q, kv, heads), ["item", "pos"]), ["x", "o"], added("cross_out"), ["x"])
    return by_rows(rows, ["x"], perceptron, ["x"])


def stack(rows: DataFrame, weights: Weights, heads: int, context: DataFrame | None = None, **options) -> DataFrame:
    """All layers one after the other."""
    for at in range(weights.layers):
        rows = layer(rows, weights, at, heads, context, **options)
    return rows
