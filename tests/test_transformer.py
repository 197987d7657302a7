"""Transformer layers with attention by blocks against NumPy over whole sequences."""

import numpy as np
import pytest

from cadenza.operators import transformer as tr

RNG = np.random.RandomState(5)
SHAPES = {"q": (8, 8), "k": (8, 8), "v": (8, 8), "out": (8, 8), "cross_q": (8, 8), "cross_k": (8, 8), "cross_v": (8, 8), "cross_out": (8, 8), "up": (12, 8), "down": (8, 12)}
WEIGHTS = {(layer, n): RNG.randn(*s) / 3 for layer in range(2) for n, s in SHAPES.items()}
WEIGHTS |= {(layer, n): RNG.randn(1, 8) / 3 + 1 for layer in range(2) for n in ("norm", "norm_bias", "cross_norm", "mlp_norm", "q_bias", "out_bias")}
X = {1: RNG.randn(11, 8), 2: RNG.randn(1, 8), 3: RNG.randn(5, 8)}
C = {1: RNG.randn(7, 8), 3: RNG.randn(4, 8)}
VALID = {k: np.arange(len(x)) % 4 != 2 for k, x in (X | {4: np.zeros(0)}).items()}


def attend(q, k, v, kv, qv, bias=0.0):
    out = np.zeros_like(q)
    for h in range(2):
        cut = slice(4 * h, 4 * h + 4)
        s = q[:, cut] @ k[:, cut].T / 2 + bias
        s = np.where(kv[None], s, -np.inf)
        if kv.any():
            e = np.exp(s - np.maximum(s.max(1, keepdims=True), -1e300))
            out[:, cut] = e @ v[:, cut] / np.maximum(e.sum(1, keepdims=True), 1e-300)
    return out * qv[:, None]


def whole(x, valid, context, norm, bias=0.0):
    rms = lambda x: x / np.sqrt((x * x).mean(-1, keepdims=True) + 1e-8)
    heads = lambda x: np.concatenate([rms(x[:, :4]), rms(x[:, 4:])], 1)
    turn = lambda x: np.concatenate([tr.turned(x[:, :4], np.arange(len(x))), tr.turned(x[:, 4:], np.arange(len(x)))], 1)
    for layer in range(2):
        w = lambda n, layer=layer: WEIGHTS[layer, n]
        normed = lambda x, n: ((x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * w(n) + (w("norm_bias") if n == "norm" else 0)) if norm == "layer" else rms(x) * w(n)  # noqa: E731, B023
        n = normed(x, "norm")
        x = x + attend(heads(turn(n @ w("q").T + w("q_bias"))), heads(turn(n @ w("k").T)), n @ w("v").T, valid, valid, bias) @ w("out").T + w("out_bias")
        if context is not None:
            x = x + attend(heads(normed(x, "cross_norm") @ w("cross_q").T), heads(context @ w("cross_k").T), context @ w("cross_v").T, np.ones(len(context), bool), valid) @ w("cross_out").T
        x = x + tr.gelu(normed(x, "mlp_norm") @ w("up").T) @ w("down").T
    return x


@pytest.mark.parametrize("norm,block,crossed", [("layer", 256, True), ("rms", 3, False), ("layer", 3, True)])
def test_stack_equals_numpy(spark, monkeypatch, norm, block, crossed):
    monkeypatch.setattr(tr, "BLOCK", block)
    table = spark.createDataFrame([(layer, n, i, r.tolist()) for (layer, n), m in WEIGHTS.items() for i, r in enumerate(m)], "layer int, name string, row int, w array<double>")
    of = lambda data, valid: spark.createDataFrame([(k, i, v.tolist(), bool(valid is None or valid[k][i])) for k, x in data.items() for i, v in enumerate(x)], "item int, pos int, x array<double>, valid boolean")
    causal = None if crossed else (lambda a, b: np.where(a[:, None] >= b[None], 0.0, -np.inf))
    out = tr.stack(of(X, VALID), tr.Weights(table), 2, of(C, None) if crossed else None, norm=norm, bias=causal)
    got = {(r.item, r.pos): r.x for r in out.collect()}
    for k, x in X.items():
        bias = np.where(np.tri(len(x)) > 0, 0.0, -np.inf) if causal else 0.0
        want = whole(x, VALID[k], C.get(k, np.zeros((0, 8))) if crossed else None, norm, bias)
        assert np.array([got[k, i] for i in range(len(x))]) == pytest.approx(want, abs=1e-9)
