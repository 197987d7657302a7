"""Iterative generation against NumPy, all codebooks and rounds."""

import math

import numpy as np
import pytest
from test_transformer import WEIGHTS, whole

from cadenza.operators import generation, transformer

RNG = np.random.RandomState(9)
CLASSES, FRAMES, ITEMS = 5, 6, 2
EMBEDDED, MASK = RNG.randn(2 * CLASSES, 8), RNG.randn(8)
FEATURES = RNG.randn(ITEMS, FRAMES, 3)
EXTRA = {(0, "features"): RNG.randn(8, 3), (0, "head0"): RNG.randn(CLASSES, 8) * 2, (0, "head1"): RNG.randn(CLASSES, 8) * 2}


def logits(tokens, keep, current, features):
    x = np.zeros((FRAMES, 8))
    for c in range(2):
        for f in range(FRAMES):
            x[f] += EMBEDDED[c * CLASSES + tokens[c, f]] if keep[c, f] else MASK * (c == current)
    return whole(x + features @ EXTRA[0, "features"].T, np.ones(FRAMES, bool), None, "layer") @ EXTRA[0, f"head{current}"].T


@pytest.mark.parametrize("guidance", [2.0])
def test_generation_equals_numpy(spark, guidance):
    given = RNG.randint(0, CLASSES, (ITEMS, 2, FRAMES))
    kept = np.zeros((ITEMS, 2, FRAMES), bool)
    kept[:, :, :2] = True
    kept[1, 1] = True
    tokens = spark.createDataFrame([(i, c, f, int(given[i, c, f]), bool(kept[i, c, f])) for i in range(ITEMS) for c in range(2) for f in range(FRAMES)], "item int, codebook int, frame int, token int, keep boolean")
    features = spark.createDataFrame([(i, f, FEATURES[i, f].tolist()) for i in range(ITEMS) for f in range(FRAMES)], "item int, frame int, f array<double>")
    table = spark.createDataFrame([(layer, n, i, r.tolist()) for (layer, n), m in (WEIGHTS | EXTRA).items() for i, r in enumerate(m)], "layer int, name string, row int, w array<double>")
    vectors = spark.createDataFrame([(-1, MASK.tolist()), *((i, v.tolist()) for i, v in enumerate(EMBEDDED))], "id int, v array<double>")
    model = generation.Model(transformer.Weights(table), vectors, CLASSES, 8, 2)
    out = generation.generated(model, tokens, features, [generation.Sampling(iterations=2, guidance=guidance, argmax=True)] * 2, 1)
    got = {(r.item, r.codebook, r.frame): (r.token, r.keep) for r in out.collect()}
    for item in range(ITEMS):
        t, k = given[item].copy(), kept[item].copy()
        for c in range(2):
            start = (~k[c]).sum()
            for i in (1, 2):
                z = logits(t, k, c, FEATURES[item])
                if guidance:
                    u = logits(t, k, c, FEATURES[item] * 0)
                    z = u + guidance * (z - u)
                best = z.argmax(1)
                p = np.exp(z - z.max(1, keepdims=True))
                p = (p / p.sum(1, keepdims=True)).max(1)
                left = math.floor(round(start * max(math.cos(i / 2 * math.pi / 2), 1e-10), 6))
                order = sorted(np.flatnonzero(~k[c]), key=lambda f: (-round(math.log(max(p[f], 1e-12)), 9), f))  # noqa: B023
                for f in order[: len(order) - left]:
                    t[c, f], k[c, f] = best[f], True
        assert k.all()
        assert {(item, c, f): (t[c, f], True) for c in range(2) for f in range(FRAMES)} == {x: v for x, v in got.items() if x[0] == item}
