"""Near-duplicates by MinHash against brute force: components, chunks, nulls, repeats and the posterior's bound."""

import numpy as np
import pytest

from cadenza.llm import minhash
from test_llm import SCHEMA, TEXTS, brute_components, documents, near_copies


def found(spark, rows, **options):
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got)


def expected(rows, k, num, den=100):
    components, sizes = brute_components(rows, k, num, den)
    return sorted((str(d), n, str(c), d == c) for (d, _), c, n in zip(rows, components, sizes, strict=True))


def test_edge_cases_and_clashing_names(spark):
    got = minhash.near_duplicates(documents(spark, TEXTS), k=3, num=85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == expected(list(enumerate(TEXTS)), 3, 85)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, TEXTS[7]), (None, TEXTS[7]), (None, None), (5, TEXTS[7]), (5, TEXTS[7]), (5, "other words here"), (4, TEXTS[10])]
    assert found(spark, rows, k=3, num=85) == expected(rows, 3, 85)


@pytest.mark.parametrize("block,deals", [(16, 8), (16, 0)])
def test_components_of_near_copies_equal_brute_force(spark, block, deals):
    rng = np.random.RandomState(block + deals)
    texts = near_copies(rng, 120) + near_copies(rng, 40, words=60, edits=2) + [t for _ in range(30) for t in near_copies(rng, 2, edits=5, styles=False)]
    rows = [(int(d), t) for d, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    assert found(spark, rows, k=3, num=85, block=block, deals=deals) == expected(rows, 3, 85)


def test_pairs_at_the_threshold_are_found(spark):
    # 85 of 100 shingles shared, or one fewer
    rows = []
    for i in range(60):
        words = [f"p{i}x{j}" for j in range(200)]
        same = 85 if i % 2 else 84
        a = words[:92]
        b = words[:same] + [f"q{i}x{j}" for j in range(8 if i % 2 else 8)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    assert found(spark, rows, k=1, num=85) == expected(rows, 1, 85)


def test_posterior_bound():
    from math import comb

    for n, miss in ((16, 1e-6), (96, 1e-6), (96, 1e-2)):
        m = minhash.least_matches(n, 85, 100, miss)
        chance = lambda m, n=n: sum(comb(n + 1, i) * 0.85**i * 0.15 ** (n + 1 - i) for i in range(m + 1))
        assert chance(m) >= miss and (m == 0 or chance(m - 1) < miss)
    checks = np.array([[1] * 32, [1] * 32, [2] * 32], np.uint8)
    assert minhash.surviving(checks, np.array([0, 0]), np.array([1, 2]), 16, [4, 9]).tolist() == [0]


def test_minima_estimate_the_similarity():
    rng = np.random.RandomState(7)
    pool = rng.randint(0, 2**63, 3000).astype(np.uint64)
    a, b = (minhash.minima(np.unique(x), minhash.hash_family(4096)) for x in (pool[:2000], pool[1000:]))
    assert abs((a == b).mean() - 1 / 3) < 0.03
