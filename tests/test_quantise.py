"""Residual quantisation and split batches against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import items, quantise

RNG = np.random.RandomState(8)
LEVELS = [(i, RNG.randn(3, 6), RNG.randn(3), RNG.randn(6, 3) / 4, RNG.randn(6) / 9) for i in range(3)]
BOOKS = [RNG.randn(7, 3) for _ in range(3)]
FRAMES = RNG.randn(40, 6)


@pytest.fixture(scope="module")
def tables(spark):
    kinds = "level int, inward array<array<double>>, inward_bias array<double>, outward array<array<double>>, outward_bias array<double>"
    levels = spark.createDataFrame([(i, *(x.tolist() for x in m)) for i, *m in LEVELS], kinds)
    books = spark.createDataFrame([(i, 10 + c, v.tolist()) for i, b in enumerate(BOOKS) for c, v in enumerate(b)], "level int, code long, c array<double>")
    return levels, books


def test_codes_and_their_sums_equal_numpy(spark, tables):
    frames = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(FRAMES)], "frame long, v array<double>")
    got = {r.frame: r for r in quantise.encoded(frames, *tables).collect()}
    back = {r.frame: r.quantised for r in quantise.decoded(quantise.encoded(frames, *tables).select("frame", "codes"), *tables).collect()}
    for i, v in enumerate(FRAMES):
        rest, total = v.copy(), np.zeros(6)
        for level, ((_, w, b, out, c), book) in enumerate(zip(LEVELS, BOOKS, strict=True)):
            z = w @ rest + b
            best = np.argmax(book @ z / np.linalg.norm(book, axis=1))
            assert got[i].codes[level] == 10 + best and got[i].latents[3 * level : 3 * level + 3] == pytest.approx(z)
            total += out @ book[best] + c
            rest = v - total
        assert got[i].quantised == pytest.approx(total) and got[i].residual == pytest.approx(rest) and back[i] == pytest.approx(total)
    part = spark.createDataFrame([(0, [10]), (1, [])], "frame long, codes array<long>")
    assert {r.frame: r.quantised is None for r in quantise.decoded(part, *tables).collect()} == {0: False, 1: True}
    with pytest.raises(Exception, match="level 1 has no code 3"):
        quantise.decoded(spark.createDataFrame([(0, [10, 3])], "frame long, codes array<long>"), *tables).collect()


def test_collated(spark):
    rows = spark.createDataFrame([(b, i, [1.0] * ((i * 3 + b) % 5)) for b, n in ((1, 7), (2, 2), (3, 1)) for i in range(n)], "batch int, item int, v array<double>")
    got = quantise.collated(rows, F.when(F.col("batch") == 1, 3).otherwise(4)).collect()
    for b, n, per in ((1, 7, 3), (2, 2, 1), (3, 1, 1)):
        mine = {r.item: r for r in got if r.batch == b}
        assert [mine[i].part for i in range(n)] == [i // per for i in range(n)]
        for i in range(n):
            same = [(j * 3 + b) % 5 for j in range(n) if j // per == i // per]
            assert mine[i].length == (i * 3 + b) % 5 and mine[i].v == [1.0] * mine[i].length + [0.0] * (max(same) - mine[i].length)


def test_summed_embeddings(spark):
    tokens = spark.createDataFrame([(1, k, 0, 2, k < 2, k == 2) for k in range(4)], "item int, codebook int, frame int, token int, keep boolean, current boolean")
    table = spark.createDataFrame([(2 + 4 * k, [float(k), 1.0]) for k in range(2)], "id int, v array<double>")
    mask = F.array(F.lit(0.5), F.lit(0.25))
    assert items.summed_embeddings(tokens, table, mask, 4, 2).first().v == [1.5, 2.25]
    with pytest.raises(Exception, match="no vector for 2"):
        items.summed_embeddings(tokens, table.filter("id > 2"), mask, 4, 2).collect()
