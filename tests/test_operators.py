import pytest
from pyspark.sql import functions as F

from cadenza.operators import decode, features, manifest, signal


def test_moving_average_reflects(spark):
    rows = spark.createDataFrame([(1, i, float(i + 1)) for i in range(5)], "k int, t int, x double")
    assert [r.ma for r in signal.moving_average(rows, 4, ["k"]).orderBy("t").collect()] == [2.0, 2.5, 3.5, 4.0, 4.0]
    assert [r.ma for r in signal.moving_average(rows, 1, ["k"]).orderBy("t").collect()] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_quantise_is_half_even(spark):
    assert spark.range(1).select(features.quantise(F.lit(0.625), 5)).first()[0] == 0.5


def test_delay_of_an_impulse(spark):
    rows = spark.createDataFrame([(1, i, float(i == 0)) for i in range(5)], "k int, t int, x double")
    assert [r.y for r in signal.delay(rows, 2, 0.5, 2, 1.0, ["k"]).orderBy("t").collect()] == [0, 0, 0.5, 0, 0.25]


@pytest.mark.parametrize("p", [0.4, 0.6])
def test_top_p_keeps_the_first_row_only(spark, p):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.5, 0.3, 0.2])], "pos int, cls int, q double").withColumn("logit", F.log("q"))
    assert [r.cls for r in decode.top_p(rows, p).collect()] == [0]


def test_top_k_keeps_ties(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([3.0, 2.0, 2.0, 1.0])], "pos int, cls int, logit double")
    assert decode.top_k(rows, 2).count() == 3


def test_split_sizes(spark):
    got = manifest.proportional_split(spark.range(17), "id", (0.8, 0.1, 0.1), 3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 13, "val": 1, "test": 3}


@pytest.mark.parametrize("raw, want", [([0.2, -1.0, 0.3], [0.4, 0.0, 0.6]), ([0.0, 0.0], [0.5, 0.5])])
def test_source_weights(spark, raw, want):
    rows = spark.createDataFrame(list(enumerate(raw)), "source int, r double")
    assert [r.w for r in manifest.source_weights(rows, "r").orderBy("source").collect()] == pytest.approx(want)
