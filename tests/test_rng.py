"""Draws by key."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from cadenza.functions.rng import above, uniform


@pytest.mark.parametrize("share", [0.0, 0.25, 0.6, 0.9999999999])
def test_above_is_the_comparison_of_the_draw(spark, share):
    k = F.col("id")
    rows = spark.range(20000).select(above(share, 12, k, k % 7).alias("a"), (uniform(12, k, k % 7) > share).alias("b"))
    assert rows.filter("a <> b or a is null").count() == 0


def test_cells_are_drawn_without_conversion(spark):
    plan = registered.queries()["masked_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan


def test_mask_cells_are_drawn_last_and_without_conversion(spark):
    plan = registered.queries()["combine_masks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and 0 < plan.index("< 20)") < plan.index("md5(")
