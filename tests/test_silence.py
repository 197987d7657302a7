import math

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as registered
from cadenza.operators import signal


def test_level_of_silence(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (100.0,), (None,)], "x double")
    level = signal.decibels(F.col("x"))
    assert [tuple(r) for r in rows.select(level, signal.compressor_db(level, -20.0, 4.0, 6.0)).collect()] == [(-math.inf, -math.inf), (0.0, -15.0), (40.0, -5.0), (None, None)]


def test_curve_of_odd_values_is_that_of_its_sql(spark, tmp_path):
    values = [0.0, -0.0, None, math.nan, math.inf, -math.inf, -1.0, -250.5, -5e-324, 5e-324, 1e-300, 1e308, 25.0, 50.0, 500.0]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: repr(r.db) for r in registered.queries()["compressor_curve"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
        assert got == {i: repr(v) for i, v in db.execute(registered.oracle_sql()["compressor_curve"]).fetchall()}
