"""Tables and the inputs derived from them. Everything is lazy; scans prune to the columns used."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signal_id, channel, t, x``: one signal per user, samples in order of time."""
    t = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("signal_id"), F.col("event_type").alias("channel"), t.alias("t"), F.col("value").alias("x"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, cls, logit, target, codebook``."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("label").alias("target"), (F.col("vec_id") % 9).cast("int").alias("codebook"), F.posexplode("embedding").alias("cls", "logit"))
    return rows.withColumn("logit", F.round(F.col("logit").cast("double") * 8, 6))


def spread(items: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to as many tasks as the session shuffles to, eight a core at least, before each becomes many.

    A small file is a single split, and adaptive execution joins small partitions unless their number is given.
    """
    spark = items.sparkSession
    return items.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


def grid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item``: one per customer."""
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"))


def positions(items: DataFrame, codebooks: int = 9, frames: int = 100) -> DataFrame:
    """Columns of ``items`` at each ``codebook, frame``. What depends on an item alone is computed before."""
    rows = spread(items, "item").select("*", F.explode(F.sequence(F.lit(0), F.lit(codebooks - 1))).alias("codebook"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"))


def grid(spark: SparkSession, sf_dir: str, codebooks: int = 9, frames: int = 100) -> DataFrame:
    """``item, codebook, frame``: positions of token grids, one grid per customer."""
    return positions(grid_items(spark, sf_dir), codebooks, frames)
