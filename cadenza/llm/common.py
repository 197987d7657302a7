"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words and that normalisation folds into one space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster, where no
    local folder would do, this raises ValueError.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _local_dir(spark.sparkContext.applicationId)
    return path.rstrip("/")


@functools.cache
def _local_dir(application: str) -> str:
    path = tempfile.mkdtemp(prefix=f"{application}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it.

    The scan has no lineage behind it, so a lost executor costs a re-read and nothing more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cadenza/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Have Arrow batches of the session end at about ``most`` bytes, unless it has a bound already.

    Batches are counted in rows otherwise, and whole texts differ in size by orders of magnitude.
    Results are lazy, so the bound stays; it changes no result of this or any other operator.
    """
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def lean(run):
    """``run`` over Arrow batches, handing back what the worker's allocators hold once it is done.

    Workers outlive a task and run all kinds of stages; freed pages that they keep count against the
    executor all the same.
    """

    @functools.wraps(run)
    def through(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return through


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded(text: Column) -> Column:
    """Text with every run of separators replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def word_count(text: Column) -> Column:
    """Number of words. The text is folded first, so counting is one pass over its spaces."""
    one = F.trim(folded(text))
    spaces = F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit("")))
    return F.when(one == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows
