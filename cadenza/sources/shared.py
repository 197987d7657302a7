"""The folder that driver and executors share."""

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local session without one has a temporary folder, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/cadenza/{name}-{uuid.uuid4().hex}"


@functools.cache
def _own(application: str) -> str:
    path = tempfile.mkdtemp(prefix=f"{application}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
