"""The folder that driver and executors share for tables of one run."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

from ..errors import RelqError


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session in one process gets a temporary one; on a cluster
    that is an error, as other machines would not see it."""
    where, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not where and held.isDefined():
        where = held.get()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RelqError(None, "spark.checkpoint.dir is not set: name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="relq-")
        atexit.register(shutil.rmtree, where, True)
    if not held.isDefined():
        context.setCheckpointDir(where)
    return where.rstrip("/")
