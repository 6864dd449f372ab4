"""Where a session keeps what it writes on the way."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where none is named, a folder of this machine's own serves in local mode; on a cluster, whose executors couldn't see
    it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="cubespark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made
