"""Folders that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_place(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, deleted when the program ends. Only a local session may lack that; it then gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rowlattice-")
    where = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, where)
    return where


def _delete(spark: SparkSession, where: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
