"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or what the context's checkpoints are set to.

    Only in local mode, where there is one machine, a temporary folder serves if neither is set; on a
    cluster that is an error, as executors would write to folders of their own.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isEmpty():
        return found.get()
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="meridia-"))
