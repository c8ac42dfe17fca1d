"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; on a cluster master comes from the submit command."""
    builder = SparkSession.builder.appName("tallyworks").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share (``spark.checkpoint.dir``), for what a query writes.

    Only where the session names none and all runs on one machine it is a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="tallyworks-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()
