"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A session for one machine; on a cluster use the one that is there."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for k, v in more.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoints(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; on one machine, where none is set, a new temporary one."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()
