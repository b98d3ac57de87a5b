"""Session defaults shared by tests, bench and ad-hoc use."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quillbase") -> SparkSession:
    """A local UTC session with adaptive execution; on a cluster the caller brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; where none is named, a folder of this
    machine if all tasks run in this process (as in tests), else an error."""
    context = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not have:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = tempfile.mkdtemp(prefix="quillbase-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(have)
    return have.rstrip("/")
