"""Keeping a document of query results fresh: gate, results written aside, fallback to earlier data, run summary."""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
FORMATS = ("parquet", "json")


def is_fresh(updated_ms: Column, now_ms: int, max_age_ms: int = DAY_MS) -> Column:
    """Whether a result is younger than ``max_age_ms``; a missing time is not fresh."""
    return F.coalesce(F.lit(now_ms) - updated_ms < max_age_ms, F.lit(False))


def publish(result: DataFrame, folder: str, name: str, fmt: str = "parquet") -> str | None:
    """Write a result beside the earlier ones of its name, which stay; the error's text if the job fails, else None.

    Readers take the newest folder that Spark marked as complete, so a job that fails half-way changes nothing.
    """
    try:
        result.write.format(fmt).save(f"{folder}/{name}/{fmt}/run-{time.time_ns():020d}")
    except PySparkException as error:
        return str(error)
    return None


def latest(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The newest complete result of a name, of any format; None if there is none."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/*/run-*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    runs = [str(x.getPath().getParent()) for x in found or []]
    if not runs:
        return None
    last = max(runs, key=lambda path: path.rsplit("/", 1)[1])
    return spark.read.format(last.rsplit("/", 2)[1]).load(last)


def with_earlier(current: DataFrame, earlier: DataFrame, key: str = "name") -> DataFrame:
    """Result documents (key, rows, error, updated_ms) by key: this run's rows, else the earlier ones with this run's error.

    ``outcome`` is fresh, kept or failed. Keys of either side are in the result.
    """
    old = earlier.select(F.col(key).alias("_key"), F.col("rows").alias("_rows"), F.col("updated_ms").alias("_updated"))
    out = current.join(old, F.col(key) == F.col("_key"), "full")
    good = F.col("error").isNull() & F.col("rows").isNotNull()
    return out.select(
        F.coalesce(key, "_key").alias(key),
        F.when(good, F.col("rows")).otherwise(F.col("_rows")).alias("rows"),
        F.when(good, F.col("updated_ms")).otherwise(F.col("_updated")).alias("updated_ms"),
        "error",
        F.when(good, "fresh").when(F.col("_rows").isNotNull(), "kept").otherwise("failed").alias("outcome"),
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of an outcome table (name, outcome): queries, ok (with data), fresh and failed."""
    is_ = lambda *x: F.count_if(F.col("outcome").isin(*x))
    return outcomes.agg(F.count(F.lit(1)).alias("queries"), is_("fresh", "kept").alias("ok"), is_("fresh").alias("fresh"), is_("failed").alias("failed"))


def contract_error(document: DataFrame, version: int, needed: tuple[str, ...]) -> Column:
    """What a reader of a status document must refuse: another schema version, or one of the needed keys missing; else null."""
    absent = [k for k in needed if k not in document.columns]
    lacking = F.lit(bool(absent))
    for k in needed:
        if k not in absent:
            lacking = lacking | F.col(k).isNull()
    return F.when(~F.col("schemaVersion").eqNullSafe(F.lit(version)), "unknown schema version").when(lacking, "required keys are missing")
