"""Tables on the way: lineage is cut at Parquet in the shared folder, and what is spent is deleted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillbase.session import checkpoint_folder


class Scratch:
    """A folder of tables under the session's checkpoint folder; all go when the block ends, but those that ``last``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.lasting = f"{checkpoint_folder(spark)}/result-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(self.folder)

    def drop(self, path: str) -> None:
        """Delete a folder; one that isn't there is no error."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def keep(self, df: DataFrame, last: bool = False) -> DataFrame:
        """The same rows, written once and read again."""
        path = f"{self.lasting if last else self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, df: DataFrame, name: str, part: int) -> tuple[DataFrame, DataFrame]:
        """``df`` as a part of the table ``name``, which lasts: the part read again, and all parts so far."""
        path = f"{self.lasting}/{name}"
        df.write.parquet(f"{path}/part={part}")
        read = self.spark.read.schema(df.schema)
        return read.parquet(f"{path}/part={part}"), read.option("recursiveFileLookup", True).parquet(path)
