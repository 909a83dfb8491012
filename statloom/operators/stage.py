"""Intermediate tables in the shared folder of the session.

Every executor sees that folder, so a table written there survives lost executors, cuts the
lineage, and - being Parquet with statistics - is smaller than a checkpoint of rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_live: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="statloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Stage:
    """A folder of its own below the shared one, with one Parquet table per step.

    ``put`` writes a step and reads it back; ``drop`` deletes steps that no later one reads.
    What is left goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _live[self.path] = spark

    def put(self, df: DataFrame, step: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{step}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{step}")

    def drop(self, *steps: str) -> None:
        for step in steps:
            _delete(self.spark, f"{self.path}/{step}")


@atexit.register
def _clear() -> None:
    for path, spark in _live.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before the process
            pass
