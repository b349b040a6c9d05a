"""Tables between steps, in the folder that driver and executors share; and helper names."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds after which finished shuffles are let go of once more.
RELEASE_AFTER = 1.0

#: Folders written by this process that results may still read.
_kept: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where no cluster names one (tests, local runs),
    a temporary folder of this machine is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="vocatio-checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


class Steps:
    """The tables of one operator's steps. Each is written whole, as Parquet, before the next step
    begins: what is built on it is neither computed twice nor lost with an executor, and the
    shuffles that led to it can go. ``drop`` deletes tables that no later step reads."""

    def __init__(self, spark: SparkSession, codec: str = "snappy"):
        self.spark, self.codec = spark, codec
        self.folder = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
        self.number = 0
        _kept.append(self.folder)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.number}.parquet"
        self.number += 1
        df.write.parquet(path, compression=self.codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_written"] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := t.__dict__.pop("_written", None):
                _delete(self.spark, path)

    def release(self) -> None:
        """Lets go of the shuffles of finished steps: Spark deletes a shuffle's files once the driver
        has collected the plan that made it, which else may take half an hour. Just after a step its
        events still hold the plan, so a second collection follows the first."""
        for wait in (0, RELEASE_AFTER):
            time.sleep(wait)
            gc.collect()
            self.spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed in the shared folder: for small tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read from there."""
    return Steps(df.sparkSession).write(df)


def sweep(spark: SparkSession) -> None:
    """Deletes every table that this process wrote between steps. To be called once the results that
    were made from them are stored; what no result reads has been deleted before."""
    while _kept:
        _delete(spark, _kept.pop())


def helper(df: DataFrame, *others: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in [*df.columns, *others]}
    n = 0
    while f"__helper{n}" in taken:
        n += 1
    return f"__helper{n}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
