"""What the operators of this subpackage share: table readers and the shared folder."""

from __future__ import annotations

import pickle
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions sent to executors travel by value, so executors need no copy of this repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])


BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Texts are long: Arrow batches of fewer rows keep a Python worker's memory small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode, else an error: no machine-local folder serves a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="provisio-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later stages read it and don't repeat what made it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the table that written() made, once nothing lazy reads it any more."""
    spark = df.sparkSession
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


class Sent:
    """A broadcast of any value of this package: bytes travel, and each task unpickles them once."""

    def __init__(self, spark: SparkSession, value: object):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self) -> object:
        return pickle.loads(self._bytes.value)
