"""Tables that cut lineage: written once to the shared folder, read any number of times."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from gaugeworks.errors import RunError

_ours: dict[str, SparkSession] = {}
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of our own only where a local master has none, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RunError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="gaugeworks-tables-"))
    return f"file://{_local[0]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of whatever store; nothing happens if it is not there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def own_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/gaugeworks-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _ours[path] = spark
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table that outlives lost executors and goes when the driver ends."""
    path = own_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for path, spark in _ours.items():
        try:
            remove(spark, path)
        except (PySparkException, OSError, AttributeError):  # the session has ended: the folder is the cluster's to clear
            return
        except Exception as e:  # py4j raises its own kinds once the gateway is gone
            if type(e).__module__.startswith("py4j"):
                return
            raise
