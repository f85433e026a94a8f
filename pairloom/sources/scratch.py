"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application's own in spark.checkpoint.dir.

    Where that is unset, a local run gets a temporary folder, which goes when Python ends; on a
    cluster, whose executors do not see the driver's disk, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return f"{base.rstrip('/')}/pairloom-{spark.sparkContext.applicationId}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="pairloom"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all that this application has written there; tables read from it are gone then."""
    jvm, path = spark.sparkContext._jvm, scratch_dir(spark)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to scratch_dir() and read back."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
