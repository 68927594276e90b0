"""Tables that cut lineage, in the folder the cluster shares.

A lost executor costs at most the tasks since the last written table. The
folder is ``spark.checkpoint.dir``. Only in local mode (tests, a laptop), where
one machine is all there is, does this module set one of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark)}/linkloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back with its own schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files under a table that :func:`written` made, once nothing reads it any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    for owner, path in list(_written):
        if any(f.split("/linkloom/")[-1].startswith(path.split("/linkloom/")[-1] + "/") for f in files):
            _delete(spark, path)
            _written.remove((owner, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, path)
