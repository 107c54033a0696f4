"""Tables staged in the folder that driver and executors share, to cut lineage between rounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local master has a folder of its own until it ends; a cluster raises."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="impactgraph-staged-")
            atexit.register(shutil.rmtree, _OWN[app], True)
        base = _OWN[app]
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again; a lost executor then costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, df.staged_path)
        _STAGED.remove(df.staged_path)


def sweep(spark: SparkSession) -> None:
    """Deletes every table staged so far; to be called when results have been read."""
    while _STAGED:
        delete(spark, _STAGED.pop())
