"""Written intermediate tables in the folder that all executors share.

Iterative operators cut their lineage with :func:`materialize`: the frame is written as parquet under
``spark.checkpoint.dir`` and read back, so a lost executor costs no recomputation of earlier rounds and the planner
sees real table sizes (which is what decides between a broadcast and a shuffled join in the next round).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master without the setting gets a temporary one."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="tutorgrain-")
        atexit.register(shutil.rmtree, _local_folder, True)
    return f"file://{_local_folder}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. The files go when the driver's JVM ends, or by release()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tutorgrain/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _on_exit(spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tutorgrain_path = path
    return back


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _on_exit(spark: SparkSession, path: str) -> None:
    fs, at = _filesystem(spark, path)
    fs.deleteOnExit(at)


def release(df: DataFrame) -> None:
    """Delete the files of a materialized frame that no later plan reads."""
    path = getattr(df, "_tutorgrain_path", None)
    if path:
        fs, at = _filesystem(df.sparkSession, path)
        fs.delete(at, True)
