"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it only a local master gets a folder of
    its own, since other machines would not see one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="factflow-")
    return shared_dir.own


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and read it back: its lineage ends here and it
    outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``settle`` wrote, once no plan reads it any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._settled)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
