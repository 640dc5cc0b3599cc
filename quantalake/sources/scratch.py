"""Tables and folders that a job needs on its way, in the store that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a session within one machine may leave that unset (tests, a
    notebook): it gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spark-quantalake-")
        _local[context.applicationId] = base
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts the lineage and is computed a single time."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            jvm = df.sparkSession.sparkContext._jvm
            own = jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(own, True)
