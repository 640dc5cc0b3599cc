"""Order statistics of streams: how often each value came, in a table that a stream keeps.

A batch of the stream adds a folder of counts named by its number, so a batch that runs again replaces what it wrote
before. Every so many batches the counts so far are summed into a base, and the folders that went into it are removed.
Ranks and quantiles are read from the counts at any time, between batches and after a restart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quantalake.operators.quantiles import S, ContParam, quantiles

#: Batches that are summed into a base.
BATCHES = 32


def _folders(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The number of the last complete base (-1: none) and those of the complete batches after it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return -1, []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    numbers = {kind: [int(m[1]) for n in done if (m := re.fullmatch(rf"{kind}=(\d+)", n))] for kind in ("base", "batch")}
    base = max(numbers["base"], default=-1)
    return base, sorted(n for n in numbers["batch"] if n > base)


def _remove(spark: SparkSession, path: str, upto: int) -> None:
    """Remove what went into the base of that number."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(root):
        m = re.fullmatch(r"(base|batch)=(\d+)", s.getPath().getName())
        if m and int(m[2]) <= upto - (m[1] == "base"):
            fs.delete(s.getPath(), True)


def keep_counts(batch: DataFrame, number: int, by: list[str], x: str, path: str, every: int = BATCHES) -> None:
    """Add a batch to the counts in ``path``; adding it again changes nothing."""
    spark = batch.sparkSession
    base, _ = _folders(spark, path)
    if number <= base:  # it's in the base: the stream was stopped before it took note of the batch
        return
    batch.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("times")).write.mode("overwrite").parquet(f"{path}/batch={number}")
    if (number + 1) % every == 0:
        value_counts(spark, path, by, x).write.mode("overwrite").parquet(f"{path}/base={number}")
        _remove(spark, path, number)


def count_values(stream: DataFrame, by: list[str], x: str, path: str, every: int = BATCHES) -> DataStreamWriter:
    """A writer of the stream that keeps counts by ``by`` and value in ``path``; give it a checkpoint and start it."""
    own = stream.select(*by, x)
    return own.writeStream.foreachBatch(lambda batch, number: keep_counts(batch, number, by, x, path, every))


def value_counts(spark: SparkSession, path: str, by: list[str], x: str) -> DataFrame:
    """``by``, x and times, over all batches that are complete. An error before the first one."""
    base, batches = _folders(spark, path)
    found = [f"{path}/base={base}"] * (base >= 0) + [f"{path}/batch={n}" for n in batches]
    return spark.read.parquet(*found).groupBy(*by, x).agg(F.sum("times").alias("times"))


def stream_quantiles(spark: SparkSession, path: str, by: list[str], x: str, ks: list[int], q: int, param: ContParam = S) -> DataFrame:
    """``by`` and the k-th q-quantiles of all values so far."""
    return quantiles(value_counts(spark, path, by, x), by, x, ks, q, param, "times")
