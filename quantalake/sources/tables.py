"""Reading and writing samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder. Filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV file with a given schema; a value that isn't of its type fails."""
    return spark.read.schema(schema).options(header=header, mode="FAILFAST").csv(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(mode="FAILFAST").json(path)


def save(df: DataFrame, path: str, kind: str = "parquet", partitions: list[str] | None = None) -> None:
    """Write a new folder of Parquet, JSON, ORC or CSV."""
    writer = df.write.format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partitions) if partitions else writer).save(path)


def to_json(value: Column) -> Column:
    """An estimate, interval or test as JSON text; nulls are kept, so that reading gives the same struct."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def from_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "FAILFAST"})
