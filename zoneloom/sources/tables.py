"""Tabular inputs and named views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workbook import scan_sheets


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A sheet with every column as text: CSV with a header, Parquet for ``.parquet`` paths, the first sheet for ``.xlsx`` paths.

    ``columns`` declares the CSV header, which is then checked instead of read beforehand, or picks columns of a workbook.
    """
    if path.endswith(".xlsx"):
        return scan_sheets(spark, path, columns)
    if path.rstrip("/").endswith(".parquet"):
        table = spark.read.parquet(path)
        return table.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) for f in table.schema.fields])
    if columns is None:
        return spark.read.csv(path, header=True, inferSchema=False)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def read_csv(spark: SparkSession, path: str, schema: str, long_text: bool = False) -> DataFrame:
    """CSV with a header and a declared schema. ``long_text`` allows line breaks inside quoted text."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=long_text, escape='"')


def register_tables(tables: Mapping[str, DataFrame]) -> None:
    """Each table as a temporary view under its key."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
