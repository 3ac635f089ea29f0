"""Result tables on disk, laid out for lookups by one column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def publish(df: DataFrame, path: str, by: str) -> None:
    """Parquet partitioned by ``by``. The rebalance hint evens out file sizes and splits a crowded value over tasks.

    Only the folders of values that ``df`` holds are replaced, so publishing one of them again neither doubles it nor
    touches the others.
    """
    df.hint("rebalance", by).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_published(spark: SparkSession, path: str, by: str, value: str | None = None) -> DataFrame:
    """The whole table, or just the folder of one value."""
    table = spark.read.parquet(path)
    return table if value is None else table.filter(table[by] == value)
