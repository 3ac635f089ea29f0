"""Column and row reshaping that takes more than one DataFrame call."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zoneloom.session import cut_lineage


def clean_headers(df: DataFrame, pattern: str) -> DataFrame:
    """Delete regex matches from every column name."""
    names = [re.sub(pattern, "", c) for c in df.columns]
    repeated = {n for n in names if names.count(n) > 1}
    if repeated or "" in names:
        raise ValueError(f"cleaning leaves repeated or empty column names: {sorted(repeated)}")
    return df.toDF(*names)


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from ``first`` to ``last`` in table order."""
    start, stop = df.columns.index(first), df.columns.index(last)
    return df.columns[start : stop + 1]


def coerce_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Named columns as doubles; what is not a number becomes NULL."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in names})


def union_tagged(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Like-named tables on top of each other, each row tagged with its table's key."""
    tagged = [df.withColumn(tag, F.lit(key)) for key, df in tables.items()]
    return reduce(DataFrame.unionByName, tagged)


def nest(df: DataFrame, keys: Sequence[str], member_id: str, name: str, block: int = 1000) -> DataFrame:
    """Rows nested as arrays of structs, ordered by ``member_id``, per key and block of ids.

    A key's rows are not gathered in one array: each array takes the ids of one block, so with a unique integer
    id it holds at most ``block`` members. ``explode`` gives the flat table back.
    """
    members = F.struct(member_id, *[c for c in df.columns if c not in (*keys, member_id)])
    return (
        df.withColumn("block", F.floor(F.col(member_id) / F.lit(block)))
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_list(members)).alias(name))
    )


def nest_counted(df: DataFrame, keys: Sequence[str], member_id: str, name: str, block: int = 1000) -> DataFrame:
    """Rows nested as arrays of structs, ordered by ``member_id`` (missing ones first), ``block`` members to an array.

    Works for ids of any type, repeated and missing ones included: rows are dealt by ranges of key and id, counted per
    range and numbered within it, so a key with any number of rows without an id is still spread over tasks and no array
    is over ``block``. Rows with the same id come in any order.
    """
    order = [*[F.asc_nulls_first(c) for c in (*keys, member_id)], F.asc("_tie")]
    tied = cut_lineage(df.withColumn("_tie", F.monotonically_increasing_id()))
    dealt = cut_lineage(tied.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    at = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    numbered = dealt.withColumn("_at", at).join(starts, same).withColumn("_at", F.col("_start") + F.col("_at"))
    members = F.struct(member_id, *[c for c in df.columns if c not in (*keys, member_id)])
    placed = numbered.select(*keys, F.floor(F.col("_at") / block).alias("block"), F.struct("_at", members.alias("m")).alias("p"))
    return placed.groupBy(*keys, "block").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["m"]).alias(name))


def mean_all_columns(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of every other column, skipping missing values."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in df.columns if c not in by])
