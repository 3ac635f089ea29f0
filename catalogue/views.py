"""Stand-in inputs (areas, zones, entities, spending, texts, ...) derived from the test tables by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# The columns read here, declared so that opening a table takes no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "documents": "doc_id bigint, text string, lang string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _rows_per_city(spark: SparkSession, sf_dir: str) -> Column:
    """Height of the tiling: one number from the part table, as a scalar subquery."""
    return table(spark, sf_dir, "part").agg(F.expr("cast(ceil(count(*) / 100) as bigint)")).scalar()


def number_rows(df: DataFrame, keys: Sequence[str], order: str, name: str, block: int = 10_000) -> DataFrame:
    """Row number per key along an integer column, without putting a whole key into one task.

    Rows are numbered within blocks of the ordering column; only the block counts are summed per key.
    """
    blocks = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    counts = blocks.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order))
    return (
        blocks.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_offset") + within)
        .drop("_block", "_offset")
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded unit boxes tiling each city; grades clustered in 4x4 blocks with noise and gaps."""
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as area_id", "p_size", "p_partkey % 5 as region_no",
        "cast(p_partkey div 5 % 20 as double) as x0", "cast(p_partkey div 5 div 20 as double) as y0",
    )
    letter = "if(p_size > 40, p_size, floor(x0 / 4) * 7 + floor(y0 / 4) * 3 + region_no) % 4"
    return parts.join(table(spark, sf_dir, "region"), F.expr("r_regionkey = region_no")).selectExpr(
        "r_name as city", "area_id", f"if(p_size > 48, null, element_at(array('A', 'B', 'C', 'D'), cast({letter} + 1 as int))) as grade",
        "x0", "y0", "x0 + 1 as x1", "y0 + 1 as y1",
    )


def _with_city(df: DataFrame, spark: SparkSession, sf_dir: str, nation_key: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    return df.join(places.selectExpr(f"n_nationkey as {nation_key}", "r_name as city"), nation_key)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with half-unit corners; ids restart in every city."""
    suppliers = _with_city(table(spark, sf_dir, "supplier"), spark, sf_dir, "s_nationkey")
    placed = suppliers.select("city", "s_suppkey", _rows_per_city(spark, sf_dir).alias("high")).selectExpr(
        "city", "s_suppkey", "cast(s_suppkey * 7 % 37 as double) / 2 as x0",
        "cast(s_suppkey * 13 % (high * 2) as double) / 2 as y0",
    )
    return number_rows(placed, ["city"], "s_suppkey", "zone_id").selectExpr(
        "city", "cast(zone_id as bigint) as zone_id", "x0", "y0",
        "x0 + cast(s_suppkey % 4 * 2 + 3 as double) / 2 as x1", "y0 + cast(s_suppkey % 3 * 2 + 3 as double) / 2 as y1",
    )


COUNT_COLUMNS = ["n_urgent", "n_high", "n_medium", "n_unspecified", "n_low"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with text-typed counts, a bad marker in one of them, and leading zeros in the id."""
    per_customer = table(spark, sf_dir, "orders").groupBy(F.expr("o_custkey as c_custkey")).agg(
        *[F.expr(f"count_if(o_orderpriority = '{p}') as {c}") for c, p in zip(COUNT_COLUMNS, PRIORITIES)],
        F.expr("count(o_orderkey) as n_total"), F.expr("count_if(o_orderstatus = 'F') as n_subsidised"),
    )
    customers = _with_city(table(spark, sf_dir, "customer"), spark, sf_dir, "c_nationkey").join(per_customer, "c_custkey", "left")
    text = "cast(coalesce({0}, 0) as string)".format
    return customers.select("*", _rows_per_city(spark, sf_dir).alias("high")).selectExpr(
        "city", "concat('0', c_custkey) as entity_id", "lower(c_mktsegment) as level",
        "if(c_custkey % 10 = 0, cast(c_custkey * 37 % 80 as double) / 4, cast(c_custkey * 7919 % 2000 as double) / 100) as x",
        "cast(c_custkey * 104729 % (high * 100) as double) / 100 as y",
        f"if(c_custkey % 23 = 0, '†', {text('n_urgent')}) as n_urgent",
        *[f"{text(c)} as {c}" for c in [*COUNT_COLUMNS[1:], "n_total", "n_subsidised"]],
    )


def spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount per id; some ids are missing."""
    means = table(spark, sf_dir, "orders").groupBy(F.expr("o_custkey as id")).agg(F.expr("avg(o_totalprice) as pp_total"))
    customers = table(spark, sf_dir, "customer").filter("c_custkey % 11 <> 0").selectExpr("c_custkey as id", "c_nationkey")
    return _with_city(customers, spark, sf_dir, "c_nationkey").join(means, "id").selectExpr("city as state", "id", "pp_total")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "if(doc_id % 19 = 0, null, text) as data")


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "cast(c_custkey * 7919 % 5800 as double) / 100 - 125 as lon",
        "cast(c_custkey * 104729 % 2400 as double) / 100 + 25 as lat",
    )


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal outcome with three 0/1 predictors."""
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey as o_custkey", "c_mktsegment")
    return table(spark, sf_dir, "orders").join(customers, "o_custkey").selectExpr(
        "o_orderkey as id", "o_orderpriority as outcome", "cast(o_totalprice > 250000 as int) as hi_value",
        "cast(o_orderstatus = 'F' as int) as is_final", "cast(c_mktsegment = 'BUILDING' as int) as is_building",
    )
