"""Exact quantiles of groups of any size."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Binary logarithms of doubles lie between -1074 and 1024: added, it makes them positive, and their span stays below.
_LIFT, _SPAN = 1080, 2200


def _counted(placed: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows, least and greatest value per bucket, and the group's rows up to the bucket's end and in all."""
    whole = Window.partitionBy(*group)
    running = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = placed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return counts.select("*", F.sum("_n").over(running).alias("_upto"), F.sum("_n").over(whole).alias("_total"))


def _same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> list[Column]:
    return [left[c].eqNullSafe(right[f"_by{i}"]) for i, c in enumerate(by)]


def _renamed(df: DataFrame, by: Sequence[str], *others: str | Column) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *others)


def _inside(rows: DataFrame, buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows in the given buckets, each with its bucket; buckets of a group share no value."""
    spans = _renamed(buckets, by, "_before", "_lo", "_hi").distinct()
    within = (rows["_v"] >= spans["_lo"]) & (rows["_v"] <= spans["_hi"])
    on = functools.reduce(operator.and_, [*_same(rows, spans, by), within])
    return rows.join(spans, on).select(*by, "_v", "_before", "_lo", "_hi")


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], buckets: int = 65_536, bound: int = 65_536
) -> DataFrame:
    """``(by, prob, quantile)`` by linear interpolation between the two neighbouring order statistics.

    The built-in exact percentile gathers all of a group's values in one task. Here the rows are only counted in
    buckets, first by sign and logarithm, which shows the bucket of each wanted rank. A bucket of more than ``bound``
    rows with different values is divided again between its own least and greatest value, until the wanted ones are
    small or hold one value; the rows of small ones are then numbered. Close values beside far ones cost another count
    (four at most with the default number of buckets), not a large window. Null groups are groups; null and NaN values
    are left out, and a group without others has no row.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    half = buckets // 2
    scaled = f"signum(_v) * (log2(abs(_v)) + {_LIFT}) * {half} / {_SPAN}"
    placed = rows.withColumn("_bucket", F.expr(f"if(_v = 0, 0, cast(floor(greatest(least({scaled}, {half}D), -{half}D)) as int))"))
    wanted = cut_lineage(
        _counted(placed, by)
        .select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
        .withColumn("_rank", F.expr("(_total - 1) * prob"))
        .withColumn("_position", F.explode(F.expr("array_distinct(array(floor(_rank), ceil(_rank)))")))
        .withColumn("_before", F.expr("_upto - _n"))
        .filter("_before <= _position and _position < _upto")
        .select(*by, "prob", "_rank", "_position", "_before", "_n", "_lo", "_hi")
    )
    while not (large := wanted.filter(f"_n > {bound} and _lo < _hi")).isEmpty():
        # quarters where the difference of two values may be no double
        unit = "if(greatest(abs(_lo), abs(_hi)) > 1e300, 4, 1)"
        part = f"(_v / {unit} - _lo / {unit}) / (_hi / {unit} - _lo / {unit})"
        inner = _inside(rows, large, by).withColumn("_bucket", F.expr(f"cast(least(floor({part} * {buckets}), {buckets - 1}) as int)"))
        counts = _renamed(_counted(inner, [*by, "_before"]), by, "_upto", F.col("_before").alias("_outer"), *[
            F.col(c).alias(f"{c}_in") for c in ("_n", "_lo", "_hi")
        ])
        on = functools.reduce(operator.and_, [*_same(large, counts, by), large["_before"] == counts["_outer"]])
        divided = large.join(counts, on).filter("_position - _before < _upto and _position - _before >= _upto - _n_in").select(
            *by, "prob", "_rank", "_position", F.expr("_before + _upto - _n_in").alias("_before"),
            *[F.col(f"{c}_in").alias(c) for c in ("_n", "_lo", "_hi")],
        )
        wanted = cut_lineage(wanted.filter(f"_n <= {bound} or _lo = _hi").unionByName(divided))

    small = wanted.filter("_lo < _hi")
    order = Window.partitionBy(*by, "_before").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = _inside(rows, small, by).groupBy(*by, "_before", "_v").agg(F.count(F.lit(1)).alias("_n"))
    numbered = _renamed(
        values.withColumn("_last", F.sum("_n").over(order)), by,
        F.col("_before").alias("_outer"), "_v", "_last", F.col("_n").alias("_repeats"),
    )
    on = functools.reduce(operator.and_, [*_same(small, numbered, by), small["_before"] == numbered["_outer"]])
    picked = small.join(numbered, on).filter("_position - _before < _last and _position - _before >= _last - _repeats")
    single = wanted.filter("_lo = _hi").withColumn("_v", F.col("_lo"))
    columns = [*by, "prob", "_rank", "_position", "_v"]
    return (
        picked.select(*columns).unionByName(single.select(*columns))
        .groupBy(*by, "prob")
        .agg(
            F.expr("max(if(_position = floor(_rank), _v, null))").alias("_low"),
            F.expr("max(if(_position = ceil(_rank), _v, null))").alias("_high"),
            F.expr("max(_rank - floor(_rank))").alias("_part"),
        )
        .select(*by, "prob", F.expr("if(_low = _high, _low, _low + _part * (_high - _low))").alias("quantile"))
    )
