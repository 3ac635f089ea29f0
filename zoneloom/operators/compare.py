"""Comparison of overlapping groups of categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The two comparisons on offer, and the grades each group takes.
COMPARISONS = {
    "A vs D": {"A": ["A"], "D": ["D"]},
    "A/B vs C/D": {"A/B": ["A", "B"], "C/D": ["C", "D"]},
}


def group_membership(df: DataFrame, category: str, comparisons: Mapping[str, Mapping[str, Sequence[str]]] = COMPARISONS) -> DataFrame:
    """Each row once per group it belongs to, with ``comparison`` and ``grade_group``.

    The groups are a literal map from category to its memberships, so this is a projection, not a join.
    """
    memberships: dict[str, list[Column]] = {}
    for comparison, groups in comparisons.items():
        for group, categories in groups.items():
            for value in categories:
                member = F.struct(F.lit(comparison).alias("comparison"), F.lit(group).alias("grade_group"))
                memberships.setdefault(value, []).append(member)
    table = F.create_map(*[c for value, found in memberships.items() for c in (F.lit(value), F.array(*found))])
    return df.select("*", F.inline(F.try_element_at(table, F.col(category))))


def sums_by_zone(located: DataFrame, entities: DataFrame, on: Sequence[str], zone: str, entity: str, measures: Sequence[str]) -> DataFrame:
    """Sum and count of each entity measure per zone, over the (zone, area, entity) rows of ``located``."""
    return (
        located.select(*on, entity, zone)
        .join(entities.select(*on, entity, *measures), [*on, entity])
        .groupBy(*on, zone)
        .agg(*[f(m).alias(f"{m}_{tag}") for m in measures for tag, f in (("sum", F.sum), ("n", F.count))])
    )


def compare_groups(
    classified: DataFrame, zone_sums: DataFrame, on: Sequence[str], zone: str, grade_col: str, measures: Sequence[str],
    comparisons: Mapping[str, Mapping[str, Sequence[str]]] = COMPARISONS,
) -> DataFrame:
    """Mean of each measure per ``on``, comparison and group; a group with zones but no values has NULL means.

    The means are those over the rows of the zone-grade table joined to the entities, each entity once per grade
    row and fragment. Since that join only repeats a zone's entities, its sums are formed per zone beforehand and
    per grade afterwards; the repeated rows never exist and a crowded zone is one row.
    """
    totals = [f"{m}_{tag}" for m in measures for tag in ("sum", "n")]
    by_grade = (
        classified.select(*on, zone, F.col(grade_col).alias("_grade"))
        .join(zone_sums, [*on, zone], "left")
        .groupBy(*on, "_grade")
        .agg(*[F.sum(t).alias(t) for t in totals])
    )
    grouped = group_membership(by_grade, "_grade", comparisons).groupBy(*on, "comparison", "grade_group")
    return grouped.agg(*[F.try_divide(F.sum(f"{m}_sum"), F.sum(f"{m}_n")).alias(m) for m in measures])


def unpivot_measures(df: DataFrame, ids: Sequence[str], measures: Sequence[str], name: str, value: str = "value") -> DataFrame:
    """Wide measures as one row per measure."""
    return df.unpivot(list(ids), list(measures), name, value)


def pair_index(summary: DataFrame, by: Sequence[str], category: str, name: str = "paired") -> DataFrame:
    """Number the categories within each group of a summary table, so rows of one category share it."""
    return summary.withColumn(name, F.dense_rank().over(Window.partitionBy(*by).orderBy(category)))


def rank_by_mean(summary: DataFrame, by: Sequence[str], category: str, value: str, name: str = "rank") -> DataFrame:
    """Categories of a summary table ranked by their mean value, lowest first; equal means share a rank.

    Means are compared to ten digits of their own size, so that the order of summation cannot part equal ones.
    """
    means = summary.groupBy(*by, category).agg(F.avg(value).alias(value))
    size = F.expr(f"pow(10, floor(log10(nullif(abs(`{value}`), 0))))")
    shown = F.coalesce(F.round(F.col(value) / size, 9) * size, F.col(value))
    return means.withColumn(name, F.dense_rank().over(Window.partitionBy(*by).orderBy(shown)))


def in_order(df: DataFrame, column: str, domain: Sequence[str], *then: str) -> DataFrame:
    """Sort by the position of a value in a fixed domain."""
    return df.orderBy(F.array_position(F.array(*map(F.lit, domain)), F.col(column)), *then)


def sample_rows(df: DataFrame, id_column: str, n: int = 1, seed: int = 0) -> DataFrame:
    """A uniform sample of ``n`` rows that depends only on the seed and the ids; kept as a top-n, not a full sort."""
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))
    return df.orderBy(ticket, id_column).limit(n)
