"""Share of each category within a unit, and the unit's majority category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def category_weight(df: DataFrame, unit: Sequence[str], category: str, weight: str) -> DataFrame:
    """Weight per unit and category. A missing category is a category of its own."""
    return df.groupBy(*unit, category).agg(F.sum(weight).alias(weight))


def category_share(weights: DataFrame, unit: Sequence[str], weight: str, share: str) -> DataFrame:
    """Each row's part of its unit's total. Rows must already be one per unit and category."""
    total = F.sum(weight).over(Window.partitionBy(*unit))
    return weights.withColumn(share, F.try_divide(F.col(weight), total))


def majority(
    shares: DataFrame, unit: Sequence[str], category: str, share: str, winner: str, threshold: float = 0.5
) -> DataFrame:
    """The category whose share is over the threshold, on every row of its unit; NULL if there is none."""
    over = F.when(F.col(share) > threshold, F.col(category))
    return shares.withColumn(winner, F.max(over).over(Window.partitionBy(*unit)))


def classify_majority(
    df: DataFrame, unit: Sequence[str], category: str, weight: str, threshold: float = 0.5,
    share: str = "share", winner: str = "majority",
) -> DataFrame:
    """One row per unit and category with weight, share and the unit's majority; units without one are dropped.

    Weights are summed before anything is shuffled by unit, so a unit with very many fragments stays small.
    """
    weights = category_weight(df, unit, category, weight)
    shares = category_share(weights, unit, weight, share)
    return majority(shares, unit, category, share, winner, threshold).dropna(subset=[winner])
