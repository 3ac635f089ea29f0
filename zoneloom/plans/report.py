"""The ordinal model report, and the published result tables of a study."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneloom.operators.ordinal import (
    coefficient_table, counterfactual_mean, fit_ordinal, interval_table, simulate_draws,
)
from zoneloom.plans.inputs import GRADES
from zoneloom.plans.study import AREA, ENTITY, GRADE, MAJORITY, ON, ZONE, ZoneStudy
from zoneloom.session import cut_lineage
from zoneloom.sources.publish import publish, read_published


def ordinal_report(
    rows: DataFrame, predictors: Sequence[str], effect: str, outcome: str = MAJORITY, levels: Sequence[str] = GRADES,
    n_draws: int = 1000, seed: int = 0,
) -> dict[str, DataFrame]:
    """Coefficients, mean top-level probability at ``effect`` 0 and 1, and simulated intervals for every level.

    ``rows`` is a study's model frame. Only rows complete in the outcome and all predictors are used throughout.
    """
    used = cut_lineage(rows.select(outcome, *predictors).dropna("any"))
    fit = fit_ordinal(used, outcome, predictors, levels)
    return {
        "coefficients": coefficient_table(rows.sparkSession, fit),
        "counterfactual": counterfactual_mean(used, predictors, fit.beta, fit.cuts[-1], effect, [0, 1]),
        "intervals": interval_table(simulate_draws(used, fit, effect, [0, 1], n_draws, seed)),
    }


def publish_results(study: ZoneStudy, root: str) -> list[str]:
    """Write the study's result tables below ``root``, each partitioned by city; returns their names."""
    study.write_stages()
    tables = {
        "fragments": study.fragments_with_majority(), "located": study.located,
        "zone_summary": study.zone_summary(), "map_layer": study.map_layer(), "entities_in_zones": study.located_in_classified(),
        "grade_share": study.grade_share(), "composition": study.compare_composition(), "rate": study.compare_rate(),
    }
    if study.spending is not None:
        tables["spending"] = study.compare_spending()
    for name, table in tables.items():
        publish(table, f"{root}/{name}", "city")
    return list(tables)


def published_drill_down(spark: SparkSession, root: str, city: str, zone_id: int) -> DataFrame:
    """One zone's rows from the published tables: its fragments, its majority, and the entities in each fragment.

    Of either table only the city's folder is read, of it only the zone's rows; nothing is overlaid or located anew.
    """
    key = [*ON, ZONE, AREA]
    fragments, located = (read_published(spark, f"{root}/{n}", "city", city).filter(F.col(ZONE) == zone_id) for n in ("fragments", "located"))
    return fragments.select(*key, "area", GRADE, MAJORITY).join(located.select(*key, ENTITY), key, "left")
