"""The composite queries: classified zones, entities located in them, and comparisons between grade groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneloom.functions.scalars import flag_over, matches_any, ordinal, percent_of, relabel, to_id
from zoneloom.operators.boundary import dissolve_edges, fragment_edges
from zoneloom.operators.classify import classify_majority
from zoneloom.operators.compare import compare_groups, pair_index, sample_rows, sums_by_zone, unpivot_measures
from zoneloom.operators.grid import outlines
from zoneloom.operators.locate import points_in_fragments, points_in_polygons
from zoneloom.operators.overlay import overlay_area
from zoneloom.plans.inputs import CATEGORY_LABELS, DESCRIPTION_TERMS, GRADES
from zoneloom.session import cut_lineage

ON, ZONE, AREA, ENTITY, GRADE, MAJORITY = ["city"], "zone_id", "area_id", "entity_id", "grade", "majority_grade"


@dataclass
class ZoneStudy:
    """Inputs, all keyed by ``city``.

    zone_edges / area_edges: normalised edge tables with ``zone_id`` / ``area_id``, in one planar system.
    areas: ``(city, area_id, grade)``. entities: ``(city, entity_id, x, y, ...)`` with text-typed counts.
    spending: ``(city, id, pp_total)``.

    ``grade_col`` is the column that puts a row into a comparison group: ``grade``, the grade of the zone's part,
    or ``majority_grade``, the grade of the whole zone.
    """

    zone_edges: DataFrame
    area_edges: DataFrame
    areas: DataFrame
    entities: DataFrame | None = None
    spending: DataFrame | None = None
    categories: Sequence[str] = field(default_factory=lambda: list(CATEGORY_LABELS))
    category_total: str = "TotalRaceEthnicity"
    labels: dict[str, str] = field(default_factory=lambda: dict(CATEGORY_LABELS))
    rate_part: str = "FreeandReducedLunchStudents"
    rate_total: str = "TotalStudentsAllGradesExcludesAE"
    grade_col: str = GRADE
    _written: bool = field(default=False, init=False, repr=False)

    # The outlines are read several times per query, so they are written on first use.

    @cached_property
    def zone_outlines(self) -> DataFrame:
        return cut_lineage(outlines(self.zone_edges, ON, ZONE))

    @cached_property
    def area_outlines(self) -> DataFrame:
        return cut_lineage(outlines(self.area_edges, ON, AREA))

    def write_stages(self) -> ZoneStudy:
        """Write the classified zones and located entities to the shared folder, once per study.

        Queries that read either of them more than once call this themselves; call it first to run many queries.
        """
        if not self._written:
            self.classified, self.located = cut_lineage(self.classified), cut_lineage(self.located)
            self._written = True
        return self

    def of_city(self, city: str | None) -> ZoneStudy:
        """The study with its inputs cut to one city; written stages are cut instead. ``None`` is the study itself."""
        if city is None:
            return self
        inputs = ("zone_edges", "area_edges", "areas", "entities", "spending")
        one = replace(self, **{n: self._in_city(getattr(self, n), city) for n in inputs if getattr(self, n) is not None})
        if self._written:
            one.classified, one.located = self._in_city(self.classified, city), self._in_city(self.located, city)
            one._written = True
        return one

    # Zones and their grades

    @cached_property
    def fragments(self) -> DataFrame:
        """``(city, zone_id, area_id, area)`` for every overlapping zone and area."""
        return overlay_area(
            self.zone_edges, self.area_edges, ON, ZONE, AREA,
            left_outlines=self.zone_outlines, right_outlines=self.area_outlines,
        )

    @cached_property
    def graded_fragments(self) -> DataFrame:
        return self.fragments.join(self.areas.select(*ON, AREA, GRADE), [*ON, AREA])

    @cached_property
    def fragment_edges(self) -> DataFrame:
        """Outlines of the fragments: an edge table keyed by ``city, zone_id, area_id``."""
        return cut_lineage(fragment_edges(self.zone_edges, self.area_edges, ON, ZONE, AREA))

    @cached_property
    def grade_edges(self) -> DataFrame:
        """Outlines of each zone's graded parts, fragments of one grade united: keyed by ``city, zone_id, grade``."""
        graded = self.areas.filter(F.col(GRADE).isNotNull()).select(*ON, AREA, GRADE)
        return dissolve_edges(self.fragment_edges.join(graded, [*ON, AREA]), [*ON, ZONE, GRADE], AREA)

    @cached_property
    def classified(self) -> DataFrame:
        """``(city, zone_id, grade, area, area_perc, majority_grade)``, only zones that have a majority."""
        return classify_majority(
            self.graded_fragments, [*ON, ZONE], GRADE, "area", share="area_perc", winner=MAJORITY
        )

    def fragments_with_majority(self) -> DataFrame:
        """Every fragment with its grade and its zone's majority, NULL where there is none."""
        majority = self.classified.select(*ON, ZONE, MAJORITY).distinct()
        return self.graded_fragments.join(majority, [*ON, ZONE], "left")

    def zone_summary(self, city: str | None = None) -> DataFrame:
        """Published table of classified zones, of one city or all."""
        return self.of_city(city).classified.withColumnRenamed(ZONE, "sab_id")

    def map_layer(self) -> DataFrame:
        """Classified zones with the majority as an ordinal, for colouring."""
        return self.classified.withColumn("majority_level", ordinal(MAJORITY, GRADES))

    def area_layer(self, city: str) -> DataFrame:
        """Grades and edges of a city's areas."""
        return self._in_city(self.areas.select(*ON, AREA, GRADE), city).join(self.area_edges, [*ON, AREA])

    # Entities in zones

    @cached_property
    def located(self) -> DataFrame:
        """``(city, entity_id, zone_id, area_id)``: an entity once per zone and area that both hold it."""
        in_zones = points_in_polygons(self.entities, self.zone_edges, ON, ENTITY, ZONE, polygon_outlines=self.zone_outlines)
        in_areas = points_in_polygons(self.entities, self.area_edges, ON, ENTITY, AREA, polygon_outlines=self.area_outlines)
        return points_in_fragments(in_zones, in_areas, ON, ENTITY)

    def combined(self, *attributes: str) -> DataFrame:
        """Classified zone-grade rows joined to the entities of their zone, with entity ``attributes``.

        Zones without entities keep their rows with NULLs. They are added by an anti join rather than a left join,
        because a crowded zone is on the right of that join and only an inner join may split it.
        """
        self.write_stages()
        rows = self.located
        if attributes:
            rows = rows.join(self.entities.select(*ON, ENTITY, *attributes), [*ON, ENTITY])
        filled = self.classified.join(rows, [*ON, ZONE])
        empty = self.classified.join(self.located.select(*ON, ZONE).distinct(), [*ON, ZONE], "left_anti")
        return filled.unionByName(empty, allowMissingColumns=True)

    def located_in_classified(self) -> DataFrame:
        """Located entities of the zones that have a majority."""
        return self.located.join(self.classified.select(*ON, ZONE).distinct(), [*ON, ZONE], "left_semi")

    def drill_down(self, city: str, zone_id: int) -> DataFrame:
        """One zone's rows: its fragments with grade, area, the zone's majority, and the entities in each."""
        chosen = (F.col("city") == city) & (F.col(ZONE) == zone_id)
        within = self.of_city(city)
        one = replace(within, zone_edges=within.zone_edges.filter(chosen))
        majority = one.classified.select(*ON, ZONE, MAJORITY).distinct()
        fragments = one.graded_fragments.join(majority, [*ON, ZONE], "left")
        return fragments.join(one.located, [*ON, ZONE, AREA], "left")

    def grade_share(self) -> DataFrame:
        """``(city, grade, percent)`` of the rows of the combined table, counted per zone before the join repeats them."""
        per_zone = self.located.groupBy(*ON, ZONE).agg(F.count(F.lit(1)).alias("n"))
        rows = self.classified.join(per_zone, [*ON, ZONE], "left")
        counts = rows.groupBy(*ON, GRADE).agg(F.expr("sum(coalesce(n, 1)) as n"))
        return counts.selectExpr(*ON, GRADE, "n", "n * 100 / sum(n) over (partition by city) as percent")

    # Comparisons between grade groups

    def _compare(self, entities: DataFrame, measures: Sequence[str], city: str | None, comparison: str | None) -> DataFrame:
        one = self.of_city(city)
        sums = sums_by_zone(one.located, self._in_city(entities, city), ON, ZONE, ENTITY, measures)
        result = compare_groups(one.classified, sums, ON, ZONE, self.grade_col, measures)
        return result if comparison is None else result.filter(F.col("comparison") == comparison)

    def compare_composition(self, city: str | None = None, comparison: str | None = None) -> DataFrame:
        """``(city, comparison, grade_group, category, value, paired)``: mean percentage of each category."""
        shares = self.entities.select(*ON, ENTITY, *[percent_of(c, self.category_total).alias(c) for c in self.categories])
        wide = self._compare(shares, self.categories, city, comparison)
        long = unpivot_measures(wide, [*ON, "comparison", "grade_group"], self.categories, "category")
        paired = pair_index(long, [*ON, "comparison", "grade_group"], "category")
        return paired.withColumn("category", relabel("category", self.labels))

    def compare_rate(self, city: str | None = None, comparison: str | None = None) -> DataFrame:
        """``(city, comparison, grade_group, rate)``: mean percentage of subsidised members."""
        rates = self.entities.select(*ON, ENTITY, percent_of(self.rate_part, self.rate_total).alias("rate"))
        return self._compare(rates, ["rate"], city, comparison)

    def compare_spending(self, city: str | None = None, comparison: str | None = None) -> DataFrame:
        """``(city, comparison, grade_group, pp_total)``: mean spending; entities without a figure are skipped."""
        return self._compare(self.entity_spending, ["pp_total"], city, comparison)

    @cached_property
    def entity_spending(self) -> DataFrame:
        """Entities left-joined to spending on the numeric form of their id."""
        keyed = self.entities.select(*ON, ENTITY, to_id(ENTITY).alias("id"))
        return keyed.join(self.spending.select(*ON, "id", "pp_total"), [*ON, "id"], "left").drop("id")

    def spend_join(self) -> DataFrame:
        """The combined table with each row's spending."""
        keyed = self.combined().withColumn("id", to_id(ENTITY))
        return keyed.join(self.spending.select(*ON, "id", "pp_total"), [*ON, "id"], "left")

    # Model rows

    def model_frame(self, flags: dict[str, str], required: Sequence[str] | None = None) -> DataFrame:
        """Majority level and one majority flag per category, on complete rows of the combined table.

        ``flags`` maps a flag name to the count column whose percentage of the category total is tested. Rows with
        a NULL in a ``required`` column (``None``: in any column of the entities) are dropped; text that is no number
        leaves a NULL flag, as the fit skips it.
        """
        asked = [c for c in self.entities.columns if c not in (*ON, ENTITY)] if required is None else required
        columns = sorted({*flags.values(), self.category_total, *asked})
        rows = self.combined(*columns).dropna("any")
        return rows.select(
            *ON, ZONE, ENTITY, MAJORITY, ordinal(MAJORITY, GRADES).alias("majority_level"),
            *[flag_over(percent_of(c, self.category_total), 50).alias(name) for name, c in flags.items()],
        )

    @staticmethod
    def _in_city(df: DataFrame, city: str | None) -> DataFrame:
        return df if city is None else df.filter(F.col("city") == city)


def search_descriptions(texts: DataFrame, text: str = "data", terms: Sequence[str] = DESCRIPTION_TERMS) -> DataFrame:
    """Rows whose text is there and matches one of the terms."""
    return texts.dropna(subset=[text]).filter(matches_any(text, terms))


def sample_description(texts: DataFrame, id_column: str, text: str = "data", terms: Sequence[str] = DESCRIPTION_TERMS, seed: int = 0) -> DataFrame:
    """One matching description at random."""
    return sample_rows(search_descriptions(texts, text, terms), id_column, 1, seed)
