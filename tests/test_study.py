import pytest

from tests.shapes import box, edges
from zoneloom.operators.classify import classify_majority
from zoneloom.operators.compare import compare_groups, group_membership, sums_by_zone
from zoneloom.plans.report import ordinal_report, publish_results
from zoneloom.plans.study import ZoneStudy, sample_description, search_descriptions
from zoneloom.session import scratch_path
from zoneloom.sources.publish import read_published


def test_majority_rules(spark):
    rows = [
        ("x", 1, "A", 6.0), ("x", 1, "B", 2.0), ("x", 1, "B", 2.0),  # A has 60 %
        ("x", 2, "A", 5.0), ("x", 2, "B", 5.0),                      # exactly half: no majority
        ("x", 3, "A", 4.0), ("x", 3, "B", 4.0), ("x", 3, "C", 3.0),  # no winner
        ("x", 4, "A", 4.0), ("x", 4, None, 5.0),                     # most is ungraded
        ("x", 5, "A", 6.0), ("x", 5, None, 4.0),                     # the ungraded part counts below
        ("y", 1, "D", 1.0),                                          # same id, other city
    ]
    df = spark.createDataFrame(rows, "city string, zone long, grade string, area double")
    got = classify_majority(df, ["city", "zone"], "grade", "area").collect()
    assert {(r.city, r.zone, r.grade): (r.share, r.majority) for r in got} == {
        ("x", 1, "A"): (0.6, "A"), ("x", 1, "B"): (0.4, "A"), ("x", 5, "A"): (0.6, "A"), ("x", 5, None): (0.4, "A"),
        ("y", 1, "D"): (1.0, "D"),
    }


def study(spark, **kwargs):
    """One city: zone 1 is mostly C with some A, zone 2 is A and holds no entity, zone 3 has no majority."""
    zones = [("x", 1, [[box(0, 0, 4, 1)]]), ("x", 2, [[box(10, 0, 11, 1)]]), ("x", 3, [[box(20, 0, 22, 1)]])]
    areas = [
        ("x", 1, [[box(0, 0, 1, 1)]]), ("x", 2, [[box(1, 0, 3, 1)]]), ("x", 3, [[box(10, 0, 12, 1)]]),
        ("x", 4, [[box(20, 0, 21, 1)]]), ("x", 5, [[box(21, 0, 22, 1)]]),
    ]
    grades = [("x", 1, "A"), ("x", 2, "C"), ("x", 3, "A"), ("x", 4, "A"), ("x", 5, "D")]
    entities = [
        ("x", "01", 0.5, 0.5, "30", "70", "100", "50"),   # in zone 1 on A land
        ("x", "02", 1.0, 0.5, "†", "10", "20", "20"),     # on the edge of two areas: twice
        ("x", "03", 3.5, 0.5, "1", "1", "2", "1"),        # in zone 1 on ungraded land: nowhere
        ("x", "04", 20.5, 0.5, "1", "1", "2", "1"),       # in the zone without a majority
        ("x", "05", 2.0, 0.5, "0", "0", "0", "0"),        # total is zero
    ]
    return ZoneStudy(
        zone_edges=edges(spark, zones, "zone_id"), area_edges=edges(spark, areas, "area_id"),
        areas=spark.createDataFrame(grades, "city string, area_id long, grade string"),
        entities=spark.createDataFrame(entities, "city string, entity_id string, x double, y double, p string, q string, total string, free string"),
        spending=spark.createDataFrame([("x", 1, 100.0), ("x", 2, 400.0), ("y", 5, 9.0)], "city string, id long, pp_total double"),
        categories=["p", "q"], category_total="total", labels={"p": "Pea", "q": "Queue"}, rate_part="free", rate_total="total", **kwargs,
    )


def test_combined_keeps_fan_out_and_empty_zones(spark):
    s = study(spark)
    rows = sorted(((r.zone_id, r.grade, r.majority_grade, r.entity_id or "", r.area_id or 0) for r in s.combined("p").collect()))
    inside = [("01", 1), ("02", 1), ("02", 2), ("05", 2)]
    assert rows == sorted([(1, g, "C", e, a) for g in "AC" for e, a in inside] + [(2, "A", "A", "", 0)])
    assert sorted((r.entity_id, r.zone_id) for r in s.located_in_classified().collect()) == [("01", 1), ("02", 1), ("02", 1), ("05", 1)]
    shares = {r.grade: (r.n, r.percent) for r in s.grade_share().collect()}
    assert shares == {"A": (5, pytest.approx(500 / 9)), "C": (4, pytest.approx(400 / 9))}
    spent = {(r.zone_id, r.grade, r.entity_id, r.area_id): r.pp_total for r in s.spend_join().collect()}
    assert spent[(1, "A", "01", 1)] == 100.0 and spent[(1, "C", "02", 2)] == 400.0 and spent[(1, "A", "05", 2)] is None
    assert len(spent) == 9


def test_comparisons_by_fragment_grade(spark):
    s = study(spark)
    rate = {(r.comparison, r.grade_group): r.rate for r in s.compare_rate().collect()}
    mean = (50 + 100 + 100) / 3
    assert rate == {("A vs D", "A"): pytest.approx(mean), ("A/B vs C/D", "A/B"): pytest.approx(mean), ("A/B vs C/D", "C/D"): pytest.approx(mean)}
    spent = {(r.comparison, r.grade_group): r.pp_total for r in s.compare_spending("x").collect()}
    assert spent[("A vs D", "A")] == pytest.approx((100 + 400 + 400) / 3)
    parts = {(r.grade_group, r.category): (r.value, r.paired) for r in s.compare_composition(comparison="A vs D").collect()}
    assert parts == {("A", "Pea"): (30.0, 1), ("A", "Queue"): (pytest.approx((70 + 50 + 50) / 3), 2)}
    assert s.compare_rate(city="nowhere").count() == 0


def test_comparisons_by_majority_leave_an_empty_group_null(spark):
    rate = {(r.comparison, r.grade_group): r.rate for r in study(spark, grade_col="majority_grade").compare_rate().collect()}
    assert rate[("A vs D", "A")] is None and rate[("A/B vs C/D", "C/D")] == pytest.approx(250 / 3)


def test_pre_aggregated_means_equal_means_over_joined_rows(spark):
    classified = spark.createDataFrame([("x", 1, "A"), ("x", 1, "B"), ("x", 2, "B"), ("x", 3, "D"), ("y", 1, "D")], "city string, zone long, grade string")
    located = spark.createDataFrame([("x", e, z, a) for e in range(20) for z in (1, 2) for a in range(e % 3)], "city string, e long, zone long, area long")
    entities = spark.createDataFrame([("x", e, None if e % 5 == 0 else float(e)) for e in range(20)], "city string, e long, m double")
    got = compare_groups(classified, sums_by_zone(located, entities, ["city"], "zone", "e", ["m"]), ["city"], "zone", "grade", ["m"])
    joined = group_membership(classified.join(located, ["city", "zone"], "left").join(entities, ["city", "e"], "left"), "grade")
    want = joined.groupBy("city", "comparison", "grade_group").avg("m")
    assert {tuple(r)[:3]: r[3] and round(r[3], 9) for r in got.collect()} == {tuple(r)[:3]: r[3] and round(r[3], 9) for r in want.collect()}


def test_drill_down_and_layers(spark):
    s = study(spark)
    rows = sorted((r.area_id, r.grade, r.area, r.majority_grade, r.entity_id or "") for r in s.drill_down("x", 1).collect())
    assert rows == [(1, "A", 1.0, "C", "01"), (1, "A", 1.0, "C", "02"), (2, "C", 2.0, "C", "02"), (2, "C", 2.0, "C", "05")]
    assert s.drill_down("x", 3).filter("majority_grade is null").count() == 2
    assert s.area_layer("x").count() == 20
    assert sorted((r.sab_id, r.grade) for r in s.zone_summary("x").collect()) == [(1, "A"), (1, "C"), (2, "A")]
    assert {(r.zone_id, r.majority_level) for r in s.map_layer().collect()} == {(1, 3), (2, 1)}


def test_model_frame_drops_missing_but_keeps_text_markers(spark):
    rows = study(spark).model_frame({"p_maj": "p", "q_maj": "q"}).collect()
    assert sorted({(r.entity_id, r.majority_level, r.p_maj, r.q_maj) for r in rows}, key=str) == [
        ("01", 3, 0, 1), ("02", 3, None, 0), ("05", 3, None, None),
    ]
    assert len(rows) == 8


def test_group_a_is_part_of_group_a_or_b(spark):
    df = group_membership(spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None), (5, "X")], "id long, grade string"), "grade")
    groups = {}
    for r in df.collect():
        groups.setdefault(r.grade_group, set()).add(r.id)
    assert groups == {"A": {1}, "A/B": {1, 2}, "C/D": {3}}


def test_description_search(spark):
    texts = spark.createDataFrame([(1, "Low grade homes"), (2, "slight infiltration"), (3, None), (4, "of low grade"), (5, "fine")], "id long, data string")
    assert sorted(r.id for r in search_descriptions(texts).collect()) == [2, 4]
    first = sample_description(texts, "id", seed=3).collect()
    assert len(first) == 1 and first[0].id in (2, 4) and sample_description(texts, "id", seed=3).collect() == first
    assert {sample_description(texts, "id", seed=i).first().id for i in range(12)} == {2, 4}


def test_report_and_published_tables(spark):
    s = study(spark)
    path = scratch_path(spark, "results")
    names = publish_results(s, path)
    assert set(names) == {"fragments", "located", "zone_summary", "map_layer", "entities_in_zones", "grade_share", "composition", "rate", "spending"}
    for name in names:
        assert read_published(spark, f"{path}/{name}", "city", "x").count() > 0
    rows = [("A", 0, 1), ("A", 1, 1), ("B", 0, 0), ("B", 1, 1), ("D", 1, 0), ("D", 0, 0), ("C", 1, 0), ("C", 0, 1), ("D", 1, 1), (None, 1, 1), ("A", None, 1)] * 4
    report = ordinal_report(spark.createDataFrame(rows, "majority_grade string, p_maj int, q_maj int"), ["p_maj", "q_maj"], "p_maj", n_draws=100)
    assert report["coefficients"].count() == 5 and report["counterfactual"].count() == 2 and report["intervals"].count() == 8


def test_drill_down_reads_one_folder(spark):
    from zoneloom.plans.report import published_drill_down

    s, path = study(spark), scratch_path(spark, "published")
    publish_results(s, path)
    publish_results(s, path)  # again: nothing doubles
    city, zone = s.classified.select("city", "zone_id").orderBy("city", "zone_id").first()
    found = published_drill_down(spark, path, city, zone)
    columns = ["area_id", "grade", "majority_grade", "entity_id"]
    assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, s.drill_down(city, zone).select(*columns).collect()))
    assert all(f"/city={city}/" in f for f in found.inputFiles()) or "PartitionFilters: [isnotnull(city" in found._jdf.queryExecution().toString()
