"""Mean pivots, sums of means, bands, profile mapping (hand-made quirk cases)."""

from ledgerline import schemas
from ledgerline.operators import catalog, matrix, summary

from conftest import rows


def _plan(spark):
    data = [(1, "a", "P", "", 1, 2024, 0.2), (2, "a", "P", "", 1, 2024, 0.4),
            (3, "a", "P", "", 3, 2024, 0.5), (4, "b", "Q", "", 3, 2024, 1.0),
            (5, "c", "Q", "", 4, 2024, None)]
    return spark.createDataFrame(data, schemas.FORECAST)


def _months(r):
    return [round(r[f"m{m}"], 9) for m in range(1, 13)]


def test_mean_pivot_drops_null_values_and_averages_duplicates(spark):
    got = {(r.employee, r.project): _months(r) for r in matrix.dedication_matrix(_plan(spark)).collect()}
    assert set(got) == {("a", "P"), ("b", "Q")}
    assert got[("a", "P")][:3] == [0.3, 0.0, 0.5]
    assert got[("b", "Q")][2] == 1.0 and sum(got[("b", "Q")]) == 1.0


def test_summary_is_sum_of_means(spark):
    got = {r.project: r for r in summary.summary(_plan(spark), "project").collect()}
    assert round(got["P"].m1, 9) == 0.3 and round(got["P"].m3, 9) == 0.5
    assert round(got["P"].total, 9) == 0.8  # not 1.1


def test_summary_totals_agree_across_dimensions(spark):
    s = summary.summary_all_years(_plan(spark)).groupBy("dimension").sum("total").collect()
    totals = {r[0]: round(r[1], 9) for r in s}
    assert totals["project"] == totals["employee"] == 1.8


def test_cost_matrix_mean_and_total(spark):
    cost = spark.createDataFrame([(1, "T", "P", "", 1, 2024, 3), (2, "T", "P", "", 1, 2024, 4),
                                  (3, "M", "Q", "", 2, 2024, 5)], schemas.COST)
    got = {(r.project, r.concept): (r.m1, r.m2, r.total) for r in matrix.cost_matrix(cost).collect()}
    assert got == {("P", "T"): (3.5, 0.0, 3.5), ("Q", "M"): (0.0, 5.0, 5.0)}


def test_empty_input_gives_empty_frame_with_schema(spark):
    empty = spark.createDataFrame([], schemas.COST)
    m = matrix.cost_matrix(empty)
    assert m.count() == 0
    assert m.columns == ["year", "project", "concept"] + [f"m{i}" for i in range(1, 13)] + ["total"]


def test_load_bands(spark):
    vals = [0.0, 0.5, 0.51, 0.8, 0.81, 1.0, 1.01, 3.0, 3.01, None]
    df = spark.createDataFrame([(2024, "e", str(i), v) for i, v in enumerate(vals)],
                               "year int, employee string, cell string, value double")
    got = [r.band for r in summary.load_bands(df).orderBy(df.cell.cast("int")).collect()]
    assert got == ["low", "low", "light", "light", "none", "none", "over", "over", "none", "none"]


def test_profile_map_merge_last_wins(spark):
    active = spark.createDataFrame([("a",), ("b",)], "name string")
    stored = spark.createDataFrame([("a", "X"), ("c", "Y")], schemas.PROFILE_MAP)
    uploaded = spark.createDataFrame([("c", "Z")], schemas.PROFILE_MAP)
    assert rows(summary.merge_profile_maps(active, stored, uploaded)) == [("a", "X"), ("b", ""), ("c", "Z")]


def test_profile_fall_through_is_not_chained(spark):
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "employee string")
    pm = spark.createDataFrame([("a", "b"), ("b", "")], schemas.PROFILE_MAP)
    got = {r.employee: r.profile for r in summary.with_profile(cells, pm).collect()}
    assert got == {"a": "b", "b": "", "c": "c"}


def test_bar_fraction(spark):
    t = spark.createDataFrame([(2024, "x", 1.0), (2024, "y", 3.0), (2024, "z", 2.0), (2025, "w", 5.0)],
                              "year int, k string, total double")
    got = {r.k: r.bar_fraction for r in summary.total_bar_fraction(t).collect()}
    assert got == {"x": 0.0, "y": 1.0, "z": 0.5, "w": None}


def test_open_projects_last_name_wins_and_null_status_is_open(spark):
    p = spark.createDataFrame([(1, "alpha", 1), (2, "alpha", 0), (3, "beta", 5), (4, "gamma", None)],
                              schemas.TRACKER_DIM)
    assert rows(catalog.open_projects(p)) == [("alpha", 2), ("gamma", 4)]


def test_to_long_round_trip(spark):
    wide = matrix.dedication_matrix(_plan(spark))
    long = matrix.to_long(wide, ["year", "employee", "project"])
    assert long.count() == 2 * 12


def test_year_matrix_observed_only(spark):
    m = matrix.year_matrix(_plan(spark), ["employee", "project"], "dedication", 2024, observed_only=True)
    assert m.columns == ["year", "employee", "project", "m1", "m3"]  # month 4 only has a null value
    full = matrix.year_matrix(_plan(spark), ["employee", "project"], "dedication", 2024)
    assert len(full.columns) == 3 + 12
