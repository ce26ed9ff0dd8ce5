"""Page envelope edge cases and single-chart filters."""

from ledgerline import schemas
from ledgerline.operators import compare, paging


def _users(spark, n):
    return spark.createDataFrame([(i, f"u{i}", 0, None) for i in range(1, n + 1)], schemas.USERS)


def test_envelope_regular_page(spark):
    (e,) = paging.page_envelope(_users(spark, 25), ["id"], 2, 10).collect()
    assert (e.page, e.per_page, e.total_items, e.total_pages, e.has_next, e.has_prev) == (2, 10, 25, 3, True, True)
    assert (e.n_items, e.first_id, e.last_id) == (10, 11, 20)


def test_envelope_page_below_one_serves_first_page_but_echoes_request(spark):
    (e,) = paging.page_envelope(_users(spark, 25), ["id"], 0, 10).collect()
    assert (e.page, e.has_prev, e.first_id, e.last_id) == (0, False, 1, 10)


def test_envelope_caps_per_page_at_100(spark):
    (e,) = paging.page_envelope(_users(spark, 150), ["id"], 1, 500).collect()
    assert (e.per_page, e.total_pages, e.n_items, e.has_next) == (100, 2, 100, True)


def test_envelope_empty_table(spark):
    (e,) = paging.page_envelope(_users(spark, 0), ["id"], 1, 10).collect()
    assert (e.total_items, e.total_pages, e.n_items, e.has_next, e.first_id) == (0, 0, 0, False, None)


def test_chart_for_unknown_item_is_empty(spark):
    fc = spark.createDataFrame([(1, "e", "P", "", 1, 2024, 0.5)], schemas.FORECAST)
    spent = spark.createDataFrame([("e", "P", "", 1, 2024, 0.25, 35.0)], schemas.SPENT_TIME)
    series = compare.project_chart_series(compare.stacked_cells(fc, spent))
    assert compare.chart_for(series, 2024, project="nope").count() == 0
    got = sorted((r.stack, r.value) for r in compare.chart_for(series, 2024, project="P").collect())
    assert got == [("Forecast", 0.5), ("Spent Time", 0.25)]
    (j,) = compare.series_json(series, ["year", "project"]).filter("stack = 'Forecast'").collect()
    assert j.json == '{"name":"e","stack":"Forecast","data":[[1.0,0.5]]}'
