"""The planning views have the sizes FIXTURES.md documents."""

import pytest

from ledgerline.operators import catalog, timesheets
from ledgerline.sources import fixtures as fx

EXPECTED = {  # view: (rows at sf0.001, rows at sf0.01)
    "time_entries": (6000, 60000),
    "forecast": (1500, 15000),
    "cost": (1500, 15000),
    "posts": (1000, 10000),
    "followers": (1444, 14511),
    "users": (150, 1500),
    "tracker_projects": (200, 2000),
    "tracker_users": (10, 100),
    "profile_map": (6, 66),
    "tasks": (199, 2017),
}


@pytest.mark.parametrize("sf,idx", [("/root/testdata/sf0.001", 0), ("/root/testdata/sf0.01", 1)])
def test_view_sizes(spark, sf, idx):
    for name, sizes in EXPECTED.items():
        assert getattr(fx, name)(spark, sf).count() == sizes[idx], name
    spent = timesheets.spent_time(fx.time_entries(spark, sf), "x")
    assert spent.count() == (4754, 47404)[idx]
    # the changelog holds a dedication row and a cost row per order
    assert fx.changelog(spark, sf).count() == 2 * (1500, 15000)[idx]


def test_open_projects_repeat_names(spark):
    open_rows = fx.tracker_projects(spark, "/root/testdata/sf0.01").filter("status <> 5")
    assert open_rows.count() == 1653
    assert catalog.open_projects(fx.tracker_projects(spark, "/root/testdata/sf0.01")).count() == 64
