"""Tracker rollup: zero / null hours, null keys, calendar months, CSV landing."""

import datetime as dt
import os
import tempfile

from ledgerline import schemas, session
from ledgerline.operators import timesheets
from ledgerline.plans import registry
from ledgerline.sources import files

from conftest import SF_SMALL, rows

D = dt.date


def _entries(spark):
    data = [(D(2020, 1, 2), "A", "u", 1.0), (D(2020, 1, 31), "A", "u", 2.0),
            (D(2020, 2, 1), "B", "u", 0.0), (D(2020, 2, 3), None, "u", 4.0),
            (D(2020, 2, 4), "C", "v", None)]
    return spark.createDataFrame(data, "date date, project string, employee string, hours double")


def test_monthly_rollup_null_and_zero_hours(spark):
    got = rows(timesheets.monthly_hours(timesheets.drop_zero_hours(_entries(spark))))
    assert got == [(2020, 1, "A", "u", 3.0), (2020, 2, "C", "v", 0.0)]


def test_spent_time_dedication_and_employee_total(spark):
    data = [(D(2021, 3, 1), "A", "u", 70.0), (D(2021, 3, 9), "B", "u", 35.0), (D(2021, 3, 9), "B", "w", 14.0)]
    te = spark.createDataFrame(data, "date date, project string, employee string, hours double")
    got = {(r.employee, r.project): (r.dedication, r.total_hours, r.remarks)
           for r in timesheets.spent_time(te, "01/01/2024 01:05:00").collect()}
    assert got[("u", "A")][:2] == (0.5, 105.0)
    assert got[("u", "B")][:2] == (0.25, 105.0)
    assert got[("w", "B")][:2] == (0.1, 14.0)
    assert got[("u", "A")][2].endswith("01/01/2024 01:05:00")


def test_csv_reader_parses_single_digit_dates(spark):
    d = tempfile.mkdtemp(prefix="ll-csv-")
    with open(os.path.join(d, "entries.csv"), "w") as f:
        f.write("Date,Project,User,Activity,Issue,Comment,Hours\n")
        f.write("1/2/2020,A,u,Dev,,,1.5\n12/31/2020,B,u,Dev,7,note,2\nnot-a-date,C,u,Dev,,,1\n")
    good, bad = files.read_time_entry_csv(spark, d)
    got = rows(good)
    assert (D(2020, 1, 2), "A", "u", 1.5) in got and (D(2020, 12, 31), "B", "u", 2.0) in got
    # the bad-date row is set aside with its reason, not lost
    assert rows(bad.select("Date", "Project", "violations")) == [("not-a-date", "C", "date_invalid")]
    assert len(got) == 2 and timesheets.monthly_hours(good).count() == 2


def test_bad_hours_are_quarantined_not_counted_as_zero(spark):
    raw = spark.createDataFrame([("31/31/2020", "A", "u", None, None, None, "5"), ("1/2/2020", "A", "u", None, None, None, "5 h"),
                                 ("1/2/2020", "A", "u", None, None, None, "2"), ("1/3/2020", "A", "u", None, None, None, None)],
                                schemas.TIME_ENTRY_CSV)
    assert rows(files.parse_time_entries(raw).select("date", "hours"), order=True) == [(D(2020, 1, 2), 2.0), (D(2020, 1, 3), None)]
    assert sorted(r.violations for r in files.bad_time_entries(raw).collect()) == ["date_invalid", "hours_invalid"]
    assert timesheets.monthly_hours(files.parse_time_entries(raw)).first().hours == 2.0


def test_entries_slice_takes_each_bound_alone_and_cuts_only_on_request(spark):
    rows_ = [(D(2020, 1, 1) + __import__("datetime").timedelta(days=i % 300), "A", "u", 1.0) for i in range(500)]
    te = spark.createDataFrame(rows_, "date date, project string, employee string, hours double")
    late = sum(r[0] >= D(2020, 6, 1) for r in rows_)
    assert timesheets.entries_slice(te, "u", from_date="2020-06-01").count() == late
    assert timesheets.entries_slice(te, "u", to_date="2020-05-31").count() == 500 - late
    assert timesheets.entries_slice(te, "u", "A").count() == 500
    assert timesheets.entries_slice(te, "u", "A", limit=100).count() == 100


def test_entries_slice_honours_every_filter(spark):
    te = _entries(spark)
    assert timesheets.entries_slice(te, "u", "A", "2020-01-01", "2020-01-31").count() == 2
    assert timesheets.entries_slice(te, "u", None, "2020-02-01", "2020-02-28").count() == 2
    assert timesheets.entries_slice(te, "u", "A").count() == 2


def test_entries_dealt_into_tasks_give_the_same_hours(spark):
    data = [(D(2020, 1 + i % 3, 2), p, e, h) for i in range(40) for p, e, h in (("A", "u", 1.5), ("B", "u", None), (None, "v", 2.0), ("A", "w", 0.0))]
    te = spark.createDataFrame(data + data[:7] + [(None, "A", "u", 8.0)], "date date, project string, employee string, hours double")
    want = rows(timesheets.spent_time(te, "x"))
    for tasks in (1, 5, 30):
        assert rows(timesheets.spent_time(te, "x", tasks=tasks)) == want and len(want) == 6
        hours = timesheets.monthly_hours(te, tasks)
        assert hours.rdd.getNumPartitions() == tasks and rows(hours) == rows(timesheets.monthly_hours(te))


def test_a_larger_table_of_entries_is_added_up_by_more_tasks(spark, monkeypatch):
    """A task's groups are a share of fixed size of the table, not all of a scan split or coalesced partition."""
    stored = os.path.getsize(f"{SF_SMALL}/lineitem.parquet")
    monkeypatch.setattr(session, "TASK_BYTES", stored // 20, raising=False)
    for name in ("monthly_hours", "employee_chart_series"):
        parts = registry.registry()[name](spark, SF_SMALL).rdd.glom().map(len).collect()
        assert sum(n > 0 for n in parts) >= 20 and max(parts) < sum(parts) / 4
