"""Batch jobs that land outputs on shared storage."""

import datetime as dt
import json
import os

import pytest

from ledgerline import schemas
from ledgerline.operators import catalog
from ledgerline.plans import batch_jobs
from ledgerline.session import local_path, scratch_path
from ledgerline.sinks import writers
from ledgerline.sources import files, fixtures as fx

from conftest import SF_SMALL, rows

RUN = dt.datetime(2024, 1, 1, 1, 5, 0)


def _write_text(path, text):
    os.makedirs(os.path.dirname(local_path(path)), exist_ok=True)
    with open(local_path(path), "w") as f:
        f.write(text)


def test_refresh_spent_time_from_csv(spark):
    root = scratch_path(spark, "t-refresh")
    _write_text(f"{root}/csv/e.csv", "Date,Project,User,Activity,Issue,Comment,Hours\n"
                "1/2/2020,A,u,x,,,70\n1/3/2020,B,u,x,,,70\n2/3/2021,A,v,x,,,0\n")
    snap = batch_jobs.refresh_spent_time(spark, f"{root}/csv", f"{root}/table", RUN)
    assert writers.current_snapshot(spark, f"{root}/table") == snap
    got = rows(spark.read.parquet(snap).select("year", "employee", "project", "dedication", "total_hours", "remarks"))
    assert got == [(2020, "u", "A", 0.5, 140.0, "Imported from time tracker at 01/01/2024 01:05:00"),
                   (2020, "u", "B", 0.5, 140.0, "Imported from time tracker at 01/01/2024 01:05:00")]


def test_apply_forecast_batch_quarantine_log_and_snapshot(spark):
    root = scratch_path(spark, "t-import")
    spark.createDataFrame([(1, "k", "P", "", 1, 2024, 0.2)], schemas.FORECAST).write.parquet(f"{root}/state0")
    _write_text(f"{root}/batch/b.csv", "seq,employee,project,month,year,dedication,remarks\n"
                "1,k,P,1,2024,0.5,\n2,,P,1,2024,0.5,\n3,n,P,1,2024,0.1,new\n")
    snap = batch_jobs.apply_forecast_batch(spark, f"{root}/state0", f"{root}/batch", f"{root}/out", "me", RUN)
    assert rows(spark.read.parquet(snap).select("id", "employee", "dedication", "remarks")) == [
        (1, "k", 0.5, ""), (4, "n", 0.1, "new")]
    log = spark.read.parquet(f"{root}/out/changelog")
    first = int(RUN.replace(tzinfo=dt.timezone.utc).timestamp()) * batch_jobs.RUN_SPAN
    want = [(first + 1, "update", 0.2, RUN), (first + 3, "add", 0.0, RUN)]
    assert rows(log.select("id", "action", "dedication_old", "timestamp")) == want
    assert spark.read.parquet(f"{root}/out/quarantine").count() == 1
    # a retried run leaves the same rows, the next one adds to them
    assert batch_jobs.apply_forecast_batch(spark, f"{root}/state0", f"{root}/batch", f"{root}/out", "me", RUN) == snap
    assert rows(spark.read.parquet(f"{root}/out/changelog").select("id", "action", "dedication_old", "timestamp")) == want
    assert spark.read.parquet(f"{root}/out/quarantine").count() == 1
    later = RUN + dt.timedelta(days=1)
    again = batch_jobs.apply_forecast_batch(spark, snap, f"{root}/batch", f"{root}/out", "me", later)
    log = spark.read.parquet(f"{root}/out/changelog")
    assert log.count() == log.select("id").distinct().count() == 4
    assert spark.read.parquet(again).count() == 2 and writers.current_snapshot(spark, f"{root}/out/forecast") == again


def test_apply_cost_batch_into_an_empty_table(spark):
    root = scratch_path(spark, "t-cost")
    spark.createDataFrame([], schemas.COST).write.parquet(f"{root}/state0")
    _write_text(f"{root}/batch/b.csv", "seq,concept,project,month,year,cost,remarks\n"
                "1,travel,P,1,2024,50,\n2,travel,P,1,2024,70,again\n3,other,P,1,2024,5,\n4,travel,P,x,2024,5,\n5,travel,Q,2,2024,9,\n")
    snap = batch_jobs.apply_cost_batch(spark, f"{root}/state0", f"{root}/batch", f"{root}/out", "me", RUN, ("travel",))
    assert rows(spark.read.parquet(snap).select("id", "project", "cost", "remarks")) == [(1, "P", 70, "again"), (5, "Q", 9, "")]
    log = spark.read.parquet(f"{root}/out/changelog")
    assert rows(log.select("action", "cost_old", "cost_new")) == [("add", 0, 9), ("add", 0, 50), ("update", 50, 70)]
    bad = spark.read.parquet(f"{root}/out/quarantine")
    assert rows(bad.select("seq", "violations")) == [(3, "concept_invalid"), (4, "month_invalid")]


def test_retention_snapshot(spark):
    root = scratch_path(spark, "t-retention")
    log = fx.changelog(spark, SF_SMALL)
    log.write.partitionBy("year").parquet(f"{root}/log")
    snap = batch_jobs.run_retention(spark, f"{root}/log", f"{root}/kept", dt.datetime(2001, 6, 30))
    kept = spark.read.parquet(snap)
    assert kept.count() == log.filter("timestamp >= timestamp_ntz'2000-06-30 00:00:00'").count()


def test_export_posts_by_user_oldest_first(spark):
    root = scratch_path(spark, "t-export")
    posts = fx.posts(spark, SF_SMALL)
    batch_jobs.export_all_posts(posts, f"{root}/posts")
    back = spark.read.json(f"{root}/posts")
    assert back.count() == posts.count()
    one = [r for r in back.collect() if r.user_id == 7]  # of one bucket, in file order
    stamps = [dt.datetime.fromisoformat(r.timestamp.rstrip("Z")) for r in one]
    assert len(one) > 1 and stamps == sorted(stamps) and all(r.timestamp.endswith("Z") for r in one)
    assert set(one[0].asDict()) == {"user_id", "body", "timestamp", "bucket"}
    assert len(os.listdir(local_path(f"{root}/posts"))) <= writers.POST_BUCKETS + 2


def test_profile_map_as_one_indented_object(spark):
    root = scratch_path(spark, "t-map")
    want = {"Ann \"A\" Lee": "x, y", "Bo": "", "Zoë": "p:{q}"}
    for name, text in (("indented", json.dumps(want, indent=4)), ("lines", "\n".join(json.dumps({k: v}) for k, v in want.items())),
                       ("one", json.dumps(want, ensure_ascii=False) + "\n"), ("empty", "{}"), ("blank", "{\n}\n")):
        _write_text(f"{root}/{name}/a.json", text)
        assert dict(rows(files.read_profile_map(spark, f"{root}/{name}"))) == ({} if name in ("empty", "blank") else want), name
    written = spark.createDataFrame(list(want.items()), "employee string, profile string")
    writers.write_profile_map(written, f"{root}/out")
    folder = local_path(f"{root}/out")
    text = "".join(open(f"{folder}/{f}").read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    assert json.loads(text) == want
    assert dict(rows(files.read_profile_map(spark, f"{root}/out"))) == want
    writers.write_profile_map(written.limit(0), f"{root}/none")
    assert files.read_profile_map(spark, f"{root}/none").count() == 0
    _write_text(f"{root}/bad/a.json", "{\n  \"a\": \n}")
    with pytest.raises(Exception, match="not an entry"):
        files.read_profile_map(spark, f"{root}/bad").collect()


def test_update_profile_map_round_trip(spark):
    root = scratch_path(spark, "t-profiles")
    _write_text(f"{root}/stored/a.json", json.dumps({"a": "X", "c": "Y"}) + "\n")
    _write_text(f"{root}/uploaded/b.json", json.dumps({"c": "Z"}) + "\n")
    active = spark.createDataFrame([("a",), ("b",)], "name string")
    batch_jobs.update_profile_map(spark, active, f"{root}/stored", f"{root}/uploaded", f"{root}/merged")
    assert rows(files.read_profile_map(spark, f"{root}/merged")) == [("a", "X"), ("b", ""), ("c", "Z")]


def test_export_reports_title_case_partitioned(spark):
    root = scratch_path(spark, "t-reports")
    d = SF_SMALL
    out = batch_jobs.export_reports(fx.forecast(spark, d), fx.cost(spark, d),
                                   batch_jobs.timesheets.spent_time(fx.time_entries(spark, d), "x"),
                                   fx.changelog(spark, d), root)
    df = spark.read.parquet(out["personnel_forecasts"])
    assert {"Employee", "Project", "M1", "year"} <= set(df.columns)
    assert df.select("year").distinct().count() == catalog.available_years(fx.forecast(spark, d)).count()


def test_export_profiles_partitioned_by_year(spark):
    root = scratch_path(spark, "t-profiles-export")
    d = SF_SMALL
    pm = fx.profile_map(spark, d)
    out = batch_jobs.export_profiles(fx.forecast(spark, d),
                                     batch_jobs.timesheets.spent_time(fx.time_entries(spark, d), "x"),
                                     fx.cost(spark, d), pm, root)
    assert set(out) == {"forecast_profile", "spent_time_profile", "costs"}
    fp = spark.read.parquet(out["forecast_profile"])
    assert {"project", "profile", "m1", "year"} <= set(fp.columns) and fp.count() > 0


def test_audits_of_one_moment_are_both_kept(spark):
    root = scratch_path(spark, "t-moment")
    spark.createDataFrame([], schemas.FORECAST).write.parquet(f"{root}/forecast0")
    spark.createDataFrame([], schemas.COST).write.parquet(f"{root}/cost0")
    _write_text(f"{root}/f/a.csv", "seq,employee,project,month,year,dedication,remarks\n1,e,P,1,2024,0.5,\n2,e,P,x,2024,0.5,\n")
    _write_text(f"{root}/f2/a.csv", "seq,employee,project,month,year,dedication,remarks\n1,g,P,1,2024,0.5,\n")
    _write_text(f"{root}/c/a.csv", "seq,concept,project,month,year,cost,remarks\n1,travel,P,1,2024,50,\n2,other,P,1,2024,1,\n")
    forecast = lambda batch: batch_jobs.apply_forecast_batch(spark, f"{root}/forecast0", f"{root}/{batch}", f"{root}/out", "me", RUN)
    forecast("f")
    batch_jobs.apply_cost_batch(spark, f"{root}/cost0", f"{root}/c", f"{root}/out", "me", RUN, ("travel",))
    forecast("f")  # a retry replaces its own rows
    log = spark.read.parquet(f"{root}/out/changelog")
    assert rows(log.select("employee", "concept", "action")) == [("e", None, "add"), (None, "travel", "add")]
    assert log.select("id").distinct().count() == 2
    assert rows(spark.read.parquet(f"{root}/out/quarantine").select("seq")) == [(2,), (2,)]
    with pytest.raises(ValueError, match="another forecast batch"):
        forecast("f2")


def test_export_rows_of_broken_structure(spark):
    root = scratch_path(spark, "t-structure")
    _write_text(f"{root}/a.csv", 'Date,Project,User,Activity,Issue,Comment,Hours\n1/5/2020,A,u,x,,"first\nsecond, ""third""",2\n'
                "1/6/2020,A,u,x,,one,two,7\n1/7/2020,A\n1/8/2020,A,v,x,,,3\n")
    good, bad = files.read_time_entry_csv(spark, root)
    assert rows(good.select("employee", "hours")) == [("u", 2.0), ("v", 3.0)]
    assert rows(bad.select("violations", "_corrupt_record")) == [("row_broken", "1/6/2020,A,u,x,,one,two,7"), ("row_broken", "1/7/2020,A")]
