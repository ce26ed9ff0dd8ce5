"""Streaming jobs give the batch results, across several micro-batches."""

import datetime as dt
import time

from pyspark.sql import functions as F

from ledgerline import schemas, session
from ledgerline.session import scratch_path
from ledgerline.sinks import epochs
from ledgerline.streaming import jobs

from conftest import rows

T0 = dt.datetime(2024, 1, 1)


def _land(df, path):
    df.coalesce(1).write.mode("overwrite").parquet(path)
    time.sleep(1.1)  # distinct modification times keep the landing order


def _finish(q):
    q.awaitTermination()
    assert q.exception() is None
    return [p["batchId"] for p in q.recentProgress if p["numInputRows"] > 0]


def test_last_seen_stream(spark):
    root = scratch_path(spark, "t-last-seen")
    schema = "user_id long, ts timestamp_ntz"
    _land(spark.createDataFrame([(1, T0), (2, T0)], schema), f"{root}/in/a")
    _land(spark.createDataFrame([(1, T0 + dt.timedelta(hours=2)), (3, T0)], schema), f"{root}/in/b")
    src = jobs.file_stream(spark, f"{root}/in/*", spark.createDataFrame([], schema).schema,
                           max_files_per_trigger=1)
    epochs = _finish(jobs.start_last_seen(src, f"{root}/t", f"{root}/ck"))
    assert len(epochs) == 2
    assert rows(jobs.read_last_seen(spark, f"{root}/t")) == [
        (1, T0 + dt.timedelta(hours=2)), (2, T0), (3, T0)]


def test_monthly_hours_stream_counts_late_entries(spark):
    root = scratch_path(spark, "t-hours")
    hdr = "Date,Project,User,Activity,Issue,Comment,Hours\n"
    import os
    from ledgerline.session import local_path
    os.makedirs(local_path(f"{root}/in"), exist_ok=True)
    for name, body in [("a.csv", "1/5/2020,A,u,x,,,2\n2/1/2020,A,u,x,,,0\n"),
                       ("b.csv", "1/30/2020,A,u,x,,,3\n")]:  # late entry for January
        with open(local_path(f"{root}/in/{name}"), "w") as f:
            f.write(hdr + body)
        time.sleep(1.1)
    src = jobs.file_stream(spark, f"{root}/in", schemas.TIME_ENTRY_CSV, fmt="csv",
                           max_files_per_trigger=1, header=True)
    epochs = _finish(jobs.start_monthly_hours(src, f"{root}/t", f"{root}/ck"))
    assert len(epochs) == 2
    assert rows(jobs.read_monthly_hours(spark, f"{root}/t")) == [(2020, 1, "A", "u", 5.0)]
    spent = jobs.read_spent_time(spark, f"{root}/t", "x").collect()
    assert [(r.dedication, r.total_hours) for r in spent] == [(5.0 / 140, 5.0)]


def test_streaming_upsert_equals_one_batch(spark):
    root = scratch_path(spark, "t-upsert")
    base = spark.createDataFrame([(1, "k", "P", "", 1, 2024, 0.2), (2, "z", "P", "", 5, 2024, 0.9)],
                                 schemas.FORECAST)
    base.write.parquet(f"{root}/initial")
    jobs.land_state(base, f"{root}/state")
    b1 = [(1, "k", "P", "1", "2024", "0.5", "r1"), (3, "n", "P", "1", "2024", "0.1", "")]
    b2 = [(2, "k", "P", "1", "2024", "0.7", "r2"), (4, "n", "P", "1", "2024", "0.1", ""),
          (5, "", "P", "1", "2024", "0.3", "")]  # invalid: quarantined
    _land(spark.createDataFrame(b1, schemas.PLAN_BATCH), f"{root}/in/a")
    _land(spark.createDataFrame(b2, schemas.PLAN_BATCH), f"{root}/in/b")
    src = jobs.file_stream(spark, f"{root}/in/*", schemas.PLAN_BATCH, max_files_per_trigger=1)
    epochs = _finish(jobs.start_forecast_upsert(src, f"{root}/initial", f"{root}/state", f"{root}/out",
                                                f"{root}/ck", "me"))
    assert len(epochs) == 2
    state = rows(jobs.read_upsert_state(spark, f"{root}/state").select("id", "employee", "dedication"))
    assert state == [(1, "k", 0.7), (2, "z", 0.9), (5, "n", 0.1)]  # new id = max initial id (2) + first seq (3)
    log = sorted((r.seq, r.action, r.dedication_old, r.dedication_new)
                 for r in jobs.read_upsert_log(spark, f"{root}/out").collect())
    assert log == [(1, "update", 0.2, 0.5), (2, "update", 0.5, 0.7), (3, "add", 0.0, 0.1),
                   (4, "update", 0.1, 0.1)]
    assert spark.read.parquet(f"{root}/out/quarantine").count() == 1
    # the untouched partition (month 5) was never rewritten
    import glob
    from ledgerline.session import local_path
    files5 = glob.glob(local_path(f"{root}/state/year=2024/month=5/*.parquet"))
    assert len(files5) == 1


def test_replayed_epoch_only_republishes(spark):
    """A micro-batch replayed after its stage completed must not re-apply."""
    root = scratch_path(spark, "t-replay")
    base = spark.createDataFrame([(1, "k", "P", "", 1, 2024, 0.2)], schemas.FORECAST)
    base.write.parquet(f"{root}/initial")
    jobs.land_state(base, f"{root}/state")
    _land(spark.createDataFrame([(1, "k", "P", "1", "2024", "0.5", "")], schemas.PLAN_BATCH), f"{root}/in/a")
    src = jobs.file_stream(spark, f"{root}/in/*", schemas.PLAN_BATCH)
    _finish(jobs.start_forecast_upsert(src, f"{root}/initial", f"{root}/state", f"{root}/out", f"{root}/ck", "me"))
    # simulate the replay: drop the commit of batch 0 so the source re-delivers it
    from ledgerline.session import local_path
    import os
    for name in ("0", ".0.crc"):
        if os.path.exists(local_path(f"{root}/ck/commits/{name}")):
            os.remove(local_path(f"{root}/ck/commits/{name}"))
    src2 = jobs.file_stream(spark, f"{root}/in/*", schemas.PLAN_BATCH)
    _finish(jobs.start_forecast_upsert(src2, f"{root}/initial", f"{root}/state", f"{root}/out",
                                       f"{root}/ck", "me"))
    assert os.path.exists(local_path(f"{root}/ck/commits/0"))  # batch 0 ran again
    log = [(r.action, r.dedication_old, r.dedication_new) for r in jobs.read_upsert_log(spark, f"{root}/out").collect()]
    assert log == [("update", 0.2, 0.5)]


def test_files_numbered_alike_and_sharing_keys_equal_a_replay(spark):
    """Each file counts from 1; keys come back in later files; the first state is empty."""
    root = scratch_path(spark, "t-files")
    spark.createDataFrame([], schemas.FORECAST).write.parquet(f"{root}/initial")
    jobs.land_state(spark.createDataFrame([], schemas.FORECAST), f"{root}/state")
    batches = [[(1, "a", "P", "1", "2024", "0.1", ""), (2, "c", "P", "2", "2024", "0.3", "")],
               [(1, "b", "P", "1", "2024", "0.2", "")],
               [(1, "a", "P", "1", "2024", "0.9", "r"), (2, "d", "P", "1", "2024", "0.4", ""), (3, "a", "P", "1", "2024", "0.8", "s")]]
    for i, batch in enumerate(batches):  # landed and processed one after the other
        _land(spark.createDataFrame(batch, schemas.PLAN_BATCH), f"{root}/in/f{i}")
        src = jobs.file_stream(spark, f"{root}/in/*", schemas.PLAN_BATCH, max_files_per_trigger=1)
        _finish(jobs.start_forecast_upsert(src, f"{root}/initial", f"{root}/state", f"{root}/out", f"{root}/ck", "me"))
    state, log = {}, []
    for batch in batches:
        for seq, e, p, m, y, v, r in batch:
            log.append((seq, e, "update" if e in state else "add", state.get(e, (0.0,))[0], float(v)))
            state[e] = (float(v), r)
    got = jobs.read_upsert_state(spark, f"{root}/state").collect()
    assert {r.employee: (r.dedication, r.remarks) for r in got} == state
    assert len(got) == len({r.id for r in got}) == 4
    assert sorted((r.seq, r.employee, r.action, r.dedication_old, r.dedication_new)
                  for r in jobs.read_upsert_log(spark, f"{root}/out").collect()) == sorted(log)


HEADER = "Date,Project,User,Activity,Issue,Comment,Hours\n"


def _land_text(root, name, body):
    import os
    from ledgerline.session import local_path
    os.makedirs(local_path(f"{root}/in"), exist_ok=True)
    with open(local_path(f"{root}/in/{name}"), "w") as f:
        f.write(HEADER + body)
    time.sleep(0.05)


def test_rows_that_do_not_parse_are_quarantined_by_the_stream(spark):
    root = scratch_path(spark, "t-bad-hours")
    _land_text(root, "a.csv", '1/5/2020,A,u,x,,"two\nlines, ""quoted""",2\n13/1/2020,A,u,x,,,1\n1/6/2020,A,u,x,,,2 h\n')
    _land_text(root, "b.csv", "1/7/2020,A,u,x,,too,many,4\n1/8/2020,A\n1/9/2020,A,u,x,,,\n1/9/2020,A,v,x,,,3\n")
    q = jobs.start_monthly_hours(jobs.time_entry_stream(spark, f"{root}/in", 1), f"{root}/t", f"{root}/ck")
    assert len(_finish(q)) == 2
    assert rows(jobs.read_monthly_hours(spark, f"{root}/t")) == [(2020, 1, "A", "u", 2.0), (2020, 1, "A", "v", 3.0)]
    bad = jobs.read_quarantine(spark, f"{root}/t")
    assert sorted(r.violations for r in bad.collect()) == ["date_invalid", "hours_invalid", "row_broken", "row_broken"]
    assert {r._corrupt_record for r in bad.filter("violations = 'row_broken'").collect()} == {"1/7/2020,A,u,x,,too,many,4", "1/8/2020,A"}
    clean = scratch_path(spark, "t-clean-hours")
    _land_text(clean, "a.csv", "1/5/2020,A,u,x,,,2\n")
    _finish(jobs.start_monthly_hours(jobs.time_entry_stream(spark, f"{clean}/in"), f"{clean}/t", f"{clean}/ck"))
    assert jobs.read_quarantine(spark, f"{clean}/t").count() == 0


def test_epochs_are_folded_and_replays_change_nothing(spark):
    from pyspark.sql import functions as F
    from ledgerline.sinks import epochs
    root = scratch_path(spark, "t-epochs")
    schema = spark.createDataFrame([], "k string, n double").schema
    table = epochs.EpochTable(spark, root, schema, ["k"], {"n": F.sum}, fold_every=3)
    batch = lambda e: spark.createDataFrame([("a", 1.0), (f"k{e}", float(e))], schema)
    assert table.read().count() == 0
    for e in range(11):
        table.write(batch(e), e)
        base, folders = table._folders()
        assert len(folders) <= 4 and len(epochs.folder_names(spark, f"{root}/delta")) <= 6 and len(epochs.folder_names(spark, f"{root}/base")) <= 2
        assert table._folders()[0] == base
    want = sorted([("a", 11.0)] + [(f"k{e}", float(e)) for e in range(11)])
    assert rows(table.read()) == want
    table.write(batch(10), 10)  # replayed after a failure
    table.write(batch(8), 8)    # already in a base
    assert rows(table.read()) == want
    # a base that was not finished is not read
    epochs.remove(spark, f"{root}/base/upto={table._folders()[0]}/_SUCCESS")
    assert rows(table.read()) == want


def test_a_sink_belongs_to_one_checkpoint(spark):
    import pytest
    from ledgerline.sinks import epochs
    root = scratch_path(spark, "t-claim")
    epochs.claim(spark, root, "c1")
    epochs.claim(spark, root, "c1")
    with pytest.raises(ValueError, match="belongs to the stream of c1"):
        epochs.claim(spark, root, "c2")


def test_files_of_one_micro_batch_are_replayed_as_they_landed(spark):
    root = scratch_path(spark, "t-files")
    base = spark.createDataFrame([(1, "k", "P", "", 1, 2024, 0.2)], schemas.FORECAST)
    base.write.parquet(f"{root}/initial")
    jobs.land_state(base, f"{root}/state")
    # the later file has the smaller name; both number their rows from 1
    _land(spark.createDataFrame([(1, "k", "P", "1", "2024", "0.5", "r1"), (2, "n", "P", "1", "2024", "0.1", "")], schemas.PLAN_BATCH), f"{root}/in/z")
    _land(spark.createDataFrame([(1, "k", "P", "1", "2024", "0.7", "r2"), (2, "m", "P", "1", "2024", "2", "")], schemas.PLAN_BATCH), f"{root}/in/b")
    src = jobs.plan_batch_stream(spark, f"{root}/in/*", max_files_per_trigger=5)
    assert len(_finish(jobs.start_forecast_upsert(src, f"{root}/initial", f"{root}/state", f"{root}/out", f"{root}/ck", "me"))) == 1
    assert rows(jobs.read_upsert_state(spark, f"{root}/state").select("id", "employee", "dedication")) == [(1, "k", 0.7), (3, "n", 0.1)]
    log = sorted((r.seq, r.employee, r.action, r.dedication_old, r.dedication_new) for r in jobs.read_upsert_log(spark, f"{root}/out").collect())
    assert log == [(1, "k", "update", 0.2, 0.5), (1, "k", "update", 0.5, 0.7), (2, "n", "add", 0.0, 0.1)]
    bad = spark.read.parquet(f"{root}/out/quarantine").collect()
    assert [(r.seq, r.violations) for r in bad] == [(2, "dedication_invalid")]


def test_a_larger_landing_has_larger_micro_batches(spark, tmp_path, monkeypatch):
    """The number of micro-batches does not grow with the landing; the hours are those of all files."""
    from ledgerline.plans import registry
    monkeypatch.setattr(registry, "STREAM_BYTES", 1)
    monkeypatch.setattr(registry, "STREAM_BATCHES", 3)
    data = [(f"1/{1 + i % 28}/2024", f"p{i % 3}", f"e{i % 4}", "", "", "", 1.5) for i in range(120)]
    export = spark.createDataFrame(data, "Date string, Project string, User string, Activity string, Issue string, Comment string, Hours double")
    registry._land_csv(export.repartition(12), f"{tmp_path}/landing")
    table = registry._run_hours(spark, str(tmp_path))
    assert len(list((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))) <= 4
    assert jobs.read_monthly_hours(spark, table).agg({"hours": "sum"}).first()[0] == 180.0


def test_a_larger_epoch_table_is_read_by_more_tasks(spark, tmp_path, monkeypatch):
    table = epochs.EpochTable(spark, str(tmp_path / "t"), "k string, n long", ["k"], {"n": F.sum})
    for epoch in (0, 1):
        table.write(spark.range(5000).selectExpr("if(id = 7, null, concat('key', id)) as k", "id as n").repartition(2), epoch)
    want = sorted(((None if i == 7 else f"key{i}", 2 * i) for i in range(5000)), key=str)
    n_bytes = sum(f.stat().st_size for f in (tmp_path / "t").rglob("*.parquet"))
    for tasks in (1, 40):
        monkeypatch.setattr(session, "TASK_BYTES", n_bytes // tasks, raising=False)
        got = table.read()
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert got.rdd.getNumPartitions() >= tasks
    table.fold(1)
    assert sorted(map(tuple, table.read().collect()), key=str) == want
