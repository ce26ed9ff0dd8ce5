"""Deep pages against a sorted list, retention by dropped days, stored counts against recounts."""

import datetime as dt
import os
import random

import pytest

from ledgerline import schemas
from ledgerline.operators import changelog, seek, social
from ledgerline.plans import batch_jobs
from ledgerline.session import local_path, scratch_path
from ledgerline.sinks import writers

from conftest import rows

T0 = dt.datetime(1999, 12, 31, 23, 59, 59, 999_999)


def _listing(spark, n, spread):
    rng = random.Random(n)
    times = [T0 + dt.timedelta(microseconds=rng.randrange(spread)) for _ in range(max(1, n // 3))]
    data = [(i, None if rng.random() < 0.1 else rng.choice(times)) for i in rng.sample(range(-n, 3 * n), n)]
    df = spark.createDataFrame(data, "id bigint, timestamp timestamp_ntz").repartition(5)
    want = sorted(data, key=lambda r: (r[1] is not None, r[1] or T0, r[0]), reverse=True)
    return df, [i for i, _ in want]


@pytest.mark.parametrize("spread", [1, 5, 3 * 10 ** 15])
def test_any_page_equals_the_sorted_list(spark, monkeypatch, spread):
    monkeypatch.setattr(seek, "BINS", 50)
    monkeypatch.setattr(seek, "FEW", 12)
    df, want = _listing(spark, 400, spread)
    df = df.cache()
    for page in (1, 9, 36, 37, 40, 90):
        first = (max(page, 1) - 1) * 10
        assert [r.id for r in seek.seek_page(df, page, 10).collect()] == want[first:first + 10], page
    assert seek.seek_page(df.limit(0), 3, 10).count() == 0


def test_deep_pages_sort_few_rows(spark):
    df = spark.range(200_000).selectExpr("id", "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 5000) AS timestamp")
    got = [r.id for r in seek.page_newest_first(df, 1900, 50).collect()]
    order = sorted(range(200_000), key=lambda i: (i % 5000, i), reverse=True)
    assert got == order[1899 * 50:1900 * 50]
    low, high, before = seek._high(df, seek.micros(df.timestamp), lambda a, b: df.timestamp.between(seek._time(a), seek._time(b)), 0, 94_950)
    assert before <= 94_950 < before + seek.FEW
    assert seek.seek_page(df, 2, 10_000).count() == 100  # the size of a page is bounded


def test_microseconds_do_not_depend_on_the_zone(spark):
    times = [dt.datetime(1969, 12, 31, 23, 59, 59, 1), dt.datetime(2024, 10, 27, 2, 30, 0, 999_999), dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = [r[0] for r in df.select(seek.micros(df.t)).collect()]
            assert got == [(t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for t in times]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def _log(spark, times):
    base = [(i, "add", "a", "e", "P", 1, 2024, 0.0, 0.5, None, None, None, "", t) for i, t in enumerate(times)]
    return spark.createDataFrame(base, schemas.CHANGELOG)


def test_retention_drops_days_and_rewrites_one(spark):
    root = scratch_path(spark, "t-days")
    as_of = dt.datetime(2024, 3, 1, 12)
    cut = as_of - dt.timedelta(days=365)
    times = [cut + dt.timedelta(days=d, hours=h) for d in range(-5, 6) for h in (-3, 0, 3)] + [None, None]
    writers.write_day_log(_log(spark, times), root)
    folder = local_path(root)
    stamp = lambda: {f"{d}/{x}": os.stat(os.path.join(folder, d, x)).st_mtime_ns for d in os.listdir(folder) if d.startswith("day=") for x in os.listdir(os.path.join(folder, d))}
    before = stamp()
    want = rows(changelog.retention(_log(spark, times), as_of))
    dropped = batch_jobs.run_day_retention(spark, root, as_of)
    assert dropped == [(cut + dt.timedelta(days=d)).strftime("%Y-%m-%d") for d in range(-5, 0)]
    after = stamp()
    same = {k for k in after if before.get(k) == after[k]}
    assert {k.split("/")[0] for k in after if k not in same} == {f"day={cut:%Y-%m-%d}"}  # nothing else was written
    read = lambda: rows(writers.read_day_log(spark, root, schemas.CHANGELOG))
    assert read() == want and len(want) == 2 + 5 * 3 + 2
    assert batch_jobs.run_day_retention(spark, root, as_of) == [] and read() == want
    writers.write_day_log(_log(spark, [as_of]), root)
    assert len(read()) == len(want) + 1


def _recount(edges, posts):
    out = {}
    for u in posts:
        out.setdefault(u, [0, 0, 0])[0] += 1
    for a, b in edges:
        out.setdefault(b, [0, 0, 0])[1] += 1
        out.setdefault(a, [0, 0, 0])[2] += 1
    return {k: tuple(v) for k, v in out.items()}


def test_stored_counts_equal_a_recount(spark):
    rng = random.Random(6)
    table = batch_jobs.counts_table(spark, scratch_path(spark, "t-counts"))
    edge_frame = lambda e: spark.createDataFrame(sorted(e), "follower_id bigint, followed_id bigint")
    post_frame = lambda p: spark.createDataFrame([(u,) for u in p], "user_id bigint")
    edges, posts = set(), []
    for turn in range(3):
        requests = [(i, rng.randrange(6), rng.randrange(6), rng.choice(["follow", "follow", "unfollow"])) for i in range(15)]
        new_posts = [rng.randrange(6) for _ in range(rng.randrange(5))]
        asked = spark.createDataFrame(requests, "seq bigint, follower_id bigint, followed_id bigint, op string")
        delta = social.follow_deltas(edge_frame(edges), asked, post_frame(new_posts))
        now = {tuple(r) for r in social.apply_follow_requests(edge_frame(edges), asked).collect()}
        assert {k: v for k, *v in rows(delta) if any(v)} == {
            k: v for k, *v in rows(social.count_deltas(edge_frame(edges), edge_frame(now), post_frame(new_posts))) if any(v)}
        touched = {x for e in edges ^ now for x in e} | set(new_posts)
        assert {r.id for r in delta.collect()} == touched  # a batch writes what it touches
        table.write(delta, turn)
        edges, posts = now, posts + new_posts
        got = {k: tuple(v) for k, *v in rows(table.read()) if any(v)}
        assert got == _recount(edges, posts)
    table.write(delta, 2)  # replayed
    assert {k: tuple(v) for k, *v in rows(table.read()) if any(v)} == got
