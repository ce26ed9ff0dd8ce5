"""Reports against a single-process pandas computation on random data
(duplicates, nulls, sparse months), and hot-key behaviour."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import matrix, social, summary, timesheets, upsert


def _random_forecast(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        emp = rnd.choice(["a", "b", "c", "d", None])
        prj = rnd.choice(["P", "Q", "R"])
        ded = None if rnd.random() < 0.05 else rnd.randint(0, 120) / 100
        rows.append((i, emp, prj, "", rnd.randint(1, 12), rnd.choice([2021, 2022]), ded))
    return rows


def _pandas_matrix(rows, year):
    pdf = pd.DataFrame(rows, columns=[f.name for f in schemas.FORECAST.fields])
    pdf = pdf[pdf.year == year]
    return pdf.pivot_table(values="dedication", index=["employee", "project"], columns="month",
                           aggfunc="mean", fill_value=0)


def test_matrix_equals_pandas_pivot(spark):
    for seed in range(3):
        rows = _random_forecast(seed)
        got = matrix.dedication_matrix(spark.createDataFrame(rows, schemas.FORECAST)).collect()
        for year in (2021, 2022):
            exp = _pandas_matrix(rows, year)
            mine = {(r.employee, r.project): r for r in got if r.year == year}
            assert set(mine) == set(exp.index)
            for key, prow in exp.iterrows():
                for m in range(1, 13):
                    want = float(prow[m]) if m in exp.columns else 0.0
                    assert abs(mine[key][f"m{m}"] - want) < 1e-9


def test_summaries_equal_pandas_groupby_sum(spark):
    rows = _random_forecast(7)
    df = spark.createDataFrame(rows, schemas.FORECAST)
    for item in ("project", "employee"):
        got = {(r.year, r[item]): r for r in summary.summary(df, item).collect()}
        for year in (2021, 2022):
            table = _pandas_matrix(rows, year).reset_index()
            exp = table.drop(columns=["employee" if item == "project" else "project"]).groupby(item).sum()
            exp["TOTAL"] = exp.sum(axis=1)
            for key, prow in exp.iterrows():
                assert abs(got[(year, key)]["total"] - prow["TOTAL"]) < 1e-9
                for m in exp.columns.drop("TOTAL"):
                    assert abs(got[(year, key)][f"m{m}"] - prow[m]) < 1e-9


def test_spent_time_equals_pandas_monthly_grouper(spark):
    rnd = random.Random(3)
    recs = []
    for _ in range(500):
        d = dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 500))
        h = rnd.choice([0.0, 0.5, 1.0, 2.0, 7.5, None])
        recs.append((d, rnd.choice(["A", "B", "C"]), rnd.choice(["u", "v", "w"]), h))
    te = spark.createDataFrame(recs, "date date, project string, employee string, hours double")
    got = {(r.year, r.month, r.project, r.employee): (r.dedication, r.total_hours)
           for r in timesheets.spent_time(te, "x").collect()}
    pdf = pd.DataFrame(recs, columns=["Date", "Project", "User", "Hours"])
    pdf = pdf[pdf["Hours"] != 0]
    pdf["Date"] = pd.to_datetime(pdf["Date"])
    g = pdf.set_index("Date").groupby([pd.Grouper(freq="ME"), "Project", "User"]).sum().reset_index()
    g["year"], g["month"] = g["Date"].dt.year, g["Date"].dt.month
    g["total"] = g.groupby(["year", "month", "User"])["Hours"].transform("sum")
    exp = {(r.year, r.month, r.Project, r.User): (r.Hours / 140.0, r.total) for r in g.itertuples()}
    # pandas' monthly grouper also emits empty months between observed ones (all zero)
    exp = {k: v for k, v in exp.items() if k in got or v != (0.0, 0.0)}
    assert set(got) <= set(exp)
    for k, (ded, tot) in exp.items():
        if k in got:
            assert abs(got[k][0] - ded) < 1e-12 and abs(got[k][1] - tot) < 1e-9


def test_hot_key_spreads_over_tasks(spark):
    """A key holding most of the batch is split by seq bucket across tasks."""
    n = 4000
    batch = spark.createDataFrame(
        [(s, "hot" if s % 3 else f"e{s}", "P", "", 1, 2024, 0.1) for s in range(n)],
        "seq long, employee string, project string, remarks string, month int, year int, dedication double")
    seqd = upsert.sequence_within_key(batch, ["employee", "project", "month", "year"], "dedication",
                                      bucket_width=64)
    hot = seqd.filter(F.col("employee") == "hot")
    # observe the shuffle layout itself: AQE would merge this tiny shuffle
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        per_task = [r[1] for r in hot.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(key, old)
    assert len(per_task) > 1 and max(per_task) < 0.5 * sum(per_task)
    ranks = sorted(r._rn for r in hot.select("_rn").collect())
    assert ranks == list(range(1, len(ranks) + 1))


def test_celebrity_feed_page_matches_brute_force(spark):
    """Everyone follows user 0 (a third of all edges point to one user)."""
    t0 = dt.datetime(2024, 1, 1)
    posts = [(i, f"p{i}", t0 + dt.timedelta(minutes=i * 7 % 97), i % 5, "") for i in range(200)]
    edges = [(v, 0) for v in range(1, 40)] + [(v, (v % 4) + 1) for v in range(1, 40)] + \
            [(v, (v % 3) + 2) for v in range(1, 40)]
    pdf, edf = spark.createDataFrame(posts, schemas.POSTS), spark.createDataFrame(edges, schemas.FOLLOWERS)
    got = sorted((r.viewer_id, r.rank, r.id) for r in social.feed_page(pdf, edf, 2, 10).collect())
    by_user = {}
    for p in posts:
        by_user.setdefault(p[3], []).append(p)
    exp = []
    for v in range(0, 40):
        followed = {b for a, b in edges if a == v and b != v} | {v}
        feed = sorted((p for u in followed for p in by_user.get(u, [])), key=lambda p: (p[2], p[0]),
                      reverse=True)
        exp += [(v, i + 11, p[0]) for i, p in enumerate(feed[10:20])]
    assert got == sorted(exp)
