"""Audit log: retention, sentences, newest rows; validation and uniqueness."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import changelog as chg
from ledgerline.operators import quality

from conftest import rows

AS_OF = dt.datetime(2024, 6, 30, 12, 0, 0)


def _log(spark, data):
    return spark.createDataFrame(data, schemas.CHANGELOG)


def _row(i, ts, **kw):
    base = dict(id=i, action="update", author="ann", employee="e", project="P", month=3, year=2024,
                dedication_old=0.25, dedication_new=0.5, concept=None, cost_old=None, cost_new=None,
                remarks="", timestamp=ts)
    base.update(kw)
    return tuple(base[f.name] for f in schemas.CHANGELOG.fields)


def test_retention_strictly_older_removed_null_kept(spark):
    d = lambda n: AS_OF - dt.timedelta(days=n)
    log = _log(spark, [_row(1, d(364)), _row(2, d(365)), _row(3, d(366)), _row(4, None)])
    assert sorted(r.id for r in chg.retention(log, AS_OF).collect()) == [1, 2, 4]


def test_sentences_both_branches(spark):
    log = _log(spark, [
        _row(1, AS_OF, remarks="more work"),
        _row(2, AS_OF, employee=None, concept="Travel", cost_old=0, cost_new=120, dedication_old=None,
             dedication_new=None),
        _row(3, AS_OF, dedication_old=0.285, dedication_new=0.125)])
    got = {r.id: r.sentence for r in chg.sentences(log).collect()}
    assert got[1] == "ann changed the dedication of e in P - 3/2024 from 25% to 50%. Motivation: more work"
    assert got[2] == "ann changed the cost of Travel in P - 3/2024 from 0€ to 120€."
    assert got[3].endswith("from 28% to 12%.")  # round half to even, like the template
    assert [r.id for r in chg.text_filter(chg.sentences(log), "TRAVEL").collect()] == [2]


def test_top_n_per_year_tie_break_by_id(spark):
    t = dt.datetime(2024, 1, 1)
    log = _log(spark, [_row(i, t, year=2024) for i in range(1, 6)] + [_row(9, t, year=2023)])
    got = rows(chg.top_n_per_year(log, 2).select("year", "id"))
    assert got == [(2023, 9), (2024, 4), (2024, 5)]


def test_plan_batch_validation_quarantines(spark):
    b = spark.createDataFrame([(1, "e", "P", "3", "2024", "0.5", ""), (2, "", "P", "13", "2024", "x", ""),
                               (3, "e", " ", "1", "1999", "1.5", "")], schemas.PLAN_BATCH)
    v = {r.seq: r.violations for r in quality.validate_plan_batch(b).collect()}
    assert v == {1: "", 2: "employee_required,month_invalid,dedication_invalid",
                 3: "project_required,year_invalid,dedication_invalid"}
    good, bad = quality.split_valid(quality.validate_plan_batch(b))
    assert good.count() == 1 and bad.count() == 2


def test_duplicate_usernames(spark):
    users = spark.createDataFrame([(1, "ann", 0, None)], schemas.USERS)
    req = spark.createDataFrame([(1, "bob"), (2, "ann"), (3, "bob")], "seq long, username string")
    assert rows(quality.reject_duplicate_usernames(req, users)) == [
        (1, "bob", "ok"), (2, "ann", "exists"), (3, "bob", "duplicate")]


def test_form_percent_to_fraction(spark):
    from pyspark.sql import functions as F
    from ledgerline.functions.scalars import percent_to_fraction
    got = [r[0] for r in spark.createDataFrame([(0,), (35,), (100,)], "p int")
           .select(percent_to_fraction(F.col("p"))).collect()]
    assert got == [0.0, 0.35, 1.0]


def test_read_plan_batch_blank_cells_become_empty_text(spark):
    import os
    from ledgerline.session import local_path, scratch_path
    from ledgerline.sources import files
    root = scratch_path(spark, "t-batch")
    os.makedirs(local_path(root), exist_ok=True)
    with open(local_path(f"{root}/b.csv"), "w") as f:
        f.write("seq,employee,project,month,year,dedication,remarks\n1,e,P,3,2024,0.5,\n2,,P,,2024,0.2,x\n")
    b = files.read_plan_batch(spark, root)
    got = {r.seq: (r.employee, r.month, r.remarks) for r in b.collect()}
    assert got == {1: ("e", "3", ""), 2: ("", "", "x")}
    v = {r.seq: r.violations for r in quality.validate_plan_batch(b).collect()}
    assert v == {1: "", 2: "employee_required,month_invalid"}


def test_request_without_a_name_is_kept(spark):
    users = spark.createDataFrame([("ann",)], "username string")
    asked = spark.createDataFrame([(1, "ann"), (2, None), (3, "bob"), (4, "bob"), (5, None)], "seq long, username string")
    got = {r.seq: r.status for r in quality.reject_duplicate_usernames(asked, users).collect()}
    assert got == {1: "exists", 2: "missing", 3: "ok", 4: "duplicate", 5: "missing"}


def test_sentence_of_a_change_without_author_or_project(spark):
    from ledgerline import schemas
    base = dict.fromkeys(schemas.CHANGELOG.fieldNames())
    data = [base | {"id": 1, "employee": "e", "month": 1, "year": 2024, "dedication_old": 0.1, "dedication_new": 0.2},
            base | {"id": 2, "concept": "c", "author": "me", "cost_old": 1, "cost_new": 2, "month": 3, "year": 2024, "remarks": "why"}]
    log = spark.createDataFrame([tuple(r.values()) for r in data], schemas.CHANGELOG)
    got = {r.id: r.sentence for r in chg.sentences(log).collect()}
    assert got == {1: "None changed the dedication of e in None - 1/2024 from 10% to 20%.",
                   2: "me changed the cost of c in None - 3/2024 from 1\u20ac to 2\u20ac. Motivation: why"}
    assert chg.text_filter(chg.sentences(log), "NONE CHANGED").count() == 1


def test_top_n_beyond_the_partial_limit(spark):
    from ledgerline.operators.topn import top_n
    df = spark.range(9000).select("id", (F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = top_n(df, ["g"], [F.col("v").desc()], 1500, "id")
    want = {(g, 8999 - (1 - g) - 2 * k, k + 1) for g in (0, 1) for k in range(1500)}
    assert {(r.g, r.id, r["rank"]) for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") >= 1
