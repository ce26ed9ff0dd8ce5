"""Ordered upsert with audit log: golden case, row-by-row equivalence, buckets."""

import random

from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import upsert

from conftest import rows

KEYS = ["employee", "project", "month", "year"]


def _base(spark, data):
    return spark.createDataFrame(data, schemas.FORECAST)


def _batch(spark, data):
    return spark.createDataFrame(
        data, "seq long, employee string, project string, remarks string, month int, year int, dedication double")


def row_by_row(base, batch):
    """The application's loop: lookup (lowest id), log, apply, per row."""
    state = {r[0]: list(r) for r in base}
    next_id = max([r[0] for r in base] or [0])
    log = []
    for seq, e, p, rem, m, y, v in sorted(batch):
        hit = None
        if None not in (e, p, m, y):
            cands = [i for i, r in state.items() if (r[1], r[2], r[4], r[5]) == (e, p, m, y)]
            hit = min(cands) if cands else None
        if hit is not None:
            log.append((seq, "update", state[hit][6], v))
            state[hit][6], state[hit][3] = v, rem
        else:
            log.append((seq, "add", 0.0, v))
            next_id += 1
            state[next_id] = [next_id, e, p, rem, m, y, v]
    return sorted(log), sorted(((r[1], r[2], r[4], r[5], r[6]) for r in state.values()), key=none_safe)


def none_safe(t):
    return tuple((v is None, v) for v in t)


def test_golden_case(spark):
    base = _base(spark, [(1, "k", "P", "", 1, 2024, 0.2)])
    batch = _batch(spark, [(1, "k", "P", "r1", 1, 2024, 0.5), (2, "k", "P", "r2", 1, 2024, 0.7),
                           (3, "n", "P", "", 1, 2024, 0.1), (4, "n", "P", "", 1, 2024, 0.1)])
    log, state = upsert.forecast_upsert(base, batch, "me")
    assert [(r.seq, r.action, r.dedication_old, r.dedication_new) for r in log.orderBy("seq").collect()] == [
        (1, "update", 0.2, 0.5), (2, "update", 0.5, 0.7), (3, "add", 0.0, 0.1), (4, "update", 0.1, 0.1)]
    got = {(r.employee, r.id): (r.dedication, r.remarks) for r in state.collect()}
    assert got == {("k", 1): (0.7, "r2"), ("n", 4): (0.1, "")}  # new id = max base id + first seq


def test_duplicate_base_rows_only_lowest_id_updated(spark):
    base = _base(spark, [(5, "k", "P", "", 1, 2024, 0.2), (3, "k", "P", "", 1, 2024, 0.3)])
    batch = _batch(spark, [(10, "k", "P", "x", 1, 2024, 0.9)])
    log, state = upsert.forecast_upsert(base, batch, "me")
    assert [(r.action, r.dedication_old) for r in log.collect()] == [("update", 0.3)]
    assert rows(state.select("id", "dedication")) == [(3, 0.9), (5, 0.2)]


def test_null_key_rows_are_always_added(spark):
    base = _base(spark, [(1, "k", None, "", 1, 2024, 0.2)])
    batch = _batch(spark, [(1, "k", None, "", 1, 2024, 0.5), (2, "k", None, "", 1, 2024, 0.6)])
    log, state = upsert.forecast_upsert(base, batch, "me")
    assert [r.action for r in log.orderBy("seq").collect()] == ["add", "add"]
    assert state.count() == 3


def _random_case(seed, n_base=40, n_batch=120):
    rnd = random.Random(seed)
    emps, projs = ["a", "b", "c"], ["P", "Q"]
    base = [(i, rnd.choice(emps), rnd.choice(projs), "", rnd.randint(1, 3), 2024, rnd.randint(0, 100) / 100)
            for i in range(1, n_base + 1)]
    seqs = rnd.sample(range(1, 10 * n_batch), n_batch)
    batch = [(s, rnd.choice(emps), rnd.choice(projs), f"r{s}", rnd.randint(1, 3), 2024, rnd.randint(0, 100) / 100)
             for s in seqs]
    return base, batch


def test_matches_row_by_row_loop_for_any_bucket_width(spark):
    for seed, width in [(1, 1 << 20), (2, 7), (3, 1), (4, 50)]:
        base, batch = _random_case(seed)
        exp_log, exp_state = row_by_row(base, [(b[0], b[1], b[2], b[3], b[4], b[5], b[6]) for b in batch])
        log, state = upsert.forecast_upsert(_base(spark, base), _batch(spark, batch), "me", bucket_width=width)
        got_log = sorted((r.seq, r.action, r.dedication_old, r.dedication_new) for r in log.collect())
        assert got_log == exp_log, (seed, width)
        got_state = sorted(((r.employee, r.project, r.month, r.year, r.dedication) for r in state.collect()),
                           key=none_safe)
        assert got_state == exp_state, (seed, width)


def test_hot_key_is_split_across_buckets(spark):
    # one key holds every batch row; with width 10 the window partitions hold <= 10 rows
    batch = [(s, "hot", "P", "", 1, 2024, s / 1000) for s in range(1, 301)]
    seqd = upsert.sequence_within_key(_batch(spark, batch), KEYS, "dedication", bucket_width=10)
    got = sorted((r.seq, r._rn, r._prev) for r in seqd.collect())
    assert got == [(s, s, None if s == 1 else (s - 1) / 1000) for s in range(1, 301)]


def test_cost_upsert_logs_cost_new(spark):
    base = spark.createDataFrame([(1, "Travel", "P", "", 1, 2024, 100)], schemas.COST)
    batch = spark.createDataFrame([(7, "Travel", "P", "", 1, 2024, 150)],
                                  "seq long, concept string, project string, remarks string, month int, year int, cost int")
    log, state = upsert.cost_upsert(base, batch, "me")
    assert [(r.action, r.cost_old, r.cost_new) for r in log.collect()] == [("update", 100, 150)]
    assert [r.cost for r in state.collect()] == [150]


def test_inserts_are_spread_over_partitions(spark):
    """A first load is all inserts: no task may get them all."""
    base = spark.createDataFrame([(1, "k", "P", "", 1, 2024, 0.2)], schemas.FORECAST)
    batch = spark.range(20000).select((F.col("id") + 1).alias("seq"), F.concat(F.lit("e"), F.col("id")).alias("employee"),
                                      F.lit("P").alias("project"), F.lit(1).alias("month"), F.lit(2024).alias("year"),
                                      F.lit(0.5).alias("dedication"), F.lit("").alias("remarks"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, state = upsert.forecast_upsert(base, batch, "me")
        sizes = [r["count"] for r in state.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20001 and max(sizes) < 6000


def test_upsert_into_an_empty_table(spark):
    base = spark.createDataFrame([], schemas.FORECAST)
    batch = spark.createDataFrame([(1, "a", "P", 1, 2024, 0.5, ""), (2, "a", "P", 1, 2024, 0.6, "r"), (3, None, "P", 1, 2024, 0.1, "")],
                                  "seq long, employee string, project string, month int, year int, dedication double, remarks string")
    log, state = upsert.forecast_upsert(base, batch, "me")
    assert state.schema.simpleString() == base.schema.simpleString()
    assert sorted((r.id, r.employee, r.dedication) for r in state.collect()) == [(1, "a", 0.6), (3, None, 0.1)]
    assert sorted((r.seq, r.action) for r in log.collect()) == [(1, "add"), (2, "update"), (3, "add")]
