"""Driver contract: entry runs, every query has a stable schema, the oracle
agrees on the small tables for a representative subset."""

import duckdb

import __spark_entry__ as E
from ledgerline.plans import registry
from ledgerline.sources.tables import TABLES

from conftest import SF_SMALL

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}

# Streaming queries run their streams end to end; they have their own tests.
STREAMING = {"stream_last_seen", "stream_monthly_hours", "stream_spent_time",
             "stream_forecast_upsert_state", "stream_forecast_upsert_log"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["year", "employee", "project"]


def test_every_query_has_oracle_or_is_declared_rows_only():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert set(registry.registry()) - set(sql) == E.NO_ORACLE


def test_oracle_agrees_on_every_query(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name in sorted(set(registry.registry()) & set(E.oracle_sql()) - STREAMING):
        df = E.queries()[name](spark, SF_SMALL)
        rel = con.sql(E.oracle_sql()[name])
        spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                       for f in df.schema.fields}
        assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}, name
        res = con.execute(E.oracle_sql()[name])
        dcols = [d[0] for d in res.description]
        assert sorted(df.columns) == sorted(dcols), name
        norm = lambda cols, rs: sorted(
            repr(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[cols.index(c)] for c in sorted(cols))))
            for r in rs)
        assert norm(df.columns, [tuple(r) for r in df.collect()]) == norm(dcols, res.fetchall()), name
