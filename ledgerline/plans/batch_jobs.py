"""User-level batch jobs that read landed inputs and write results.

These are the jobs a scheduler runs (nightly refresh, retention, exports,
imports).  Every output goes to shared storage; nothing passes through the
driver.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import config, schemas
from ..functions.scalars import title_case_names
from ..operators import changelog as chg, quality, social, summary, timesheets, upsert
from ..session import cut_lineage
from ..sinks import epochs, writers
from ..sources import files
from . import reports


#: Ids of audit rows set aside for one second, and the tables that share them.
RUN_SPAN = 1 << 30
AUDITED = ("forecast", "cost")


def refresh_spent_time(spark: SparkSession, csv_path: str, table_path: str,
                       run_time: dt.datetime, quarantine_path: str | None = None) -> str:
    """Nightly refresh: tracker CSV -> spent-time table, by year, as a snapshot
    (a failed run leaves the last table current).  Rows that do not parse go to
    the quarantine (default ``<table_path>/quarantine``).  Returns the snapshot."""
    entries, bad = files.read_time_entry_csv(spark, csv_path)
    key = _run_key(run_time)
    bad.write.mode("overwrite").parquet(f"{quarantine_path or table_path + '/quarantine'}/run={key}")
    spent = timesheets.spent_time(entries, run_time.strftime("%d/%m/%Y %H:%M:%S"))
    return writers.write_snapshot(spent, table_path, ["year"], key)


def _run_key(run_time: dt.datetime) -> str:
    return run_time.strftime("%Y%m%dT%H%M%S")


def _audit(log: DataFrame, run_time: dt.datetime, table: str) -> DataFrame:
    """Log rows in the audit table's columns.  Ids are unique between runs: the run's second, its table,
    then the row's number in its batch; a batch with numbers beyond its room fails instead of running into
    the ids of another."""
    stamp = F.lit(run_time.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    second = int(run_time.replace(tzinfo=dt.timezone.utc).timestamp())
    room = RUN_SPAN // len(AUDITED)
    first = second * RUN_SPAN + AUDITED.index(table) * room
    number = F.when(F.col("seq").between(0, room - 1), F.col("seq")).otherwise(
        F.raise_error(F.concat(F.lit(f"a batch numbers its rows from 0 to {room - 1}, not "), F.coalesce(F.col("seq").cast("string"), F.lit("null")))).cast("long"))
    have = set(log.columns)
    cols = {f.name: f.dataType for f in schemas.CHANGELOG.fields}
    fixed = {"id": F.lit(first) + number, "timestamp": stamp}
    return log.select(*[fixed.get(c, F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in cols.items()])


def _batch_key(spark: SparkSession, root: str, table: str, run_time: dt.datetime, batch_path: str) -> str:
    """Names a run's outputs: its table, its time and its batch.  The same batch again replaces them; another
    batch for the same table and second is refused, as its audit rows would share ids."""
    run = f"{table}-{_run_key(run_time)}-"
    key = run + hashlib.sha256(batch_path.encode()).hexdigest()[:12]
    other = [f for f in epochs.folder_names(spark, f"{root}/changelog") if f.startswith(f"run={run}") and f != f"run={key}"]
    if other:
        raise ValueError(f"another {table} batch has run time {run_time}: {other[0]}")
    return key


def _apply(spark: SparkSession, state: DataFrame, checked: DataFrame, out_root: str, run_time: dt.datetime,
           author: str, apply, table: str, batch_path: str) -> str:
    root = out_root.rstrip("/")
    key = _batch_key(spark, root, table, run_time, batch_path)
    good, bad = quality.split_valid(checked)
    bad.write.mode("overwrite").parquet(f"{root}/quarantine/run={key}")
    log, new_state = apply(state, good, author)
    writers.append_log(_audit(log, run_time, table), f"{root}/changelog", key)
    return writers.write_snapshot(new_state, f"{root}/{table}", run_key=key)


def apply_forecast_batch(spark: SparkSession, state_path: str, batch_path: str, out_root: str,
                         author: str, run_time: dt.datetime, batch_format: str = "csv",
                         year_range: tuple[int, int] = config.YEAR_RANGE) -> str:
    """Import a forecast batch: validate, upsert, add the audit rows, write
    the new state as a snapshot and return its path (the new current state).

    Rejected rows go to ``<out_root>/quarantine/run=...``.  All three outputs are keyed by
    table, ``run_time`` and batch: a re-run replaces them, and nothing else does.
    """
    state = spark.read.schema(schemas.FORECAST).parquet(state_path)
    checked = quality.validate_plan_batch(files.read_plan_batch(spark, batch_path, batch_format), year_range)
    return _apply(spark, state, checked, out_root, run_time, author, upsert.forecast_upsert, "forecast", batch_path)


def apply_cost_batch(spark: SparkSession, state_path: str, batch_path: str, out_root: str, author: str,
                     run_time: dt.datetime, concepts: tuple[str, ...], batch_format: str = "csv",
                     year_range: tuple[int, int] = config.YEAR_RANGE) -> str:
    """Import a cost batch, as :func:`apply_forecast_batch` does for forecasts."""
    state = spark.read.schema(schemas.COST).parquet(state_path)
    checked = quality.validate_cost_batch(files.read_cost_batch(spark, batch_path, batch_format), concepts, year_range)
    return _apply(spark, state, checked, out_root, run_time, author, upsert.cost_upsert, "cost", batch_path)


def run_retention(spark: SparkSession, changelog_path: str, out_root: str,
                  as_of: dt.datetime) -> str:
    """Keep audit rows of the last 365 days (null timestamps kept) as a new snapshot."""
    kept = chg.retention(spark.read.parquet(changelog_path), as_of)
    return writers.write_snapshot(kept, out_root, ["year"])


def run_day_retention(spark: SparkSession, log_root: str, as_of: dt.datetime, days: int = config.RETENTION_DAYS) -> list[str]:
    """Retention of an audit log laid out by day (``writers.write_day_log``), in place: whole days are dropped."""
    return writers.expire_days(spark, log_root, as_of - dt.timedelta(days=days), schemas.CHANGELOG)


def counts_table(spark: SparkSession, root: str) -> epochs.EpochTable:
    """Stored counts per user (id, post_count, follower_count, followed_count), kept as signed deltas: batch N
    writes ``social.follow_deltas`` or ``social.count_deltas`` of the users it touches, reading adds them up."""
    fields = [StructField(c, LongType()) for c in ("id", *social.COUNTS)]
    return epochs.EpochTable(spark, root.rstrip("/"), StructType(fields), ["id"], dict.fromkeys(social.COUNTS, F.sum))


def export_reports(forecast: DataFrame, cost: DataFrame, spent: DataFrame, changelog: DataFrame,
                   root: str) -> dict[str, str]:
    """All yearly report sheets, with title-case headers, partitioned by year.

    The forecast cell means are checkpointed to the shared folder once and
    reused by the matrix and both summaries.
    """
    bundle = reports.report_bundle(forecast, cost, spent, changelog, materialize=cut_lineage)
    titled = {k: v.toDF(*title_case_names(v.columns)).withColumnRenamed("Year", "year")
              for k, v in bundle.items()}
    return writers.write_reports(titled, root)


def export_profiles(forecast: DataFrame, spent: DataFrame, cost: DataFrame, profile_map: DataFrame,
                    root: str) -> dict[str, str]:
    """Profile sheets and costs; the forecast cell means are computed once."""
    return writers.write_reports(reports.profile_bundle(forecast, spent, cost, profile_map, materialize=cut_lineage), root)


def export_all_posts(posts: DataFrame, path: str) -> None:
    """Every user's posts as JSON, oldest first, in folders of users."""
    writers.export_posts_json(posts, path)


def update_profile_map(spark: SparkSession, active_users: DataFrame, stored_path: str,
                       uploaded_path: str, out_path: str) -> DataFrame:
    """Merge active users, the stored map and an uploaded map (last wins) and
    write the result as one JSON object; returns the merged map."""
    merged = summary.merge_profile_maps(active_users, files.read_profile_map(spark, stored_path),
                                        files.read_profile_map(spark, uploaded_path))
    writers.write_profile_map(merged, out_path)
    return merged
