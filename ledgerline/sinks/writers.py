"""Sinks on shared storage.

Plain Parquet has no MERGE, and overwriting a path that the same plan reads
fails, so a new state is written as a fresh snapshot folder and then becomes
the current one; the audit log is append-only and partitioned by year.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import epochs


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a table: full overwrite.  Rows are rebalanced on the partition
    columns first, so a partition gets files of a good size, not one per task."""
    w = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_snapshot(df: DataFrame, root: str, partition_by: list[str] | None = None,
                   run_key: str | None = None) -> str:
    """Write ``df`` as a new snapshot under ``root`` and return its path.

    Readers keep using the previous snapshot until the new one is complete, so
    a job that reads the current state can write the next one, and a run that
    fails leaves the old state in place.  A retried run (same ``run_key``)
    replaces its own snapshot.  ``<root>/current`` names the newest one.
    """
    path = f"{root.rstrip('/')}/snapshot-{run_key or uuid.uuid4().hex}"
    replace_table(df, path, partition_by)
    (df.sparkSession.createDataFrame([(path,)], "path string").coalesce(1)
     .write.mode("overwrite").json(f"{root.rstrip('/')}/current"))
    return path


def current_snapshot(spark: SparkSession, root: str) -> str:
    """Path of the newest complete snapshot under ``root``."""
    return spark.read.schema("path string").json(f"{root.rstrip('/')}/current").first()[0]


def append_log(log: DataFrame, path: str, run_key: str) -> None:
    """Add a run's audit rows (partitioned by year for retention and pruning).
    A retried run replaces the rows it wrote before."""
    (log.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(f"{path}/run={run_key}"))


#: Name of the partition of rows without a time.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def write_day_log(log: DataFrame, root: str, mode: str = "append") -> None:
    """Add rows to a log laid out by day (``<root>/day=YYYY-MM-DD``), the layout that :func:`expire_days` keeps."""
    days = log.withColumn("day", F.col("timestamp").cast("date").cast("string"))
    days.hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(root)


def read_day_log(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(root).select(*schema.names)


def expire_days(spark: SparkSession, root: str, cutoff: dt.datetime, schema: StructType) -> list[str]:
    """Delete the rows before the cutoff (rows without a time stay): whole days are dropped as folders, only the
    cutoff's own day is written again, so the work does not grow with the log.  Returns the days dropped.

    A run that fails is simply run again: what it dropped stays dropped, and the rewritten day is staged
    beside the log before it replaces the old one."""
    root = root.rstrip("/")
    boundary = cutoff.strftime("%Y-%m-%d")
    days = [f[4:] for f in epochs.folder_names(spark, root) if f.startswith("day=") and f[4:] != NO_DAY]
    old = [d for d in days if d < boundary]
    for day in old:
        epochs.remove(spark, f"{root}/day={day}")
    if boundary in days and cutoff != dt.datetime.combine(cutoff.date(), dt.time()):
        own, stage = spark.read.schema(schema).parquet(f"{root}/day={boundary}"), f"{root}/_expiring/{uuid.uuid4().hex}"
        own.filter(F.col("timestamp") >= F.lit(cutoff).cast("timestamp_ntz")).write.parquet(stage)
        spark.read.schema(schema).parquet(stage).write.mode("overwrite").parquet(f"{root}/day={boundary}")
        epochs.remove(spark, f"{root}/_expiring")
    return old


#: Folders that the users of a post export are dealt to.
POST_BUCKETS = 256


def export_posts_json(posts: DataFrame, path: str, buckets: int = POST_BUCKETS) -> None:
    """Posts as JSON lines ``{user_id, body, timestamp}``: a folder per bucket of
    users, in it each user's posts together and oldest first.

    Range partitioning on (bucket, user_id, timestamp, id) splits a user with a
    huge history across several tasks; each file is sorted and the files of a
    user cover consecutive time ranges in part-number order.  (Hash
    partitioning by user would give such a user one task, a folder per user
    millions of folders.)  Rows are ordered by the timestamp itself and
    formatted as ISO text only when written.
    """
    from ..functions.scalars import iso_utc
    order = ["bucket", "user_id", "timestamp", "id"]
    (posts.select(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"), "user_id", "id", "body", "timestamp")
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .select("bucket", "user_id", "body", iso_utc(F.col("timestamp")).alias("timestamp"))
     .write.mode("overwrite").partitionBy("bucket").json(path))


def write_profile_map(profile_map: DataFrame, path: str) -> None:
    """The merged map as one JSON object, an entry per line, in order of employee.

    The part files, one for a map of usual size, make up the object in
    part-number order; an entry but the first begins with its comma."""
    text = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    rows = profile_map.select("employee", F.concat(text("employee"), F.lit(": "), text("profile")).alias("entry"))
    first = rows.agg(F.min("employee")).scalar()
    lines = rows.select(F.lit(1).alias("part"), "employee", F.concat(
        F.when(F.col("employee") == first, "  ").otherwise(", "), F.col("entry")).alias("value"))
    braces = profile_map.sparkSession.createDataFrame([(0, None, "{"), (2, None, "}")], "part int, employee string, value string")
    (lines.union(braces).orderBy("part", "employee").select("value").write.mode("overwrite").text(path))


def write_reports(reports: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Each report in its own folder, partitioned by year (no loop over years)."""
    out = {}
    for name, df in reports.items():
        p = f"{root.rstrip('/')}/{name}"
        replace_table(df, p, ["year"] if "year" in df.columns else None)
        out[name] = p
    return out
