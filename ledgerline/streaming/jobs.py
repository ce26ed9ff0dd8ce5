"""Streaming jobs: last seen (R3), monthly hours (R1), ordered upsert (R2).

R1 and R3 keep no streaming state: a micro-batch adds its own aggregates to an
:class:`~ledgerline.sinks.epochs.EpochTable`, which folds them now and then, so
both what a micro-batch writes and what a reader opens stay bounded.  R2 keeps
its state table partitioned by (year, month), rewrites only the partitions a
micro-batch touches, and stages each micro-batch so that a replay only
re-publishes (see :func:`start_forecast_upsert`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .. import schemas
from ..operators import quality, timesheets, upsert
from ..sinks import epochs
from ..sources import files


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | None = None, **options) -> DataFrame:
    """A file source on shared storage (a folder, or a glob of files).

    Admit files by bytes rather than by number: a micro-batch then has a size
    that fits the cluster whether exports come in few large or many small files."""
    r = spark.readStream.schema(schema).format(fmt)
    for name, most in (("maxFilesPerTrigger", max_files_per_trigger), ("maxBytesPerTrigger", max_bytes_per_trigger)):
        if most:
            r = r.option(name, most)
    return r.options(**options).load(path)


def time_entry_stream(spark: SparkSession, path: str, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """The landed tracker exports as a stream, read as :func:`files.read_time_entry_csv` reads them."""
    return file_stream(spark, path, files.TIME_ENTRY_CSV_READ, "csv", max_bytes_per_trigger=max_bytes_per_trigger,
                       **files.TIME_ENTRY_CSV_OPTIONS)


def _start(df: DataFrame, writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = df.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


# ---------------------------------------------------------------- R3 last seen
def _last_seen_table(spark: SparkSession, root: str, schema: StructType | None = None) -> epochs.EpochTable:
    return epochs.EpochTable(spark, root.rstrip("/"), schema or schemas.LAST_SEEN, ["user_id"], {"last_seen": F.max})


def last_seen_updates(events: DataFrame, user_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """Newest time per user."""
    return events.groupBy(F.col(user_col).alias("user_id")).agg(F.max(ts_col).alias("last_seen"))


def start_last_seen(events: DataFrame, root: str, checkpoint: str,
                    available_now: bool = True) -> StreamingQuery:
    spark = events.sparkSession
    epochs.claim(spark, root, checkpoint)
    table = _last_seen_table(spark, root)
    return _start(events, lambda batch, n: table.write(last_seen_updates(batch), n), checkpoint, available_now)


def read_last_seen(spark: SparkSession, root: str) -> DataFrame:
    return _last_seen_table(spark, root).read()


# ---------------------------------------------------------------- R1 monthly hours
_HOURS_KEYS = ["year", "month", "project", "employee"]


def _hours_table(spark: SparkSession, root: str) -> epochs.EpochTable:
    fields = [schemas.SPENT_TIME[c] for c in _HOURS_KEYS] + [StructField("hours", DoubleType())]
    return epochs.EpochTable(spark, f"{root.rstrip('/')}/hours", StructType(fields), _HOURS_KEYS, {"hours": F.sum})


def start_monthly_hours(raw_csv: DataFrame, root: str, checkpoint: str,
                        available_now: bool = True) -> StreamingQuery:
    """Tracker CSV rows -> hours per (year, month, project, employee).

    Each micro-batch adds the hours of its own rows; late entries always count
    (the nightly job recomputed everything), and nothing is kept in between, so
    there is neither state nor watermark.  Rows that do not parse are written to
    ``<root>/quarantine/epoch=N``, as they came; they are counted while the hours
    are added up, and read again only if there are any."""
    spark, out = raw_csv.sparkSession, root.rstrip("/")
    epochs.claim(spark, root, checkpoint)
    table = _hours_table(spark, root)

    def apply(batch: DataFrame, epoch_id: int) -> None:
        seen = Observation()
        watched = batch.observe(seen, F.count_if(files.entry_violations(batch) != "").alias("bad"))
        table.write(timesheets.monthly_hours(timesheets.drop_zero_hours(files.parse_time_entries(watched))), epoch_id)
        if seen.get.get("bad"):
            files.bad_time_entries(batch).write.mode("overwrite").parquet(f"{out}/quarantine/epoch={epoch_id}")

    return _start(raw_csv, apply, checkpoint, available_now)


def read_monthly_hours(spark: SparkSession, root: str) -> DataFrame:
    """Hours of every group over all micro-batches."""
    return _hours_table(spark, root).read()


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """The rows that no micro-batch could read, with their ``violations``."""
    folder = f"{root.rstrip('/')}/quarantine"
    schema = StructType([*files.TIME_ENTRY_CSV_READ.fields, StructField("violations", StringType())])
    if not epochs.exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).select(*schema.names)


def read_spent_time(spark: SparkSession, root: str, run_stamp: str) -> DataFrame:
    """The spent-time table (dedication, employee totals) from the stream."""
    return timesheets.spent_from_monthly(read_monthly_hours(spark, root), run_stamp)


# ---------------------------------------------------------------- R2 upsert
STATE_PARTITIONS = ["year", "month"]
#: Ids set aside for the rows of one micro-batch.
EPOCH_SPAN = 1 << 32


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its (shared) file system: resolving a file
    source checks the path without reading any data."""
    try:
        spark.read.format("text").load(path)
        return True
    except AnalysisException:
        return False


#: Columns of a batch stream that tell a row's file: files are replayed in this order, each in order of its seq.
FILE_COLUMNS = ["_file_time", "_file_name"]


def plan_batch_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                      max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Landed forecast batches as a stream; a micro-batch may hold several files, each numbered from 1."""
    rows = file_stream(spark, path, schemas.PLAN_BATCH, max_files_per_trigger=max_files_per_trigger,
                       max_bytes_per_trigger=max_bytes_per_trigger)
    return rows.select("*", *[F.col(f"_metadata.{c}").alias(name) for c, name in
                              zip(("file_modification_time", "file_path"), FILE_COLUMNS)])


def _in_file_order(batch: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The micro-batch numbered through its files (as they landed: by time, then name), and the way back.

    The driver sees one row per file of the micro-batch, so as many as a trigger admits."""
    if not set(FILE_COLUMNS) <= set(batch.columns):
        return batch, lambda df: df
    sizes = batch.groupBy(*FILE_COLUMNS).agg(F.max("seq").alias("n")).orderBy(*FILE_COLUMNS).collect()
    offsets, total = {}, 0
    for r in sizes:
        offsets[r[FILE_COLUMNS[1]]] = total
        total += r.n or 0
    if not offsets:
        return batch.drop(*FILE_COLUMNS), lambda df: df
    of = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    starts = F.array(*[F.lit(x).cast("long") for x in sorted(set(offsets.values()))])
    own = F.col("seq") - F.array_max(F.filter(starts, lambda x: x < F.col("seq")))
    return (batch.withColumn("seq", F.col("seq") + of[F.col(FILE_COLUMNS[1])].cast("long")).drop(*FILE_COLUMNS),
            lambda df: df.withColumn("seq", own))


def start_forecast_upsert(batches: DataFrame, initial_state_path: str, state_root: str, out_root: str,
                          checkpoint: str, author: str, available_now: bool = True,
                          validate: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Apply landed forecast batches (plan-batch text schema) in order.

    The state table at ``state_root`` is partitioned by (year, month); both
    are part of the natural key, so a micro-batch can only change the
    partitions its rows fall in.  Micro-batch N:

    1. validate; bad rows -> ``<out_root>/quarantine/epoch=N``;
    2. read only the touched partitions of the state (partition pruning),
       run the ordered upsert against them, write the audit rows to
       ``<out_root>/log/epoch=N`` and stage the new partitions under
       ``<out_root>/staging/epoch=N`` (a ``_DONE`` marker closes the stage);
    3. publish: dynamic partition overwrite of the touched partitions.

    A replayed micro-batch whose stage is complete only re-publishes (the
    state may already hold its changes), so the log is written exactly once
    per micro-batch.  Files are numbered from 1; a micro-batch of several files
    (:func:`plan_batch_stream`) is replayed file by file as they landed, each in
    order of its ``seq``.  An inserted row gets the largest id of the table at
    ``initial_state_path`` (the state when the stream started) plus EPOCH_SPAN
    per micro-batch plus its number in the micro-batch, so rows of different
    files never share an id.  The tables may start out empty.  An ``out_root``
    belongs to one checkpoint, whose micro-batches it is numbered by.
    """
    spark = batches.sparkSession
    out = out_root.rstrip("/")
    check = validate or quality.validate_plan_batch
    keys = ["employee", "project", "month", "year"]
    initial = spark.read.schema(schemas.FORECAST).parquet(initial_state_path)
    first_id = initial.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    epochs.claim(spark, out, checkpoint)

    def apply(batch: DataFrame, epoch_id: int) -> None:
        stage = f"{out}/staging/epoch={epoch_id}"
        if not _exists(spark, f"{stage}/_DONE"):
            # validated once for the four actions below (a lost cache block is
            # recomputed from the micro-batch's source files)
            numbered, as_landed = _in_file_order(batch)
            checked = check(numbered).persist()
            good, bad = quality.split_valid(checked)
            as_landed(bad).write.mode("overwrite").parquet(f"{out}/quarantine/epoch={epoch_id}")
            # Touched partitions: at most the number of (year, month)
            # partitions of the table, a small list of names.
            touched = [f"{r.year}-{r.month}" for r in good.select(*STATE_PARTITIONS).distinct().collect()]
            if touched:
                part_key = F.concat_ws("-", *[F.col(c).cast("string") for c in STATE_PARTITIONS])
                state = spark.read.schema(schemas.FORECAST).parquet(state_root).filter(part_key.isin(touched))
                log = upsert.upsert_log(state, good, keys, "dedication", author)
                new_part = upsert.upsert_state(state, good, keys, "dedication",
                                               F.lit(first_id + epoch_id * EPOCH_SPAN).cast("long"))
                # The state is published only after the stage is closed, so a
                # replay that gets here recomputes the same log from the same
                # state: the log can go straight to its final place.
                as_landed(log).write.mode("overwrite").parquet(f"{out}/log/epoch={epoch_id}")
                new_part.write.mode("overwrite").partitionBy(*STATE_PARTITIONS).parquet(f"{stage}/state")
            checked.unpersist()
            spark.createDataFrame([(epoch_id, len(touched))], "epoch long, partitions long") \
                .write.mode("overwrite").json(f"{stage}/_DONE")
        if _exists(spark, f"{stage}/state"):
            (spark.read.parquet(f"{stage}/state").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(*STATE_PARTITIONS)
             .parquet(state_root))

    w = (batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def land_state(df: DataFrame, state_root: str) -> None:
    """Write a forecast table in the layout the streaming upsert maintains."""
    df.write.mode("overwrite").partitionBy(*STATE_PARTITIONS).parquet(state_root)


def read_upsert_state(spark: SparkSession, state_root: str) -> DataFrame:
    t = spark.read.schema(schemas.FORECAST).parquet(state_root)
    return t.select(*[F.col(f.name).cast(f.dataType) for f in schemas.FORECAST.fields])


def read_upsert_log(spark: SparkSession, out_root: str) -> DataFrame:
    return spark.read.parquet(f"{out_root.rstrip('/')}/log").drop("epoch")
