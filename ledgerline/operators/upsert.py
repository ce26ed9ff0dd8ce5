"""Ordered upsert of a batch with an audit log (forecasts and costs).

Row-by-row semantics being reproduced, for each batch row in ``seq`` order:

* key present in the current state -> log ``update`` with old = the current
  value, then set value and remarks on that row;
* otherwise -> log ``add`` with old = 0 and insert the row.

"Current state" includes rows inserted or updated earlier in the same batch.
When the base holds the same key several times, the row with the lowest id is
the one updated; the other duplicates stay as they are.  A row whose key has
a null part never matches anything (SQL equality), so it is always an ``add``.
``seq`` (the row's position in the landed batch) must be unique.

Parallel plan (no per-row lookups, no driver loop):

1. position and previous value of each row within its key: windows over
   (key, seq bucket), stitched across buckets by a window over the small
   per-bucket summary -- so a key holding a third of the batch is spread over
   many tasks instead of one;
2. one aggregate of the base per key (lowest id, its value), joined to that
   per-bucket summary, so the batch rows themselves are shuffled only once;
3. state: last value per key (``max_by`` on seq); the base is left-joined
   with the keys it has (on the key and the target id) and the other keys are
   added as new rows, so inserts stay spread by key as the aggregate left them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def _any_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def _sequenced(batch: DataFrame, keys: list[str], value: str, bucket_width: int,
               targets: DataFrame | None) -> DataFrame:
    """Batch rows with ``_rn``, ``_prev`` and (with ``targets``) ``_found`` /
    ``_base_value`` of the key's base row.

    Keyed rows (no null key part):

    * one exchange of the batch, by (key, bucket), for the row window;
    * the per-bucket summary is aggregated on that same partitioning (no
      exchange), joined to the base targets and windowed per key -- all on
      small data (one row per non-empty key bucket);
    * the summary is joined back on (key, bucket), which the rows already
      satisfy, so only the summary moves.

    Rows with a null key part never match a key: each is its own group.
    """
    # The join back on (key, bucket) would infer "key and seq not null" for
    # one use of the rows only; stating it here keeps both uses identical so
    # Spark shares their exchange (the batch is read once for keyed rows).
    keyed = batch.filter(~_any_null(keys) & F.col("seq").isNotNull()).withColumn(
        "_bucket", F.floor(F.col("seq") / F.lit(int(bucket_width))))
    w_in = Window.partitionBy(*keys, "_bucket").orderBy("seq")
    rows = (keyed.withColumn("_rn_in", F.row_number().over(w_in))
            .withColumn("_prev_in", F.lag(value).over(w_in)))

    buckets = (rows.groupBy(*keys, "_bucket")
               .agg(F.count(F.lit(1)).alias("_n"), F.max_by(value, "seq").alias("_last")))
    if targets is not None:
        buckets = buckets.join(targets, keys, "left")
    w_b = Window.partitionBy(*keys).orderBy("_bucket")
    buckets = (buckets
               .withColumn("_before", F.coalesce(
                   F.sum("_n").over(w_b.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("_prev_bucket_last", F.lag("_last").over(w_b))
               .drop("_n", "_last"))
    j = rows.join(buckets, [*keys, "_bucket"])
    seqd = (j.withColumn("_rn", F.col("_before") + F.col("_rn_in"))
            .withColumn("_prev", F.when(F.col("_rn_in") == 1, F.col("_prev_bucket_last"))
                        .otherwise(F.col("_prev_in")))
            .drop("_rn_in", "_prev_in", "_bucket", "_before", "_prev_bucket_last"))

    vtype = batch.schema[value].dataType
    solo = (batch.filter(_any_null(keys) | F.col("seq").isNull())
            .withColumn("_rn", F.lit(1).cast("long"))
            .withColumn("_prev", F.lit(None).cast(vtype)))
    if targets is not None:
        seqd = (seqd.withColumn("_found", F.col("_target_id").isNotNull())
                .drop("_target_id"))
        solo = (solo.withColumn("_base_value", F.lit(None).cast(vtype))
                .withColumn("_found", F.lit(False)))
    return seqd.unionByName(solo)


def sequence_within_key(batch: DataFrame, keys: list[str], value: str,
                        bucket_width: int = config.UPSERT_SEQ_BUCKET) -> DataFrame:
    """Add ``_rn`` (1-based position of the row within its key, by seq) and
    ``_prev`` (value of the previous row of the same key, null for the first).

    Windows run over (key, seq bucket) and are stitched across buckets by a
    window over the per-bucket summary, so a key holding a third of the batch
    is spread over many tasks instead of one.
    """
    return _sequenced(batch, keys, value, bucket_width, None)


def base_targets(base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key of the base: the lowest id and that row's value."""
    return (base.filter(~_any_null(keys)).groupBy(*keys)
            .agg(F.min("id").alias("_target_id"), F.min_by(value, "id").alias("_base_value")))


def upsert_log(base: DataFrame, batch: DataFrame, keys: list[str], value: str,
               author: str, bucket_width: int = config.UPSERT_SEQ_BUCKET) -> DataFrame:
    """Audit rows, one per batch row:
    (seq, action, author, keys..., <value>_old, <value>_new, remarks)."""
    j = _sequenced(batch, keys, value, bucket_width, base_targets(base, keys, value))
    later = F.col("_rn") > 1
    action = F.when(later | F.col("_found"), F.lit("update")).otherwise(F.lit("add"))
    vtype = batch.schema[value].dataType
    old = (F.when(later, F.col("_prev")).when(F.col("_found"), F.col("_base_value"))
           .otherwise(F.lit(0).cast(vtype)))
    return j.select("seq", action.alias("action"), F.lit(author).alias("author"), *keys,
                    old.alias(f"{value}_old"), F.col(value).alias(f"{value}_new"), "remarks")


def next_id(base: DataFrame) -> Column:
    """What the ids of inserted rows are counted from: the largest id of the
    base (0 if it is empty), as a scalar subquery."""
    return base.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()


def upsert_state(base: DataFrame, batch: DataFrame, keys: list[str], value: str,
                 first_id: Column | None = None) -> DataFrame:
    """The table after the batch: base rows (the target row of each touched key
    carries the key's last value and remarks) plus one new row per key that
    was not in the base, with id ``first_id + first seq of the key``.

    ``first_id`` defaults to the largest id of the base.  A stream, whose
    batches are each numbered from 1, passes a number of its own per
    micro-batch, so that ids of different files never meet.
    """
    b = batch.withColumn("_solo", F.when(_any_null(keys), F.col("seq")))
    last = (b.groupBy(*keys, "_solo")
            .agg(F.max_by(F.struct(F.col(value).alias("v"), F.col("remarks").alias("r")), "seq").alias("_last"),
                 F.min("seq").alias("_first_seq")))
    matched = (last.join(base_targets(base, keys, value), keys, "left")
               .select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_target_id", "_last", "_first_seq"))
    hits = matched.filter(F.col("_target_id").isNotNull())
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_k_{k}") for k in keys], F.col("id") == F.col("_target_id"))
    new = {value: F.col("_last.v"), "remarks": F.col("_last.r")}
    hit = F.col("_target_id").isNotNull()
    kept = base.join(hits, on, "left").select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in base.columns])
    start = next_id(base) if first_id is None else first_id
    added = new | {"id": start + F.col("_first_seq")} | {k: F.col(f"_k_{k}") for k in keys}
    types = dict(base.dtypes)
    inserts = matched.filter(F.col("_target_id").isNull()).select(
        *[added.get(c, F.lit(None)).cast(types[c]).alias(c) for c in base.columns])
    return kept.unionByName(inserts)


def forecast_upsert(base: DataFrame, batch: DataFrame, author: str,
                    bucket_width: int = config.UPSERT_SEQ_BUCKET) -> tuple[DataFrame, DataFrame]:
    keys = ["employee", "project", "month", "year"]
    return (upsert_log(base, batch, keys, "dedication", author, bucket_width),
            upsert_state(base, batch, keys, "dedication"))


def cost_upsert(base: DataFrame, batch: DataFrame, author: str,
                bucket_width: int = config.UPSERT_SEQ_BUCKET) -> tuple[DataFrame, DataFrame]:
    """Costs: the new cost is logged as ``cost_new`` (the form path's
    habit of writing it to the dedication column is not reproduced)."""
    keys = ["concept", "project", "month", "year"]
    return (upsert_log(base, batch, keys, "cost", author, bucket_width),
            upsert_state(base, batch, keys, "cost"))


def form_forecast_upsert(base: DataFrame, submissions: DataFrame, author: str,
                         bucket_width: int = config.UPSERT_SEQ_BUCKET) -> tuple[DataFrame, DataFrame]:
    """Form entries carry whole percent (``dedication_pct``); they become
    fractions of a person-month before the same ordered upsert."""
    from ..functions.scalars import percent_to_fraction
    batch = (submissions.withColumn("dedication", percent_to_fraction(F.col("dedication_pct")))
             .drop("dedication_pct"))
    return forecast_upsert(base, batch, author, bucket_width)
