"""Row validation with quarantine, and uniqueness checks before insert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config


def _try_int(name: str) -> Column:
    return F.expr(f"try_cast(trim(`{name}`) as int)")


def _try_double(name: str) -> Column:
    return F.expr(f"try_cast(trim(`{name}`) as double)")


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name)) == "")


def validate_plan_batch(batch: DataFrame, year_range: tuple[int, int] = config.YEAR_RANGE,
                        dedication_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Forecast batch (text cells) -> typed rows plus ``violations`` (comma
    separated codes, '' when valid) and ``is_valid``.

    Codes: employee_required, project_required, month_invalid, year_invalid,
    dedication_invalid.  Bad rows are kept and flagged (quarantine), never
    dropped; the good rows proceed to the upsert.
    """
    month, year, ded = _try_int("month"), _try_int("year"), _try_double("dedication")
    lo, hi = year_range
    dlo, dhi = dedication_range
    checks = [
        F.when(_blank("employee"), F.lit("employee_required")),
        F.when(_blank("project"), F.lit("project_required")),
        F.when(month.isNull() | (month < 1) | (month > 12), F.lit("month_invalid")),
        F.when(year.isNull() | (year < lo) | (year > hi), F.lit("year_invalid")),
        F.when(ded.isNull() | (ded < dlo) | (ded > dhi), F.lit("dedication_invalid")),
    ]
    v = F.concat_ws(",", *checks)
    return batch.select("seq", "employee", "project", month.alias("month"), year.alias("year"),
                        ded.alias("dedication"), "remarks", v.alias("violations")
                        ).withColumn("is_valid", F.col("violations") == "")


def validate_cost_batch(batch: DataFrame, concepts: tuple[str, ...] = config.COST_CONCEPTS,
                        year_range: tuple[int, int] = config.YEAR_RANGE) -> DataFrame:
    """Cost batch: concept in the accepted list, cost >= 0, month 1-12, year
    in range, project required."""
    lo, hi = year_range
    checks = [
        F.when(F.col("concept").isNull() | ~F.col("concept").isin(*concepts), F.lit("concept_invalid")),
        F.when(_blank("project"), F.lit("project_required")),
        F.when(F.col("month").isNull() | (F.col("month") < 1) | (F.col("month") > 12), F.lit("month_invalid")),
        F.when(F.col("year").isNull() | (F.col("year") < lo) | (F.col("year") > hi), F.lit("year_invalid")),
        F.when(F.col("cost").isNull() | (F.col("cost") < 0), F.lit("cost_invalid")),
    ]
    v = F.concat_ws(",", *checks)
    return batch.withColumn("violations", v).withColumn("is_valid", F.col("violations") == "")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the flag columns, quarantined rows with them)."""
    good = validated.filter(F.col("is_valid")).drop("violations", "is_valid")
    bad = validated.filter(~F.col("is_valid"))
    return good, bad


def reject_duplicate_usernames(requests: DataFrame, users: DataFrame) -> DataFrame:
    """(seq, username, status) with status ``missing`` (no name), ``exists``
    (name already taken), ``duplicate`` (asked for earlier in the same batch)
    or ``ok``.

    Earlier-in-batch is decided by the first seq per name (an aggregate
    joined back), so a name requested by a third of the batch is not a
    single-task window.
    """
    taken = users.select(F.col("username").alias("_taken")).distinct()
    first = requests.groupBy("username").agg(F.min("seq").alias("_first_seq"))
    j = (requests.join(first, "username", "left")
         .join(taken, F.col("username") == F.col("_taken"), "left"))
    status = (F.when(F.col("username").isNull(), F.lit("missing"))
              .when(F.col("_taken").isNotNull(), F.lit("exists"))
              .when(F.col("seq") != F.col("_first_seq"), F.lit("duplicate"))
              .otherwise(F.lit("ok")))
    return j.select("seq", "username", status.alias("status"))
