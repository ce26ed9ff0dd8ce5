"""Month matrices: mean per key and month, pivoted to twelve month columns.

Canonical form is long (keys, year, month, value); the wide form has fixed
columns ``m1`` .. ``m12`` (0 where no value) so every year has one schema.
Cells average duplicate keys (the pivot's default aggregate is the mean),
rows with a null key, month, year or value are dropped first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import all_not_null, row_sum

MONTHS = list(range(1, 13))
MONTH_COLS = [f"m{m}" for m in MONTHS]


def drop_incomplete(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows the pivot would ignore: null keys, null month/year, null value."""
    return df.filter(all_not_null(list(keys) + ["year", "month", value]))


def cell_means(df: DataFrame, keys: list[str], value: str, out: str = "value") -> DataFrame:
    """Long form: mean of ``value`` per (keys, year, month).

    One hash aggregate with map-side partial combine: a hot key costs one
    partial row per input partition, not a hot task.
    """
    clean = drop_incomplete(df, keys, value)
    return clean.groupBy(*keys, "year", "month").agg(F.avg(value).alias(out))


def widen(long_df: DataFrame, keys: list[str], value: str = "value",
          fill: float = 0.0) -> DataFrame:
    """Long (keys, month, value) -> m1..m12 columns: the sum of the values of
    each month per ``keys`` (the value itself when (keys, month) is unique)."""
    aggs = [F.coalesce(F.sum(F.when(F.col("month") == m, F.col(value))), F.lit(fill)).alias(f"m{m}")
            for m in MONTHS]
    return long_df.groupBy(*keys).agg(*aggs)


def mean_matrix(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Wide mean matrix in a single aggregation (one exchange).

    ``avg(when(month = m, value))`` averages exactly the rows of month m, so
    this equals cell means followed by a pivot, without the second shuffle.
    """
    clean = drop_incomplete(df, keys, value)
    aggs = [F.coalesce(F.avg(F.when(F.col("month") == m, F.col(value))), F.lit(0.0)).alias(f"m{m}")
            for m in MONTHS]
    return clean.groupBy("year", *keys).agg(*aggs)


def dedication_matrix(forecast: DataFrame) -> DataFrame:
    """(year, employee, project, m1..m12): mean dedication per month, gaps 0."""
    return mean_matrix(forecast, ["employee", "project"], "dedication")


def cost_matrix(cost: DataFrame) -> DataFrame:
    """(year, project, concept, m1..m12, total): mean cost per month, gaps 0.

    Always double: a mean of integer costs can be fractional.
    """
    m = mean_matrix(cost.withColumn("cost", F.col("cost").cast("double")),
                    ["project", "concept"], "cost")
    return m.withColumn("total", row_sum(MONTH_COLS))


def to_long(wide: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Wide m1..m12 -> long (keys, month, value), zero cells kept."""
    stack = ", ".join(f"{m}, m{m}" for m in MONTHS)
    return wide.selectExpr(*keys, f"stack(12, {stack}) as (month, {value})")


def observed_months(df: DataFrame, year: int | None = None) -> list[int]:
    """Months that hold at least one value (optionally in one year).

    At most twelve values reach the driver; they decide the columns of an
    observed-only matrix, which is a schema decision, not data.
    """
    src = df if year is None else df.filter(F.col("year") == year)
    return sorted(r[0] for r in src.filter(F.col("month").isNotNull()).select("month").distinct().collect())


def year_matrix(df: DataFrame, keys: list[str], value: str, year: int,
                observed_only: bool = False) -> DataFrame:
    """The matrix of one year (partition-pruned when the table is partitioned
    by year); with ``observed_only`` only the months present become columns,
    as in a pivot table."""
    one = df.filter(F.col("year") == year)
    wide = mean_matrix(one, keys, value)
    if not observed_only:
        return wide
    months = observed_months(drop_incomplete(one, keys, value))
    return wide.select("year", *keys, *[f"m{m}" for m in months])
