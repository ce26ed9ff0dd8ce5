"""Summaries built on the month matrices: by project, employee, profile.

A summary is a *sum of means*: first the mean per (employee, project, year,
month) cell, then the sum of those cells per item.  A plain sum over the raw
rows would count duplicate forecast rows twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .matrix import MONTH_COLS, cell_means, widen

CELL_KEYS = ["employee", "project"]


def summary(plan: DataFrame, item: str, value: str = "dedication") -> DataFrame:
    """(year, item, m1..m12, total) for every year in one pass."""
    return summary_from_cells(cell_means(plan, CELL_KEYS, value), item)


def summary_from_cells(cells: DataFrame, item: str) -> DataFrame:
    """Summary from the cell means (employee, project, year, month, value).

    ``widen`` sums ``when(month = m, value)`` per (year, item), which is the
    per-item month sum and the pivot in one aggregation.
    """
    wide = widen(cells, ["year", item])
    return wide.withColumn("total", scalars.row_sum(MONTH_COLS))


def summary_all_years(plan: DataFrame, value: str = "dedication") -> DataFrame:
    """Both summaries for all years: (year, dimension, item, m1..m12, total).

    The cell means are computed once; grouping sets ((year, project),
    (year, employee)) build both summaries in one aggregation, and
    ``grouping(employee)`` names the dimension of each row.
    """
    cells = cell_means(plan, CELL_KEYS, value)
    sums = [F.coalesce(F.sum(F.when(F.col("month") == m, F.col("value"))), F.lit(0.0)).alias(f"m{m}")
            for m in range(1, 13)]
    agg = cells.groupingSets([["year", "project"], ["year", "employee"]], "year", "project", "employee") \
        .agg(*sums, F.grouping("employee").alias("_by_project"))
    # grouping(employee) = 1 in the (year, project) set, where employee is rolled up
    by_project = F.col("_by_project") == 1
    return agg.select("year",
                      F.when(by_project, F.lit("project")).otherwise(F.lit("employee")).alias("dimension"),
                      F.when(by_project, F.col("project")).otherwise(F.col("employee")).alias("item"),
                      *MONTH_COLS).withColumn("total", scalars.row_sum(MONTH_COLS))


def merge_profile_maps(active_users: DataFrame, stored: DataFrame,
                       uploaded: DataFrame) -> DataFrame:
    """Last-wins merge: active users -> '', then the stored map, then the
    uploaded map.  (employee, profile) with one row per employee.

    Priorities make the merge a per-name aggregate (max_by) instead of a
    driver-side dict update.
    """
    parts = (active_users.select(F.col("name").alias("employee"), F.lit("").alias("profile"),
                                 F.lit(0).alias("prio"))
             .unionByName(stored.select("employee", "profile", F.lit(1).alias("prio")))
             .unionByName(uploaded.select("employee", "profile", F.lit(2).alias("prio"))))
    # (prio, profile) as the ordering keeps the result deterministic should a
    # map list the same employee twice.
    return (parts.filter(F.col("employee").isNotNull()).groupBy("employee")
            .agg(F.max_by("profile", F.struct("prio", "profile")).alias("profile")))


def with_profile(cells: DataFrame, profile_map: DataFrame) -> DataFrame:
    """Profile = mapped value when the employee is a key of the map (even an
    empty one), else the employee name.  No chained mapping."""
    pm = profile_map.select(F.col("employee").alias("_pm_emp"), F.col("profile").alias("_pm_prof"))
    joined = cells.join(pm, cells["employee"] == pm["_pm_emp"], "left")
    return (joined.withColumn("profile", F.when(F.col("_pm_emp").isNotNull(), F.col("_pm_prof"))
                              .otherwise(F.col("employee")))
            .drop("_pm_emp", "_pm_prof"))


def profile_matrix(plan: DataFrame, profile_map: DataFrame,
                   value: str = "dedication") -> DataFrame:
    """(year, project, profile, m1..m12): sum of cell means per profile."""
    return profile_matrix_from_cells(cell_means(plan, CELL_KEYS, value), profile_map)


def profile_matrix_from_cells(cells: DataFrame, profile_map: DataFrame) -> DataFrame:
    """Profile matrix from the cell means (employee, project, year, month, value)."""
    return widen(with_profile(cells, profile_map), ["year", "project", "profile"])


def load_bands(summary_by_employee: DataFrame) -> DataFrame:
    """Band of every observed month cell and of the total of the employee
    summary: (year, employee, cell, value, band); cell is '1'..'12' or 'TOTAL'.

    Input is the long per-item table, so only observed months appear.
    """
    return summary_by_employee.select("year", "employee", "cell", "value",
                                      scalars.load_band(F.col("value")).alias("band"))


def employee_cells_with_total(plan: DataFrame, value: str = "dedication") -> DataFrame:
    """Long employee summary plus a TOTAL row per (year, employee).

    One rollup over (year, employee, month) yields the month sums and the
    per-employee totals in a single aggregation; ``grouping_id`` tells the
    two levels apart (0: a month cell, 1: the month rolled up).
    """
    cells = cell_means(plan, CELL_KEYS, value)
    agg = (cells.rollup("year", "employee", "month")
           .agg(F.sum("value").alias("value"), F.grouping_id().alias("_level")))
    return (agg.filter(F.col("_level") <= 1)
            .select("year", "employee",
                    F.when(F.col("_level") == 1, F.lit("TOTAL"))
                    .otherwise(F.col("month").cast("string")).alias("cell"),
                    "value"))


def total_bar_fraction(table: DataFrame, total_col: str = "total",
                       part_col: str = "year") -> DataFrame:
    """Position of each row's total between the minimum and maximum total of
    its year: (t - min) / (max - min); null when all totals are equal.

    Min / max are a per-year aggregate joined back (one row per year), not a
    window: a window would put a whole year into one task.
    """
    stats = table.groupBy(part_col).agg(F.min(total_col).alias("_tmin"), F.max(total_col).alias("_tmax"))
    out = table.join(stats, part_col)
    span = F.col("_tmax") - F.col("_tmin")
    return (out.withColumn("bar_fraction",
                           F.when(span == 0, F.lit(None).cast("double"))
                           .otherwise((F.col(total_col) - F.col("_tmin")) / span))
            .drop("_tmin", "_tmax"))


def _canonical(c: str):
    """Round to 6 decimals before display: a sum's last bits depend on the
    order of addition, which must not decide a displayed digit."""
    return F.round(F.col(c), 6)


def formatted_summary(summary_by_employee_wide: DataFrame) -> DataFrame:
    """Display text of the employee summary: cells ``0.0``, total ``0.0 PM``."""
    return summary_by_employee_wide.select(
        "year", "employee",
        *[scalars.fmt_one_decimal(_canonical(c)).alias(c) for c in MONTH_COLS],
        scalars.fmt_pm(_canonical("total")).alias("total"))


def formatted_dedication_matrix(wide: DataFrame) -> DataFrame:
    """Month cells of a dedication matrix as whole percent text (``0%``)."""
    return wide.select("year", "employee", "project",
                       *[scalars.fmt_percent(_canonical(c)).alias(c) for c in MONTH_COLS])


def formatted_cost_matrix(wide: DataFrame) -> DataFrame:
    """Cost matrix cells and total as ``n €`` text."""
    return wide.select("year", "project", "concept",
                       *[scalars.fmt_euro(F.col(c)).alias(c) for c in MONTH_COLS + ["total"]])
