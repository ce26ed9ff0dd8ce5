"""Time-tracker rollup: entries -> hours and person-months per calendar month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config

IMPORT_REMARK = "Imported from time tracker at "


def drop_zero_hours(entries: DataFrame) -> DataFrame:
    """Drop entries with exactly 0 hours; null hours are kept (``!= 0`` in
    the tracker export is true for a missing value)."""
    return entries.filter(~F.col("hours").eqNullSafe(0))


def monthly_hours(entries: DataFrame, tasks: int | None = None) -> DataFrame:
    """(year, month, project, employee, hours): hours per calendar month.

    Rows with a null date, project or employee are dropped; a group whose
    hours are all null sums to 0.  A calendar month is not a fixed-width
    window, so the month is a grouping key (year(date), month(date)).

    With ``tasks`` the entries are dealt by group into so many tasks first: a
    task then holds the groups of its share of the table, here and in what is
    computed per group from these rows, whatever the size of a scan split or
    of a coalesced partition (a group's entries meet in one task, which adds
    them up as they come).
    """
    clean = entries.filter(F.col("date").isNotNull() & F.col("project").isNotNull()
                           & F.col("employee").isNotNull())
    keys = ["year", "month", "project", "employee"]
    rows = clean.select(F.year("date").alias("year"), F.month("date").alias("month"), "project", "employee", "hours")
    if tasks:
        rows = rows.repartition(tasks, *keys)
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours"))


def spent_time(entries: DataFrame, run_stamp: str,
               avg_monthly_hours: float = config.AVG_MONTHLY_HOURS, tasks: int | None = None) -> DataFrame:
    """The spent-time table: dedication = hours / average monthly hours, and
    the employee's total hours of the month on every project row.

    ``run_stamp`` is the import time as text (``dd/mm/YYYY HH:MM:SS``); it is
    passed in so the job is deterministic and re-runnable.  ``tasks`` as in
    :func:`monthly_hours`.
    """
    return spent_from_monthly(monthly_hours(drop_zero_hours(entries), tasks), run_stamp, avg_monthly_hours)


def spent_from_monthly(hours: DataFrame, run_stamp: str,
                       avg_monthly_hours: float = config.AVG_MONTHLY_HOURS) -> DataFrame:
    """Spent-time rows from (year, month, project, employee, hours).

    The employee's monthly total is a window over the *aggregated* rows: one
    window partition is one (year, month, employee) and holds at most one row
    per project, however many raw entries the employee booked.  (An aggregate
    joined back would read the entries twice: the two branches get different
    inferred filters, so their exchanges are not shared.)
    """
    w = Window.partitionBy("year", "month", "employee")
    return hours.select("employee", "project",
                        F.lit(IMPORT_REMARK + run_stamp).alias("remarks"),
                        "month", "year",
                        (F.col("hours") / F.lit(float(avg_monthly_hours))).alias("dedication"),
                        F.sum("hours").over(w).alias("total_hours"))


def entries_slice(entries: DataFrame, employee: str, project: str | None = None,
                  from_date: str | None = None, to_date: str | None = None,
                  limit: int | None = None) -> DataFrame:
    """Entries of one employee, optionally one project, optionally from and/or
    to a date (inclusive).  Every given filter is applied, each date bound on
    its own.  Only with ``limit`` the first ones by (date, project, hours)."""
    out = entries.filter(F.col("employee") == employee)
    if project is not None:
        out = out.filter(F.col("project") == project)
    if from_date:
        out = out.filter(F.col("date") >= F.lit(from_date).cast("date"))
    if to_date:
        out = out.filter(F.col("date") <= F.lit(to_date).cast("date"))
    return out if limit is None else out.orderBy("date", "project", "hours").limit(limit)
