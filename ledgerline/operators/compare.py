"""Forecast against time actually spent: chart series and variance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import cell_means

FORECAST_STACK = "Forecast"
SPENT_STACK = "Spent Time"
_KEYS = ["employee", "project", "year", "month"]


def stacked_cells(forecast: DataFrame, spent: DataFrame) -> DataFrame:
    """(employee, project, year, month, stack, value): mean dedication per
    cell under a stack label, aligned by month key (not by position)."""
    f = cell_means(forecast, ["employee", "project"], "dedication").withColumn("stack", F.lit(FORECAST_STACK))
    s = cell_means(spent, ["employee", "project"], "dedication").withColumn("stack", F.lit(SPENT_STACK))
    return f.unionByName(s)


def project_chart_series(cells: DataFrame) -> DataFrame:
    """Per project chart: one series per employee and stack."""
    return cells.select("year", "project", "month", F.col("employee").alias("series"), "stack", "value")


def employee_chart_series(cells: DataFrame) -> DataFrame:
    """Per employee chart: one series per project and stack."""
    return cells.select("year", "employee", "month", F.col("project").alias("series"), "stack", "value")


def chart_for(series: DataFrame, year: int, **item: str) -> DataFrame:
    """One chart: rows of a year and one project (or one employee)."""
    (col, val), = item.items()
    return series.filter((F.col("year") == year) & (F.col(col) == val))


def series_points(series: DataFrame, chart_keys: list[str]) -> DataFrame:
    """Chart-ready: one row per series with its points sorted by month.

    A series has at most twelve points (one per month), so collecting them
    per series is bounded.
    """
    return (series.groupBy(*chart_keys, "stack", "series")
            .agg(F.sort_array(F.collect_list(F.struct("month", "value"))).alias("data")))


def series_json(series: DataFrame, chart_keys: list[str]) -> DataFrame:
    """Series as JSON text ``{"name", "stack", "data": [[month, value], ...]}``;
    a missing value is JSON null."""
    pts = series_points(series, chart_keys)
    body = F.to_json(F.struct(F.col("series").alias("name"), F.col("stack"),
                              F.transform("data", lambda p: F.array(p["month"].cast("double"), p["value"]))
                              .alias("data")))
    return pts.select(*chart_keys, "stack", "series", body.alias("json"))


def stack_totals(cells: DataFrame, chart_key: str = "project") -> DataFrame:
    """Stack total per chart, stack and month (the tooltip total)."""
    return (cells.groupBy("year", chart_key, "stack", "month")
            .agg(F.sum("value").alias("stack_total")))


def forecast_vs_actual(forecast: DataFrame, spent: DataFrame) -> DataFrame:
    """Full outer join of the forecast and spent cells; missing side is 0."""
    f = cell_means(forecast, ["employee", "project"], "dedication", "forecast")
    s = cell_means(spent, ["employee", "project"], "dedication", "spent")
    j = f.join(s, _KEYS, "full_outer")
    return j.select(*_KEYS,
                    F.coalesce("forecast", F.lit(0.0)).alias("forecast"),
                    F.coalesce("spent", F.lit(0.0)).alias("spent"),
                    (F.coalesce("spent", F.lit(0.0)) - F.coalesce("forecast", F.lit(0.0))).alias("diff"))
