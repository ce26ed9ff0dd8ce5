"""Report bundles: every report for every year in one set of jobs.

The export of the planning application rebuilds each matrix per year and per
report; here the reports are computed once for all years and written
partitioned by year.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import iso_utc, title_case_names
from ..operators import changelog as chg, matrix, summary


def _in_years(df: DataFrame, years: DataFrame) -> DataFrame:
    """Rows whose year is one of ``years`` (a semi join; years are few)."""
    return df.join(years, "year", "left_semi")


def report_bundle(forecast: DataFrame, cost: DataFrame, spent: DataFrame,
                  changelog: DataFrame, top_n: int = config.CHANGELOG_ROWS_PER_YEAR,
                  materialize: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """changelog (newest n per year), personnel matrix, cost matrix, spent
    time matrix, project summary and employee summary -- all restricted to
    the years that have forecasts.

    The forecast cell means (employee, project, year, month) feed the matrix
    and both summaries; ``materialize`` (e.g. a reliable checkpoint) lets a
    writing job compute them once instead of once per report.
    """
    cells = matrix.cell_means(forecast, summary.CELL_KEYS, "dedication")
    if materialize is not None:
        cells = materialize(cells)
    # years with forecasts, read off the cell means (the same aggregation
    # exchange as the matrix and the summaries, so the forecast is not
    # scanned again for it)
    years = cells.select("year").distinct()
    return {
        "changelog": _in_years(chg.top_n_per_year(changelog, top_n), years),
        "personnel_forecasts": matrix.widen(cells, ["year", "employee", "project"]),
        "cost_forecasts": _in_years(matrix.cost_matrix(cost), years),
        "spent_time": _in_years(matrix.mean_matrix(spent, ["employee", "project"], "dedication"), years),
        "summary_projects": summary.summary_from_cells(cells, "project"),
        "summary_employees": summary.summary_from_cells(cells, "employee"),
    }


def profile_bundle(forecast: DataFrame, spent: DataFrame, cost: DataFrame, profile_map: DataFrame,
                   materialize: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Forecast and spent time by (project, profile), and the cost matrix,
    for the years that have forecasts (``materialize`` as in :func:`report_bundle`)."""
    cells = matrix.cell_means(forecast, summary.CELL_KEYS, "dedication")
    if materialize is not None:
        cells = materialize(cells)
    years = cells.select("year").distinct()
    return {
        "forecast_profile": summary.profile_matrix_from_cells(cells, profile_map),
        "spent_time_profile": _in_years(summary.profile_matrix(spent, profile_map), years),
        "costs": _in_years(matrix.cost_matrix(cost), years),
    }


#: What names a row of each report, beside its year.
ROW_KEYS = {
    "changelog": ["id"], "personnel_forecasts": ["employee", "project"], "cost_forecasts": ["project", "concept"],
    "spent_time": ["employee", "project"], "summary_projects": ["project"], "summary_employees": ["employee"],
    "forecast_profile": ["project", "profile"], "spent_time_profile": ["project", "profile"], "costs": ["project", "concept"],
}


def bundle_cells(reports: dict[str, DataFrame]) -> DataFrame:
    """Every cell of every sheet: (report, year, row_key, column, number, text), the column
    named as the sheet's header.  Numbers are in ``number``, texts in ``text``, times as ISO text."""
    parts = []
    for name, df in reports.items():
        keys = ROW_KEYS[name]
        cells = [f for f in df.schema.fields if f.name not in ("year", *keys)]
        titles = title_case_names([f.name for f in cells])
        text = lambda f: f.dataType.simpleString() == "string" or timed(f)
        timed = lambda f: f.dataType.simpleString().startswith("timestamp")
        shown = lambda f: iso_utc(F.col(f.name)) if timed(f) else F.col(f.name)
        stacked = F.explode(F.array(*[F.struct(
            F.lit(title).alias("column"),
            (F.lit(None) if text(f) else F.col(f.name)).cast("double").alias("number"),
            (shown(f) if text(f) else F.lit(None)).cast("string").alias("text")) for f, title in zip(cells, titles)]))
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        parts.append(df.select(F.lit(name).alias("report"), "year", key.alias("row_key"), stacked.alias("c"))
                     .select("report", "year", "row_key", "c.column", "c.number", "c.text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
