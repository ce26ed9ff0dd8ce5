"""Audit log: newest rows per year, pages, sentences, retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars
from .seek import page_newest_first
from .topn import top_n


def newest_first() -> list:
    """timestamp desc (nulls last), id desc as tie-break."""
    return [F.col("timestamp").desc_nulls_last(), F.col("id").desc()]


def top_n_per_year(changelog: DataFrame, n: int = config.CHANGELOG_ROWS_PER_YEAR) -> DataFrame:
    """Newest ``n`` rows of every year (timestamp desc, id desc as tie-break).

    The few, huge year groups never reach one task whole (see :func:`topn.top_n`).
    """
    return top_n(changelog, ["year"], newest_first(), n, "id")


def year_top_n(changelog: DataFrame, year: int, n: int = config.CHANGELOG_ROWS_PER_YEAR) -> DataFrame:
    """Newest ``n`` rows of one year (a top-k: TakeOrderedAndProject)."""
    return changelog.filter(F.col("year") == year).orderBy(*newest_first()).limit(n)


def page(df: DataFrame, order: list, page_no: int, per_page: int) -> DataFrame:
    """Rows ``(page-1)*per_page`` .. of a total order (page < 1 is page 1)."""
    p = max(int(page_no), 1)
    return df.orderBy(*order).offset((p - 1) * per_page).limit(per_page)


def changelog_page(changelog: DataFrame, page_no: int,
                   per_page: int = config.CHANGELOG_PAGE_SIZE) -> DataFrame:
    """A page of the log, newest first; deep pages are sought (see :mod:`seek`)."""
    return page_newest_first(changelog, page_no, per_page)


def sentences(changelog: DataFrame) -> DataFrame:
    """(id, year, timestamp, sentence): each audit row as readable text."""
    return changelog.select("id", "year", "timestamp", scalars.change_sentence().alias("sentence"))


def text_filter(sentence_df: DataFrame, query: str) -> DataFrame:
    """Rows whose sentence contains the query text, case-insensitively."""
    return sentence_df.filter(F.lower(F.col("sentence")).contains(query.lower()))


def retention(changelog: DataFrame, as_of: dt.datetime,
              days: int = config.RETENTION_DAYS) -> DataFrame:
    """Rows kept by the retention run: timestamp null or not older than
    ``days`` before ``as_of`` (rows strictly older are deleted)."""
    cutoff = (as_of - dt.timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S")
    return changelog.filter(F.col("timestamp").isNull()
                            | (F.col("timestamp") >= F.lit(cutoff).cast("timestamp_ntz")))
