"""Deep pages of a listing, newest first, found by counting instead of sorting.

Page k of a sorted listing is a top-(k * n) in one task.  Here the order is taken as whole numbers (the
time in microseconds, then the id), counted in BINS ranges from the newest on; the range that holds the
page's first row is cut finer until it holds few rows.  A time that very many rows share is cut further by
id.  The page is then a top-k of those few rows and its own, among the rows from there on.  Each count is
one aggregate whose result has at most BINS rows, and every round divides the range by BINS.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config

#: Ranges of one count, and rows that are few enough to sort.
BINS, FEW = 1024, 10_000
#: Pages up to this many rows from the start are a plain top-k.
SHALLOW = 10_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone (not touched by the session's zone)."""
    seconds = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def _time(us: int) -> Column:
    return F.lit(dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)).cast("timestamp_ntz")


def _high(df: DataFrame, key: Column, within, before: int, first: int) -> tuple[int, int, int]:
    """A range of `key` that holds row `first` (0-based, by key descending; `before` rows come before df): its
    lowest and highest value, and the rows before it.  It has FEW rows at most, or a single value.
    `within(low, high)` is the filter of a range."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    while low < high:
        width = -(-(high - low + 1) // BINS)
        at = F.floor((F.lit(high) - key) / F.lit(width)).cast("long")  # 0 holds the newest
        counts = df.filter(within(low, high)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n")).orderBy("at").collect()
        for place, n in counts:
            if before + n > first:
                break
            before += n
        low, high = max(low, high - (place + 1) * width + 1), high - place * width
        if n <= FEW:
            break
    return low, high, before


def seek_page(df: DataFrame, page_no: int, per_page: int, ts_col: str = "timestamp", id_col: str = "id") -> DataFrame:
    """Rows of one page by (time desc, nulls last, id desc); page < 1 is page 1, and a page has at most
    API_PER_PAGE_MAX rows."""
    per = min(int(per_page), config.API_PER_PAGE_MAX)
    first = (max(int(page_no), 1) - 1) * per
    ts, own = F.col(ts_col), F.col(id_col)
    total, timed = df.agg(F.count(F.lit(1)), F.count(ts)).first()
    if first >= total:
        return df.limit(0)
    of_id = lambda low, high: own.between(low, high)
    if first >= timed:
        _, high, before = _high(df.filter(ts.isNull()), own, of_id, timed, first)
        rest = df.filter(ts.isNull() & (own <= high))
    else:
        low, high, before = _high(df.filter(ts.isNotNull()), micros(ts), lambda a, b: ts.between(_time(a), _time(b)), 0, first)
        rest = df.filter(ts.isNull() | (ts <= _time(high)))
        if low == high and first - before > FEW:
            _, last_id, before = _high(df.filter(ts == _time(high)), own, of_id, before, first)
            rest = df.filter(ts.isNull() | (ts < _time(high)) | ((ts == _time(high)) & (own <= last_id)))
    return rest.orderBy(ts.desc_nulls_last(), own.desc()).offset(first - before).limit(per)


def page_newest_first(df: DataFrame, page_no: int, per_page: int, ts_col: str = "timestamp", id_col: str = "id") -> DataFrame:
    """A page as a plain top-k near the start, and by seeking beyond SHALLOW rows."""
    per = min(int(per_page), config.API_PER_PAGE_MAX)
    before = (max(int(page_no), 1) - 1) * per
    if before + per > SHALLOW:
        return seek_page(df, page_no, per, ts_col, id_col)
    return df.orderBy(F.col(ts_col).desc_nulls_last(), F.col(id_col).desc()).offset(before).limit(per)
