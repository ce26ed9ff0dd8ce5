"""Page envelope of a paginated listing (items, page, totals, links)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config


def page_items(df: DataFrame, order_cols: list[str], page_no: int, per_page: int) -> DataFrame:
    """Rows of the page in ascending ``order_cols``; page < 1 is page 1."""
    per = min(int(per_page), config.API_PER_PAGE_MAX)
    p = max(int(page_no), 1)
    return df.orderBy(*order_cols).offset((p - 1) * per).limit(per)


def page_envelope(df: DataFrame, order_cols: list[str], page_no: int,
                  per_page: int = config.API_PER_PAGE_DEFAULT, id_col: str = "id") -> DataFrame:
    """One row: page (as asked), per_page (capped at 100), total_items,
    total_pages, has_next, has_prev, n_items, first_id, last_id.

    The total is a count aggregate used as a scalar subquery; the page is a
    bounded top-k summarised in one row.
    """
    per = min(int(per_page), config.API_PER_PAGE_MAX)
    p_eff = max(int(page_no), 1)
    items = page_items(df, order_cols, page_no, per)
    key = F.struct(*[F.col(c) for c in order_cols])
    total = df.agg(F.count(F.lit(1))).scalar()
    env = items.agg(F.count(F.lit(1)).alias("n_items"),
                    F.min_by(id_col, key).alias("first_id"),
                    F.max_by(id_col, key).alias("last_id")).withColumn("total_items", total)
    pages = F.when(F.col("total_items") == 0, F.lit(0)).otherwise(
        F.ceil(F.col("total_items") / F.lit(per))).cast("long")
    return env.select(F.lit(int(page_no)).alias("page"), F.lit(per).alias("per_page"),
                      "total_items", pages.alias("total_pages"),
                      (F.lit(p_eff) < pages).alias("has_next"),
                      (F.lit(p_eff) > 1).alias("has_prev"),
                      "n_items", "first_id", "last_id")
