"""Top n rows of every group, without a group ever meeting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group is first ranked in where n is beyond Spark's partial group limit.
PARTS = 64
#: Spark cuts groups to their first n rows before the shuffle only up to this n
#: (spark.sql.optimizer.windowGroupLimitThreshold).
PARTIAL_LIMIT = 1000


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, spread_by: str,
          rank: str = "rank") -> DataFrame:
    """Rows ranked 1..n (column ``rank``) within their group.

    Up to PARTIAL_LIMIT rows, Spark's partial group limit forwards at most n rows
    per group and map task.  Beyond it, a group is dealt into PARTS by the hash
    of ``spread_by`` and each part is ranked on its own first: the first n of a
    group are among the first n of its parts, so the last step meets PARTS * n
    rows of a group at most."""
    if n > PARTIAL_LIMIT:
        part = F.pmod(F.xxhash64(spread_by), F.lit(PARTS))
        in_part = Window.partitionBy(*group, "__part").orderBy(*order)
        df = (df.withColumn("__part", part).withColumn("__n", F.row_number().over(in_part))
              .filter(F.col("__n") <= n).drop("__part", "__n"))
    return (df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
            .filter(F.col(rank) <= n))
