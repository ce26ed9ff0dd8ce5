"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word: a run of anything but ASCII white space (blank, tab, LF, VT, FF, CR).
SPACED_WORD = r"[^\x20\x09-\x0D]+"

#: Most rows of a key table that is broadcast; larger ones are joined through a shuffle.
BROADCAST_ROWS = 100_000


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII alone take the built-in ``lower``, which is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hash48(seed: int, *cols: Column) -> Column:
    """Seeded 48-bit number of the columns (nulls are skipped), the same in any SQL engine."""
    key = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long")


def text_key(text: Column) -> list[Column]:
    """Two columns that tell a row's text from another text under the same id."""
    return [F.xxhash64(text).alias("__text_hash"), F.octet_length(text).alias("__text_bytes")]


def whole_row(df: DataFrame) -> Column:
    """A row as one struct, so that its columns clash with no other, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def doc_bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join rows with a key table whose size is measured first: written once (checkpoint), it is
    broadcast up to BROADCAST_ROWS rows, and joined through a shuffle beyond that."""
    kept = cut_lineage(keys)
    side = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    cond = [rows[c].eqNullSafe(side[c]) for c in on]
    whole = cond[0]
    for c in cond[1:]:
        whole = whole & c
    joined = rows.join(side, whole, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[side[c] for c in on])


def slices(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) row ranges of at most `most` bytes each, or of one larger row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def empty_like(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(ddl))
