"""Arrow helpers of the text operators that run Python on executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task works on at once (a longer single text is worked on alone).
CHUNK_BYTES = 4 << 20


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[list[bytes | None]]:
    """The texts in order, as UTF-8, at most `most` bytes (or one text) at a time; null stays None."""
    held: list[bytes | None] = []
    total = 0
    for t in texts.cast(pa.large_binary()):
        b = t.as_py()
        n = len(b) if b else 0
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(b)
        total += n
    if held:
        yield held


def text_udf(fn: Callable[[list[bytes | None]], pa.Array], kind, prepare: Callable | None = None):
    """Column function over a string column: fn gets chunks of texts as UTF-8 and returns an array of
    `kind`. With `prepare`, fn gets its result (made once per task) as a second argument."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = (prepare(),) if prepare else ()
        for texts in batches:
            parts = [fn(part, *own) for part in chunks(texts)]
            yield pa.concat_arrays(parts) if parts else fn([], *own)

    return run


def map_texts(df: DataFrame, text_col: str, fn: Callable[..., list[pa.Array]], fields: str,
              prepare: Callable | None = None, keep_text: bool = False) -> DataFrame:
    """df with new columns (DDL `fields`) made from a string column, which is left out unless keep_text.

    fn gets chunks of texts as UTF-8 and returns an array for each field; with `prepare`, its result
    (made once per task) as a second argument. Rows stream through Python, so nothing waits on disk."""
    at = df.columns.index(text_col)
    kept = [f for i, f in enumerate(df.schema.fields) if keep_text or i != at]
    schema = T.StructType(kept + T._parse_datatype_string(fields).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (prepare(),) if prepare else ()
        for batch in batches:
            done = 0
            for texts in chunks(batch.column(at)):
                part = batch.slice(done, len(texts))
                done += len(texts)
                old = [c for i, c in enumerate(part.columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays(old + fn(texts, *own), names=schema.names)

    return df.mapInArrow(run, schema)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the n + 1 offsets of the texts in it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(sizes)))
