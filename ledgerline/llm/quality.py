"""Text quality by regularised quadratic discriminant analysis.

A text gives statistics (lengths, shares of kinds of bytes and words, repetition, and the worst of its
windows of words, so that junk inside a long text counts), each transformed to run over the whole line:
logarithms of sizes, log-odds of shares. Each class has a mean and a covariance, shrunk towards the
covariance of both classes and towards its own diagonal. A score is the logistic function of the
difference of the two log densities (Mahalanobis distances by cached Cholesky factors, and
log-determinants) plus the log-odds of the classes.

Statistics are made once per text, on executors, and stored; class sums and products are added up over
all labelled rows that are not held out, as a tree of tasks. The driver sees two means and two matrices.

Defined results: a null, empty or wordless text has the statistics of no words and is scored like any
other; null labels, and labels other than 0 and 1, are not learned; a document with several labels is
learned with each; without labels every score is 0.5, with one class alone it is that class; repeated
rows get equal results; a null id is never learned and not held out; texts of any length are read
whole, one at a time beyond 4 MB; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow_text import joined, map_texts
from .common import doc_bucket
from .sums import tree_sum
from .wordhash import words

#: Weight of the pooled covariance in a class's, then of the diagonal in the result.
POOLED, DIAGONAL = 0.2, 0.05
#: Log density differences are taken at this part: statistics are not independent draws.
TEMPER = 0.25
THRESHOLD = 0.7
#: Words of a window.
WINDOW = 48
#: Rows that the labelled statistics are added up from at a time.
_ROWS = 8192

_SPACE, _LETTER, _UPPER, _DIGIT, _STOP, _MARK, _SYMBOL = (1 << k for k in range(7))
_KIND = np.full(256, _LETTER, np.uint8)  # bytes beyond ASCII are parts of letters
_KIND[:128] = _SYMBOL
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(ord("a"), ord("z") + 1)]] = _LETTER
_KIND[[*range(ord("A"), ord("Z") + 1)]] = _LETTER | _UPPER
_KIND[[*range(ord("0"), ord("9") + 1)]] = _DIGIT
_KIND[[*b".?"]] = _STOP
_KIND[[*b",;:'\"()-"]] = _MARK

#: Names of the statistics, in order.
STATISTICS = (
    "bytes", "words", "lines", "word_length", "word_spread", "longest_word", "entropy",
    "letters", "upper", "digits", "stops", "marks", "symbols", "spaces",
    "symbol_words", "letterless_words", "upper_words", "stop_words", "short_words", "distinct_words", "repeated_next",
    "commonest_word", "repeated_lines", "worst_symbols", "worst_upper", "worst_digits", "worst_repeats", "worst_letterless")


def _odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log-odds of part of whole, finite at both ends and for nothing at all."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values within each run between the n + 1 offsets `at`."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[at[1:]] - total[at[:-1]]


def _runs(flags: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Number of flags from each start to the next."""
    return np.add.reduceat(flags, start, dtype=np.int64).astype(float) if len(start) else np.zeros(0)


def _groups(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner 0..n-1: number of distinct keys, and how often the commonest occurs."""
    distinct, most = np.zeros(n), np.zeros(n)
    if len(owner):
        order = np.lexsort((key, owner))
        o, k = owner[order], key[order]
        start = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (k[1:] != k[:-1])))
        np.add.at(distinct, o[start], 1)
        np.maximum.at(most, o[start], np.diff(np.append(start, len(o))))
    return distinct, most


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """(texts, STATISTICS) of UTF-8 texts."""
    n = len(texts)
    data, at = joined([(t or b"") + b"\n" for t in texts])  # a text's last byte is no word's
    kind = _KIND[data]
    size = np.diff(at) - 1.0
    share = {name: _runs(kind & flag != 0, at[:-1]) for name, flag in
             (("letters", _LETTER), ("upper", _UPPER), ("digits", _DIGIT), ("stops", _STOP), ("marks", _MARK), ("symbols", _SYMBOL), ("spaces", _SPACE))}
    share["spaces"] -= 1
    ink = size - share["spaces"]

    start, end, key = words(data, kind & _SPACE == 0)
    owner = np.searchsorted(at, start, "right") - 1
    first = np.searchsorted(owner, np.arange(n + 1))  # word offsets of each text
    count = np.diff(first).astype(float)
    length = (end - start).astype(float)
    per_word = lambda flag: _runs(kind & flag != 0, start)  # noqa: E731  spaces after a word have no flag asked for
    in_letters, in_upper, in_digits, in_symbols = (per_word(f) for f in (_LETTER, _UPPER, _DIGIT, _SYMBOL))
    flags = {"symbol_words": in_symbols > 0, "letterless_words": in_letters == 0,
             "upper_words": (in_upper > 1) & (in_upper == in_letters), "short_words": length <= 3,
             "stop_words": kind[end - 1] == _STOP if len(end) else np.zeros(0, bool)}
    again = np.zeros(len(start), bool)
    if len(start):
        again[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    mean = _sums(length, first) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(_sums(length ** 2, first) / np.maximum(count, 1) - mean ** 2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    distinct, commonest = _groups(owner, key, n)

    line_start, line_end, line_key = words(data, data != 10)
    line_owner = np.searchsorted(at, line_start, "right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(float)
    distinct_lines, _ = _groups(line_owner, line_key, n)

    histogram = np.zeros((n, 256))
    for i in range(n):
        histogram[i] = np.bincount(data[at[i]:at[i + 1] - 1], minlength=256)
    p = histogram / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)

    # windows of WINDOW words of one text, the last of a text maybe shorter
    place = np.arange(len(start)) - first[owner] if len(start) else np.zeros(0, int)
    edge = np.append(np.flatnonzero(place % WINDOW == 0), len(start)) if len(start) else np.zeros(1, int)
    of = owner[edge[:-1]] if len(start) else np.zeros(0, int)
    inked = _sums(length, edge)
    worst = {"worst_symbols": _odds(_sums(in_symbols, edge), inked), "worst_upper": _odds(_sums(in_upper, edge), inked),
             "worst_digits": _odds(_sums(in_digits, edge), inked), "worst_letterless": _odds(_sums(in_letters == 0, edge), np.diff(edge))}
    window = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    kinds, _ = _groups(window, key, len(edge) - 1)
    worst["worst_repeats"] = _odds(np.diff(edge) - kinds, np.diff(edge))
    none = _odds(np.zeros(1), np.zeros(1))[0]

    out = np.empty((n, len(STATISTICS)))
    column = dict(zip(STATISTICS, out.T))
    column["bytes"][:], column["words"][:], column["lines"][:] = np.log1p(size), np.log1p(count), np.log1p(lines)
    column["word_length"][:], column["word_spread"][:] = np.log1p(mean), np.log1p(spread)
    column["longest_word"][:], column["entropy"][:] = np.log1p(longest), entropy
    for name in ("letters", "digits", "stops", "marks", "symbols"):
        column[name][:] = _odds(share[name], ink)
    column["upper"][:], column["spaces"][:] = _odds(share["upper"], share["letters"]), _odds(share["spaces"], size)
    for name, flag in flags.items():
        column[name][:] = _odds(_sums(flag, first), count)
    column["distinct_words"][:] = _odds(distinct, count)
    column["repeated_next"][:] = _odds(_sums(again, first), count)
    column["commonest_word"][:] = _odds(commonest, count)
    column["repeated_lines"][:] = _odds(lines - distinct_lines, lines)
    for name, value in worst.items():
        top = np.full(n, -np.inf)
        np.maximum.at(top, of, value)
        column[name][:] = np.where(np.isfinite(top), top, none)
    return out


class Discriminant:
    """Means, Cholesky factors and log-determinants of the two classes."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL):
        self.share = counts[1] / counts.sum() if counts.sum() else 0.5
        self.whole = bool((counts > 0).all())
        if not self.whole:
            return
        self.mean = sums / counts[:, None]
        scatter = products - counts[:, None, None] * self.mean[:, :, None] * self.mean[:, None, :]
        common = scatter.sum(0) / counts.sum()
        self.factor, self.log_det = [], []
        for own, n in zip(scatter, counts):
            cov = (1 - pooled) * own / n + pooled * common
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov))
            cov += np.diag(1e-6 + 1e-3 * np.diag(common))  # a statistic that never varies in a class
            self.factor.append(np.linalg.cholesky((cov + cov.T) / 2))
            self.log_det.append(2 * np.log(np.diag(self.factor[-1])).sum())
        self.odds = float(np.log(counts[1] / counts[0]))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.whole:
            return np.full(len(rows), float(self.share))
        density = [-0.5 * ((np.linalg.solve(f, (rows - m).T) ** 2).sum(0) + d) for m, f, d in zip(self.mean, self.factor, self.log_det)]
        return 1 / (1 + np.exp(-np.clip(TEMPER * (density[1] - density[0]) + self.odds, -60, 60)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the column `statistics` (array<double>) in place of the text."""
    def run(texts: list[bytes | None]) -> list[pa.Array]:
        found = statistics(texts)
        at = np.arange(0, found.size + 1, len(STATISTICS), dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(found.ravel()))]
    return map_texts(docs, text_col, run, "statistics array<double>")


def fit(labelled: DataFrame) -> Discriminant:
    """Model of rows (label 0 or 1, statistics)."""
    d = len(STATISTICS)
    size = 1 + d + d * d

    def make(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((2, size))
        label = batch.column(0).to_numpy()
        for lo in range(0, len(label), _ROWS):
            rows = _matrix(batch.column(1).slice(lo, _ROWS))
            for c in (0, 1):
                own = rows[label[lo:lo + _ROWS] == c]
                total[c] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        return total.ravel()

    found = tree_sum(labelled.select(F.col("label").cast("int"), "statistics"), make, 2 * size).reshape(2, size)
    return Discriminant(found[:, 0], found[:, 1:1 + d], found[:, 1 + d:].reshape(2, d, d))


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from: a quarter, by the id alone."""
    return doc_bucket(id_col, 4) == 2


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    rows = cut_lineage(with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
             .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    model = fit(cut_lineage(rows.join(known, "doc_id").select("label", "statistics")))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in batches:
            yield pa.array(model.scores(_matrix(found)) if len(found) else [], pa.float64())

    return (rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score("statistics").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
