"""Grouping of spelling variants by blocked Gram matrices of letter counts.

Words are counted over whole texts. A word's letter counts tell most words apart: one inserted or
deleted letter changes the squared distance of the counts to 1, one replaced letter to 2. Words of one
length lie in blocks, and the distances of all pairs of two blocks are one matrix product; pairs at
most two apart are verified letter by letter. A word is grouped under its nearest frequent variant
(its form), and forms are followed to their root.

Only blocks that can hold near words meet: letters are dealt into groups of about equal frequency, and
an edit changes a word's counts per group (its cell) by one in one or two groups. Words are sorted by
length and cell before they are cut into blocks, and a block is compared with those that hold a cell
next to one of its own. More words are given more groups, so a word is compared with a bounded number
of others however many there are; the result is the same with any number of groups or block size.

Defined results: a null text has no words, a null id counts as the empty text; a run of letters is
counted wherever it stands, in texts of any length; repeated rows count again; of equally frequent near
words the first in code-point order is the form; forms are at least `ratio` times as frequent, so no
chain of forms returns; a word without near words has n_near 0 and is its own root; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow_text import chunks

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: One in so many occurrences of a word loses a letter (0: none).
MISSPELT = 97
#: Words of a block, and letters of it (a longer word is a block of its own).
BLOCK, BLOCK_LETTERS = 1024, 1 << 20
#: Words that a cell should hold, on average of those in use.
CELL = 512
MOST_GROUPS = 8
BLOCKS_PER_TASK = 8
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 1 << 18

# The letters of a word, A-Z lower-cased, in code-point order.
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_CODE = np.zeros(256, np.uint8)
_CODE[LETTERS] = np.arange(len(LETTERS))
_LETTER = np.array(LETTERS, np.uint8)


# ---- counting --------------------------------------------------------------------------------

def _runs(text: bytes) -> Counter:
    """Runs of letters of a UTF-8 text, A-Z lower-cased, with their counts."""
    whole = text.lower().decode(errors="replace")  # lower() of bytes: A-Z only
    if len(whole) < 1 << 20:
        return Counter(_RUN.findall(whole))
    return Counter(m.group() for m in _RUN.finditer(whole))


def _misspelt(run: str, doc_id: str, every: int) -> str:
    """The run as this document spells it."""
    if every:
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % every == 0:
            at = h % len(run)
            return run[:at] + run[at + 1:]
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, misspelt: int = MISSPELT) -> DataFrame:
    """(word, n): words of at least min_length letters that occur at least min_count times in all texts.

    A task adds up its own words first, so a frequent word is one row per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = (t for part in chunks(batch.column(1)) for t in part)
            for doc_id, text in zip(ids, texts):
                for word, n in _runs(text or b"").items():
                    if len(word) >= min_length:
                        word = _misspelt(word, doc_id or "", misspelt)
                        if len(word) >= min_length:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---- blocks ----------------------------------------------------------------------------------

def _letters_of(words: list[str]) -> np.ndarray:
    """Letter numbers of words, one after the other."""
    return _CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]


def _text_of(codes: np.ndarray) -> list[str]:
    """Words of a (words, length) matrix of letter numbers."""
    raw = _LETTER[codes]
    return [row.tobytes().decode("latin-1") for row in raw]


def _tally(codes: np.ndarray, n_columns: int) -> np.ndarray:
    """(words, columns) counts of the numbers in each row."""
    m = len(codes)
    at = codes.astype(np.int64) + np.arange(m)[:, None] * n_columns
    return np.bincount(at.ravel(), minlength=m * n_columns).reshape(m, n_columns)


def letter_groups(words: DataFrame, n_groups: int) -> np.ndarray:
    """Group of each letter; groups hold about the same number of letters of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(LETTERS), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                total += np.bincount(_letters_of(batch.column(0).slice(lo, BLOCK).to_pylist()), minlength=len(LETTERS))
        yield pa.record_batch([pa.array(range(len(LETTERS)), pa.int32()), pa.array(total)], ["letter", "n"])
    found = words.select("word").mapInArrow(run, "letter int, n bigint").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    seen = {r.letter: r.n for r in found}
    load, group = [0] * n_groups, np.zeros(len(LETTERS), np.int64)
    for letter in sorted(range(len(LETTERS)), key=lambda x: (-seen.get(x, 0), x)):
        group[letter] = load.index(min(load))
        load[group[letter]] += seen.get(letter, 0)
    return group


def groups_for(n_words: int) -> int:
    """Letter groups so that a cell in use holds about CELL words: most words have one of a few lengths near
    10, and 10 letters fall into k groups in C(9 + k, k - 1) ways, of which about a third are common."""
    cells, k = 1.0, 1
    while k < MOST_GROUPS and n_words / (4 * cells / 3) > CELL:
        k += 1
        cells *= (9 + k - 1) / (k - 1)
    return max(2, k)


_BLOCKS = "len int, codes binary, counts binary, cells array<array<int>>"


def blocks(words: DataFrame, group: np.ndarray, k: int, size: int = BLOCK) -> DataFrame:
    """Words in blocks (id, len, codes, counts, cells): at most `size` words of one length, in order of their cell;
    codes are their letter numbers, counts how often they occur, cells the distinct cells (counts of k groups)."""
    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                ws = part.column(0).to_pylist()
                sizes = np.fromiter(map(len, ws), np.int64, len(ws))
                row = np.repeat(np.arange(len(ws)), sizes)
                cell = np.bincount(row * k + group[_letters_of(ws)], minlength=len(ws) * k).astype(np.int32)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(sizes.astype(np.int32)),
                                       pa.ListArray.from_arrays(pa.array(np.arange(0, len(cell) + 1, k, dtype=np.int32)), pa.array(cell))],
                                      ["word", "n", "len", "cell"])

    def block(held: list[tuple]) -> pa.RecordBatch:
        held.sort()  # in code-point order, so that of two words the first has the smaller place
        cells = sorted({h[2] for h in held})
        return pa.record_batch([
            pa.array([len(held[0][0])], pa.int32()), pa.array([_letters_of([h[0] for h in held]).tobytes()], pa.binary()),
            pa.array([np.array([h[1] for h in held], np.int64).tobytes()], pa.binary()),
            pa.array([[list(c) for c in cells]], pa.list_(pa.list_(pa.int32())))], ["len", "codes", "counts", "cells"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for word, n, length, cell in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held[0][0]) != length or len(held) >= size or (len(held) + 1) * length > BLOCK_LETTERS):
                    yield block(held)
                    held = []
                held.append((word, n, tuple(cell)))
        if held:
            yield block(held)

    celled = words.select("word", "n").mapInArrow(cells_of, "word string, n bigint, len int, cell array<int>")
    order = ["len", "cell", "word"]
    cutted = celled.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _BLOCKS)
    return cut_lineage(cut_lineage(cutted).withColumn("id", F.monotonically_increasing_id()))


def block_pairs(made: DataFrame, k: int) -> DataFrame:
    """(a, b): distinct pairs of blocks that can hold near words; b is of a's length or one longer."""
    cells = made.select("id", "len", F.explode("cells").alias("cell"))
    key = lambda more, up=None, down=None: F.xxhash64(F.col("len") + more, *[
        F.col("cell")[g] + (1 if g == up else -1 if g == down else 0) for g in range(k)])
    own = cells.select(F.col("id").alias("b"), key(0).alias("key"))
    same = [key(0)] + [key(0, i, j) for i, j in itertools.combinations(range(k), 2)]
    longer = [key(1, g) for g in range(k)]
    asked = cells.select(F.col("id").alias("a"), F.explode(F.array(
        *[F.struct(F.lit(True).alias("same"), x.alias("key")) for x in same],
        *[F.struct(F.lit(False).alias("same"), x.alias("key")) for x in longer])).alias("x"))
    met = asked.select("a", "x.same", "x.key").join(own, "key")
    first = F.when(F.col("same"), F.least("a", "b")).otherwise(F.col("a"))
    second = F.when(F.col("same"), F.greatest("a", "b")).otherwise(F.col("b"))
    return met.select(first.alias("a"), second.alias("b")).filter("a <> b").distinct()


# ---- comparison ------------------------------------------------------------------------------

def _products(codes: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter counts of a block in the letters used, and each row's squared length, in a type that holds all
    products of them exactly."""
    length = codes.shape[1]
    kind = np.float32 if length < 1 << 11 else np.float64 if length < 1 << 25 else np.int64
    a = _tally(codes, len(LETTERS))[:, used].astype(kind)
    return a, (a * a).sum(1)


def near_pairs(a: np.ndarray, b: np.ndarray, same_block: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the words of two blocks (letter numbers; b's of a's length or one longer) that are
    one edit apart; within one block, i < j."""
    used = np.unique(np.concatenate((np.unique(a), np.unique(b))))
    x, xx = _products(a, used)
    y, yy = _products(b, used)
    y = np.concatenate((-2 * y, np.ones((len(y), 1), y.dtype), yy[:, None]), 1).T
    equal = a.shape[1] == b.shape[1]
    out = []
    step = max(1, (1 << 20) // max(1, len(b)))
    for lo in range(0, len(a), step):
        part = np.concatenate((x[lo:lo + step], xx[lo:lo + step, None], np.ones((len(x[lo:lo + step]), 1), x.dtype)), 1)
        distance = part @ y
        i, j = np.divmod(np.flatnonzero((distance if equal else distance - 1).ravel() <= (2 if equal else 0)), len(b))
        i += lo
        if same_block:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), max(1, (1 << 22) // a.shape[1])):
            p, q = i[at:at + max(1, (1 << 22) // a.shape[1])], j[at:at + max(1, (1 << 22) // a.shape[1])]
            u, v = a[p], b[q]
            if equal:
                good = (u != v).sum(1) == 1
            else:
                head = np.cumprod(u == v[:, :-1], axis=1, dtype=np.int8).sum(1)
                tail = np.cumprod((u == v[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(1)
                good = head + tail >= u.shape[1]
            out.append((p[good], q[good]))
    return (np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])) if out else (np.empty(0, int),) * 2


class _Block:
    def __init__(self, length: int, codes: bytes, counts: bytes):
        self.n = np.frombuffer(counts, np.int64)
        self.codes = np.frombuffer(codes, np.uint8).reshape(len(self.n), length)


def _best(own: _Block, at: np.ndarray, other: _Block, near: np.ndarray) -> pa.RecordBatch | None:
    """Per word of a block with near words in another: how many, and the best of them (largest n, then the first)."""
    if not len(at):
        return None
    order = np.lexsort((near, -other.n[near], at))
    at, near = at[order], near[order]
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    count = np.diff(np.append(start, len(at)))
    best = near[start]
    return pa.record_batch([pa.array(_text_of(own.codes[at[start]])), pa.array(own.n[at[start]]), pa.array(count),
                            pa.array(_text_of(other.codes[best])), pa.array(other.n[best])], ["word", "n", "n_near", "near", "near_n"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, b), the block itself (b null) before its partners."""
    now, key = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            a, own, length, codes, counts = (c[i].as_py() for c in batch.columns)
            block = _Block(length, codes, counts)
            if own:
                now, key = block, a
            elif a != key:
                raise ValueError("a block's partners follow it")
            p, q = near_pairs(now.codes, block.codes, own)
            both = [(p, q)] if not own else [(np.concatenate((p, q)), np.concatenate((q, p)))]
            yield from filter(None, [_best(now, x, block, y) for x, y in both])
            if not own:
                yield from filter(None, [_best(block, q, now, p)])


def links(made: DataFrame, k: int) -> DataFrame:
    """(word, n_near, form, form_n) of the words with near words; form is the best near word."""
    body = ["len", "codes", "counts"]
    pairs = block_pairs(made, k).join(made.select(F.col("id").alias("b"), *body), "b")
    rows = made.select(F.col("id").alias("a"), F.lit(True).alias("own"), *body).unionByName(
        pairs.select("a", F.lit(False).alias("own"), *body))
    # explicit number of tasks: few bytes are much work here, and few bytes are what AQE would merge
    tasks = -(-made.count() // BLOCKS_PER_TASK) or 1
    found = (rows.repartition(tasks, "a").sortWithinPartitions("a", F.col("own").desc())
             .mapInArrow(_compare, "word string, n bigint, n_near bigint, near string, near_n bigint"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms are followed, each round twice as far. A round
    joins only the words whose place is not a root yet; a chain doubles n at every step, so it is short."""
    way = cut_lineage(forms.select("word", F.col("form").alias("at"), F.lit(False).alias("done")))
    while True:
        step = way.select(F.col("word").alias("at"), F.col("at").alias("to"), F.col("done").alias("whole"))
        left = way.filter(~F.col("done")).join(step, "at", "left").select(
            "word", F.coalesce("to", "at").alias("at"), (F.col("to").isNull() | F.col("whole")).alias("done"))
        way = cut_lineage(way.filter("done").unionByName(left))
        if way.filter(~F.col("done")).isEmpty():
            return way.select("word", F.col("at").alias("root"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                   min_count: int = MIN_COUNT, ratio: int = RATIO, misspelt: int = MISSPELT, groups: int | None = None,
                   size: int = BLOCK) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = cut_lineage(word_counts(docs, id_col, text_col, min_length, min_count, misspelt))
    k = groups or groups_for(words.count())
    made = blocks(words, letter_groups(words, k), k, size)
    known = F.col("form_n") >= ratio * F.col("n")
    told = cut_lineage(words.join(links(made, k), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(known, F.col("form")).alias("form"), F.when(known, F.col("form_n")).alias("form_n")))
    roots = _rooted(told.filter(F.col("form").isNotNull()).select("word", "form"))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
