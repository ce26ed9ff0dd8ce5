"""Language-model scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts of up to MAX_ORDER bytes with the counts of the bytes that
followed them in the training texts. A byte is coded in the longest context seen; a context that
lacks it escapes to the next shorter one. Escapes are estimated by method C (the context's distinct
symbols over its count plus these), and the symbols of the contexts escaped from are excluded. A
document's score is the log10 probability of its bytes and one end symbol, its pretrained code
length; the word-unigram base score comes with it.

On Spark: the order is MAX_ORDER at every size. Documents are dealt into chunks of about CHUNK_TEXT
bytes. Each chunk's distinct n-grams are added up by n-gram; the distinct ones of all chunks are dealt
out by the last SHARED + 1 symbols of their context, so that a part holds all its longer contexts, makes
its own part of the trie and gives each n-gram its probability; these go back to the chunks by joins. Only
the trie of order SHARED is broadcast (n-grams of SHARED + 1 bytes: bounded whatever the corpus). Words
go the same way: each chunk's distinct words get their corpus counts in one shuffle by word, and the
chunk's documents meet both when they are scored. Words go by a 64-bit hash: among V distinct words, two
share one with a chance of about V * V / 2^65 (5 million words: one in a million).

Defined results: a null text is the empty text, which is its end alone; with nothing to learn from,
every symbol is equally likely; a null id counts as the empty text where documents are held out;
repeated rows get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow_text import chunks, joined
from .common import doc_bucket
from .wordhash import words

MAX_ORDER = 5
#: Order of the trie that every task holds.
SHARED = 2
#: Entries of a trie that is made in one piece, and n-grams that a counting task holds at once.
MAX_NODES = 4_000_000
#: Keys that a chunk's task holds before equal ones are added up (or half as many again as the distinct ones).
MAX_HELD = 1_000_000
#: Keys that are sorted, added up or put into an index at once.
WORK_KEYS = 1 << 17
CHUNK_TEXT = 16 << 20
#: Least number of parts of the trie, and parts for each chunk.
PARTS, CHUNK_PARTS = 256, 4
#: Bytes of text worked on at once; a symbol takes 8 bytes in each of the arrays made of it.
WORK_BYTES = 1 << 18

END, BEFORE, SYMBOLS = 256, 257, 257  # the end is a symbol; what stands before a text only a context
_BITS = np.uint64(9)


def normalised(text: bytes | None) -> bytes:
    return (text or b"").lower()  # of bytes: A-Z only


def _mask(symbols: int) -> np.uint64:
    return np.uint64((1 << 9 * symbols) - 1)


def ngram_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts): for each symbol of each text, its end included, the symbol (lowest bits) and the
    `order` symbols before it; and the number of symbols of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + order + 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    data = np.full(at[-1], BEFORE, np.uint64)
    for t, a in zip(texts, at):
        data[a + order:a + order + len(t)] = np.frombuffer(t, np.uint8)
    data[at[1:] - 1] = END
    key = data.copy()
    for k in range(1, order + 1):
        key[k:] |= data[:-k] << np.uint64(9 * k)
    own = np.ones(len(data), bool)
    own[(at[:-1, None] + np.arange(order)).ravel()] = False
    return key[own], sizes - order


class _Index:
    """Places of keys: an open-addressing hash table, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.wrap = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.places = np.full(1 << bits, -1, np.int32)
        for a in range(0, len(keys), WORK_KEYS):
            left = np.arange(a, min(a + WORK_KEYS, len(keys)))
            slot = self._slot(keys[left])
            while len(left):
                free = self.places[slot] < 0
                _, first = np.unique(slot[free], return_index=True)
                won = np.flatnonzero(free)[first]
                self.keys[slot[won]], self.places[slot[won]] = keys[left[won]], left[won]
                rest = np.ones(len(left), bool)
                rest[won] = False
                left, slot = left[rest], (slot[rest] + 1) & self.wrap

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        slot = self._slot(keys)
        out = self.places[slot]
        miss = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[miss]
        while len(miss):
            slot = (slot + 1) & self.wrap
            got = self.places[slot]
            out[miss] = got
            on = (got >= 0) & (self.keys[slot] != keys[miss])
            miss, slot = miss[on], slot[on]
        return out


def _log10(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-30)).astype(np.float32)


class Trie:
    """Trie of the n-grams (sorted keys of order + 1 symbols, counts), ready for scoring.

    With `base`, the trie of all n-grams of a lower order, the keys may be a part of all n-grams: all
    those whose contexts end with certain base.order + 1 symbols. It then scores keys of such contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, base: Trie | None = None):
        self.order = order
        entry_keys, entry_counts = [None] * (order + 1), [None] * (order + 1)
        entry_keys[order], entry_counts[order] = keys.astype(np.uint64), counts.astype(np.int64)
        lowest = base.order + 1 if base else 0
        for j in range(order - 1, lowest - 1, -1):
            low, where = np.unique(entry_keys[j + 1] & _mask(j + 1), return_inverse=True)
            entry_keys[j], entry_counts[j] = low, np.bincount(where, entry_counts[j + 1], len(low)).astype(np.int64)
        of_base = (lambda name: list(getattr(base, name))) if base else (lambda name: [])
        self.entries, self.log_count, self.alone = map(of_base, ("entries", "log_count", "alone"))
        self.contexts, self.escape, self.after_total, self.after_escape = map(of_base, ("contexts", "escape", "after_total", "after_escape"))
        total = distinct = None
        if base:
            self.unseen = base.unseen
            entry_keys[base.order], entry_counts[base.order], total, distinct, shorter_contexts = base.last
        for j in range(lowest, order + 1):
            k, c = entry_keys[j], entry_counts[j]
            context, owner = np.unique(k >> _BITS, return_inverse=True)
            n, d = np.bincount(owner, c, len(context)).astype(np.int64), np.bincount(owner, minlength=len(context))
            self.entries.append(_Index(k))
            self.log_count.append(_log10(c))
            self.alone.append(_log10(c) - _log10((n + d)[owner]))
            self.contexts.append(_Index(context))
            self.escape.append(_log10(d) - _log10(n + d))
            if j == 0:
                self.after_total.append(None)
                self.after_escape.append(None)
                self.unseen = float(-np.log10(max(1, SYMBOLS - len(k))))
            else:  # what is left of the shorter context once this one's symbols are excluded
                seen = np.bincount(owner, entry_counts[j - 1][np.searchsorted(entry_keys[j - 1], k & _mask(j))], len(context)).astype(np.int64)
                shorter = np.searchsorted(shorter_contexts, context & _mask(j - 1) if j > 1 else context * np.uint64(0))
                n_left, d_left = total[shorter] - seen, distinct[shorter] - d
                self.after_total.append(_log10(n_left + d_left))
                self.after_escape.append(np.where(d_left > 0, _log10(d_left) - _log10(n_left + d_left), 0.0))
            total, distinct, shorter_contexts = n, d, context
        self.last = entry_keys[order], entry_counts[order], total, distinct, shorter_contexts

    def log10_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of each symbol in its context; keys as by ngram_keys of the same order."""
        top = self.order
        got = self.entries[top].find(keys)
        out = self.alone[top][got] if len(self.alone[top]) else np.zeros(len(keys))
        left = np.flatnonzero(got < 0)
        key, spent, by = keys[left], np.zeros(len(left)), np.full(len(left), -1)
        for j in range(top, -1, -1):
            part = key & _mask(j + 1)
            if j < top:
                got = self.entries[j].find(part)
                hit = np.flatnonzero(got >= 0)
                from_longer = by[hit] >= 0
                value = self.alone[j][got[hit]] if len(hit) else np.zeros(0)
                if from_longer.any():
                    value[from_longer] = self.log_count[j][got[hit[from_longer]]] - self.after_total[j + 1][by[hit[from_longer]]]
                out[left[hit]] = spent[hit] + value
                rest = got < 0
                left, key, spent, by, part = left[rest], key[rest], spent[rest], by[rest], part[rest]
            if not len(left):
                return out
            node = self.contexts[j].find(part >> _BITS)
            longer = by >= 0
            if longer.any():
                spent[longer] += self.after_escape[j + 1][by[longer]]
            begin = np.flatnonzero(~longer & (node >= 0))
            if len(begin):
                spent[begin] += self.escape[j][node[begin]]
            by = node
        out[left] = spent + self.unseen
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text (normalised bytes) and its end."""
        if not texts:
            return np.zeros(0)
        keys, sizes = ngram_keys(texts, self.order)
        return np.add.reduceat(self.log10_probabilities(keys), np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.float64)


# ---- on Spark -------------------------------------------------------------------------------

def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each key of the pieces (sorted keys, counts) with the sum of its counts, as pieces in ascending order.

    A range of keys is added up at a time, of at most 2 * WORK_KEYS keys, or one from each piece."""
    step = max(1, WORK_KEYS // len(held))
    # between two of all these, a piece has fewer than `step` keys; every len(held)-th of them ends a range
    cuts = np.unique(np.sort(np.concatenate([k[step - 1::step] for k, _ in held]))[len(held) - 1::len(held)])
    ends = [np.concatenate(([0], np.searchsorted(k, cuts), [len(k)])) for k, _ in held]
    for i in range(len(cuts) + 1):
        parts = [(k[e[i]:e[i + 1]], c[e[i]:e[i + 1]]) for (k, c), e in zip(held, ends) if e[i] < e[i + 1]]
        if parts:
            low, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            yield low, np.bincount(where, np.concatenate([c for _, c in parts]), len(low)).astype(np.int64)


def _held(pieces: list[tuple[np.ndarray, np.ndarray]]) -> int:
    return sum(len(k) for k, _ in pieces)


def _count_ngrams(order: int):
    """mapInArrow function: n-grams in a task's texts, each with its count as often as memory allows."""
    kind = np.uint64 if order > 2 else np.uint32  # short keys sort faster

    def rows(held):
        for keys, counts in held:
            for a in range(0, len(keys), 1 << 16):
                yield pa.record_batch([pa.array(keys[a:a + (1 << 16)].astype(np.int64)), pa.array(counts[a:a + (1 << 16)])], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for texts in chunks(batch.column(0), WORK_BYTES):
                held.append(np.unique(ngram_keys([normalised(t) for t in texts], order)[0].astype(kind), return_counts=True))
                size += len(held[-1][0])
                if size > MAX_NODES:
                    held = list(_added(held))
                    size = _held(held)
                    if size > MAX_NODES // 2:
                        yield from rows(held)
                        held, size = [], 0
        if held:
            yield from rows(_added(held))
    return run


def _trie(table: pa.Table, order: int, base: Trie | None = None) -> Trie:
    """Trie of the rows (key, n); those without a count are not learned."""
    keys, counts = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    at = np.argsort(keys)
    at = at[counts[at] > 0]
    return Trie(keys[at], counts[at], order, base)


def learn_shared(texts: DataFrame) -> Trie:
    """Trie of order SHARED of all texts of a one-column DataFrame."""
    return _trie(texts.mapInArrow(_count_ngrams(SHARED), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow(), SHARED)


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from: a fifth, by the id alone."""
    return doc_bucket(id_col, 5) == 1


def _hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of normalised texts laid end to end, and the number of words of each."""
    data, at = joined([t + b" " for t in texts])
    start, _, hashes = words(data, ~_BLANK[data])
    return hashes, np.diff(np.searchsorted(start, at))


#: ASCII white space by byte.
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _chunk_counts(keys_of):
    """mapInArrow function: distinct keys of each chunk in a task, with their count in its training texts.

    Rows are (doc_id, held_out, text, chunk), sorted by chunk; keys_of gives the keys of normalised texts
    and the number of keys of each."""
    def rows(held, chunk):
        for low, counts in _added(held):
            for a in range(0, len(low), 1 << 16):
                part = low[a:a + (1 << 16)]
                yield pa.record_batch([pa.array(np.full(len(part), chunk)), pa.array(part.view(np.int64)), pa.array(counts[a:a + (1 << 16)])],
                                      ["chunk", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, size, most = None, 0, MAX_HELD
        for batch in batches:
            chunk = batch.column(3).to_numpy()
            train = ~batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if held and chunk[lo] != now:
                    yield from rows(held, now)
                    held, size, most = [], 0, MAX_HELD
                now, done = int(chunk[lo]), int(lo)
                for texts in chunks(batch.column(2).slice(lo, hi - lo), WORK_BYTES):
                    keys, sizes = keys_of([normalised(t) for t in texts])
                    seen = np.repeat(train[done:done + len(texts)], sizes)
                    done += len(texts)
                    low, n = np.unique(keys[seen], return_counts=True)
                    held.append((low, n.astype(np.int64)))
                    low = np.unique(keys[~seen])
                    held.append((low, np.zeros(len(low), np.int64)))
                    size += len(held[-2][0]) + len(low)
                    if size > most:  # however many distinct keys the texts have
                        held = list(_added(held))
                        size = _held(held)
                        most = max(MAX_HELD, size + size // 2)
        if held:
            yield from rows(held, now)
    return run


def _probabilities(base):
    """Function of a part of all distinct n-grams (key, n in training texts) -> (key, log10 probability)."""
    def run(part: pa.Table) -> pa.Table:
        got = _trie(part, MAX_ORDER, base.value).log10_probabilities(part["key"].to_numpy().view(np.uint64))
        return pa.table([part["key"], pa.array(got.astype(np.float32))], names=["key", "value"])
    return run


_SCORED = "doc_id bigint, held_out boolean, n_words bigint, n_known bigint, log_counts double, score double, kinds bigint"


def _score(docs: pa.Table, counted: pa.Table) -> pa.Table:
    """Cogroup function: a chunk's documents and its counted words and n-grams -> scored documents, and one
    row with the number of distinct training words that are counted with this chunk. The value of an n-gram
    is its log10 probability, that of a word its count c, or -1 - c where it is counted with this chunk."""
    is_word = counted["is_word"].to_numpy()
    keys, values = counted["key"].to_numpy().view(np.uint64), counted["value"].to_numpy()
    grams, gram_values = _Index(keys[~is_word]), values[~is_word]
    keys, count = keys[is_word], values[is_word]
    del values, is_word, counted
    order = np.argsort(keys)
    keys, count = keys[order], count[order].astype(np.int64)
    kinds = int((count < -1).sum())
    count = np.where(count < 0, -1 - count, count)
    log_count, known = np.log10(count + 0.5), (count > 0).astype(np.int64)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for part in docs["text"].chunks:
        for texts in chunks(part, WORK_BYTES):
            own = [normalised(t) for t in texts]
            hashes, sizes = _hashed_words(own)
            at = np.searchsorted(keys, hashes)
            doc = np.repeat(np.arange(len(own)), sizes)
            out[0].append(sizes)
            out[1].append(np.bincount(doc, known[at], len(own)).astype(np.int64))
            out[2].append(np.bincount(doc, log_count[at], len(own)))
            symbols, lengths = ngram_keys(own, MAX_ORDER)
            at = grams.find(symbols)
            if (at < 0).any():
                raise ValueError("an n-gram of the chunk has no probability")
            out[3].append(np.add.reduceat(gram_values[at], np.concatenate(([0], np.cumsum(lengths)[:-1]))))
    n = docs.num_rows
    whole = [np.concatenate(x) if x else np.zeros(0) for x in out]
    last = [pa.array([None], pa.int64()), pa.array([None], pa.bool_()), *[pa.array([None], pa.int64())] * 2,
            *[pa.array([None], pa.float64())] * 2, pa.array([kinds], pa.int64())]
    rows = [docs["doc_id"], docs["held_out"], pa.array(whole[0].astype(np.int64)), pa.array(whole[1].astype(np.int64)),
            pa.array(whole[2], pa.float64()), pa.array(whole[3], pa.float64()), pa.nulls(n, pa.int64())]
    names = [x.split()[0] for x in _SCORED.split(", ")]
    return pa.concat_tables([pa.table(rows, names=names), pa.table(last, names=names)])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    base = spark.sparkContext.broadcast(learn_shared(rows.filter("not held_out").select("text")))
    sums = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    parts = max(1, -(-sums[0] // CHUNK_TEXT))
    # all sides take all columns of the dealt documents, so the texts are shuffled once
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(parts)).cast("long")).repartition("chunk")
    sorted_docs = dealt.sortWithinPartitions("chunk")
    by_word = W.partitionBy("key")
    counted = (sorted_docs.mapInArrow(_chunk_counts(_hashed_words), "chunk bigint, key bigint, n bigint")
               .withColumns({"c": F.sum("n").over(by_word), "first": F.min("chunk").over(by_word)})
               .select("chunk", "key", F.when(F.col("first") == F.col("chunk"), -1 - F.col("c")).otherwise(F.col("c")).cast("double").alias("value"),
                       F.lit(True).alias("is_word")))
    # chunk and count in one column and the join's filter made before: both sides then take the same rows and
    # columns, and the n-grams are counted and shuffled once
    grams = (sorted_docs.mapInArrow(_chunk_counts(lambda texts: ngram_keys(texts, MAX_ORDER)), "chunk bigint, key bigint, n bigint")
             .select("key", (F.shiftleft("chunk", 36) + F.col("n")).alias("at"))
             .filter("key is not null").repartition("key"))
    context = F.shiftright("key", 9).bitwiseAND(F.lit(int(_mask(SHARED + 1))))
    kept = (grams.groupBy("key").agg(F.sum(F.col("at").bitwiseAND(F.lit((1 << 36) - 1))).alias("n"))
            .withColumn("part", F.pmod(F.xxhash64(context), F.lit(max(PARTS, CHUNK_PARTS * parts)))))
    found = kept.groupBy("part").applyInArrow(_probabilities(base), "key bigint, value float")
    valued = (grams.join(found.hint("merge"), "key")  # n-grams outnumber what Spark guesses from the file sizes: no broadcast
              .select(F.shiftright("at", 36).alias("chunk"), "key", F.col("value").cast("double").alias("value"), F.lit(False).alias("is_word")))
    scored = cut_lineage(dealt.groupBy("chunk").cogroup(counted.unionByName(valued).groupBy("chunk")).applyInArrow(_score, _SCORED))
    whole = scored.agg(F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_words"))), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    texts = sums[1]  # each ends once
    tokens, kinds = whole[0] + texts, whole[1] + (texts > 0)
    below = F.log10(F.lit(float(tokens + 0.5 * (kinds + 1))))
    return (scored.filter("kinds is null")
            .select("doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + int(texts > 0)).alias("n_known"),
                    F.lit(tokens).cast("long").alias("train_tokens"),
                    (F.col("log_counts") + F.log10(F.lit(texts + 0.5)) - (F.col("n_words") + 1) * below).alias("base_score"), "score"))
