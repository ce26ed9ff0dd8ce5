"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: 64 bits, each the majority of that bit over the XXH64 hashes of a text's shingles.
Two fingerprints within `radius` differing bits agree on all but `radius` of BANDS groups of bits, so
every choice of BANDS - radius groups is a bucket key (exact, no link is lost). In a bucket, 64
members make a block stored as bit planes: one 64-bit word per fingerprint bit. A member is compared
with a whole block at once; carry-save counters, themselves bit planes, add up the differing bits,
and a block is abandoned as soon as all its members exceed the radius.

A bucket gives a spanning forest of its links, not all pairs; a bucket beyond LARGE members is dealt
out as pairs of sub-blocks to other tasks. Components join the forests. Texts of one fingerprint are
one node, so copies never meet in a bucket.

Defined results: a null, empty or wordless text has fingerprint 0 and links like any other; a text
of fewer words than a shingle is one shingle; null ids are no component's smallest unless all its
ids are null; repeated rows are separate rows with equal results; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow_text import text_udf
from .common import join_keys, slices, text_key, whole_row
from .components import components

SHINGLE = 3
RADIUS = 3
HASH_SEED = 42
BANDS = 6
#: Members of a bucket that one task compares with each other.
LARGE = 4096
#: Parts that the rows of one fingerprint are dealt to.
SALTS = 32

#: Bytes of texts whose words are listed at a time.
TEXT_BYTES = 1 << 19
_HASHES_AT_ONCE = 1 << 15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of counts[i] >= 1 hashes: the bits set in over half of them."""
    starts = np.concatenate(([0], np.cumsum(counts)))
    bits = np.zeros((len(counts), 64), np.int64)
    for lo in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[lo:lo + _HASHES_AT_ONCE]
        first = np.searchsorted(starts, lo, "right") - 1
        last = np.searchsorted(starts, lo + len(part), "left")
        at = np.maximum(starts[first:last] - lo, 0)
        planes = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits[first:last] += np.add.reduceat(planes, at, axis=0, dtype=np.int32)
    over = (2 * bits > counts[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints_of(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprint of each UTF-8 text; TEXT_BYTES of texts, or one longer text, are taken apart at a time."""
    parts = [_fingerprints(texts[lo:hi], shingle) for lo, hi in slices([len(t or b"") for t in texts], TEXT_BYTES)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _fingerprints(texts: list[bytes | None], shingle: int) -> np.ndarray:
    hashes, counts = [], []
    for text in texts:
        words = (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else \
            [b" ".join(words)] if words else []
        before = len(hashes)
        hashes.extend(map(xxhash.xxh64_intdigest, grams, itertools.repeat(HASH_SEED)))
        counts.append(len(hashes) - before)
    n = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    if hashes:
        out[n > 0] = _majority(np.array(hashes, np.uint64), n[n > 0])
    return out


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a bigint (its 64 bits)."""
    def run(texts):
        return pa.array(fingerprints_of(texts, shingle).view(np.int64))
    return text_udf(run, "bigint")(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _bands(bands: int = BANDS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each group of bits."""
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def bucket_keys(fp: Column, radius: int = RADIUS, bands: int = BANDS) -> Column:
    """All bucket keys of a fingerprint: the bits of each choice of bands - radius groups, hashed with
    the choice's number. (A clash of hashes only makes a bucket larger; distances are always counted.)"""
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << width) - 1)) for lo, width in _bands(bands)]
    choices = itertools.combinations(range(bands), bands - radius)
    return F.array(*[F.xxhash64(F.lit(n), *[part[k] for k in chosen]) for n, chosen in enumerate(choices)])


# ---- bit-sliced comparison ------------------------------------------------------------------

def _slice(fps: np.ndarray, starts: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Bit planes of consecutive blocks of at most 64 fingerprints: (64, blocks) words, one bit a lane."""
    out = np.empty((64, len(starts)), np.uint64)
    for p in range(64):
        out[p] = np.bitwise_or.reduceat(((fps >> np.uint64(p)) & np.uint64(1)) << lane, starts)
    return out


def _within(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is at most radius."""
    above, equal = over.copy(), np.full_like(over, _ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return ~above


def near_masks(queries: np.ndarray, planes: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """For query i against block[i]: the lanes (among lanes[i]) within radius differing bits."""
    out = np.zeros(len(queries), np.uint64)
    live = np.arange(len(queries))
    q, b, alive = queries, block, lanes.copy()
    counters = [np.zeros(len(q), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(q), np.uint64)
    for p in range(64):
        carry = planes[p][b] ^ (np.uint64(0) - ((q >> np.uint64(p)) & np.uint64(1)))  # lanes that differ here
        for c in counters:
            carry, c[:] = c & carry, c ^ carry
        over |= carry
        if p % 8 == 7:
            near = _within(counters, over, radius) & alive
            keep = near != 0
            if not keep.all():  # abandon blocks in which no lane is left
                live, q, b, alive, over = live[keep], q[keep], b[keep], alive[keep], over[keep]
                counters = [c[keep] for c in counters]
            if not len(live):
                return out
    out[live] = _within(counters, over, radius) & alive
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _small(fps: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """Spanning forest (pairs of fingerprints) of buckets of 2 to 64 members each, all at once."""
    sizes = np.diff(np.append(starts, len(fps)))
    block = np.repeat(np.arange(len(starts)), sizes)
    lane = (np.arange(len(fps)) - starts[block]).astype(np.uint64)
    full = _ALL >> (np.uint64(64) - sizes.astype(np.uint64))
    mask = near_masks(fps, _slice(fps, starts, lane), block, full[block] & ~(np.uint64(1) << lane), radius)
    near = np.flatnonzero(mask)
    if not len(near):
        return np.empty((0, 2), np.uint64)
    bits = np.unpackbits(mask[near].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, other = np.nonzero(bits)
    a = near[row]
    root = _roots(len(fps), a, starts[block[a]] + other)
    tied = np.flatnonzero(root != np.arange(len(fps)))
    return np.stack((fps[tied], fps[root[tied]]), 1)


def _large(fps: np.ndarray, radius: int) -> np.ndarray:
    """Spanning forest of one bucket of over 64 members, by breadth-first search over its bit matrix."""
    n = len(fps)
    starts = np.arange(0, n, 64)
    lane = (np.arange(n) % 64).astype(np.uint64)
    planes = _slice(fps, starts, lane)
    sizes = np.diff(np.append(starts, n)).astype(np.uint64)
    full = _ALL >> (np.uint64(64) - sizes)
    near = np.empty((n, len(starts)), np.uint64)
    rows = max(1, (1 << 18) // len(starts))
    blocks = np.arange(len(starts))
    for lo in range(0, n, rows):
        q = fps[lo:lo + rows]
        near[lo:lo + rows] = near_masks(np.repeat(q, len(blocks)), planes, np.tile(blocks, len(q)),
                                        np.tile(full, len(q)), radius).reshape(len(q), -1)
    left, edges = full.copy(), []
    for seed in range(n):
        if not left[seed // 64] >> np.uint64(seed % 64) & np.uint64(1):
            continue
        reached, front = np.zeros_like(left), np.array([seed])
        reached[seed // 64] = np.uint64(1) << np.uint64(seed % 64)
        while len(front):
            new = np.bitwise_or.reduce(near[front], axis=0) & ~reached
            reached |= new
            front = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
        left &= ~reached
        group = np.flatnonzero(np.unpackbits(reached.view(np.uint8), bitorder="little"))
        group = group[group != seed]
        if len(group):
            edges.append(np.stack((fps[group], np.full(len(group), fps[seed])), 1))
    return np.concatenate(edges) if edges else np.empty((0, 2), np.uint64)


def _forests(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Spanning forests of whole buckets, given sorted by key."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    out = [_large(fps[s:s + n], radius) for s, n in zip(starts[sizes > 64], sizes[sizes > 64])]
    small = (sizes > 1) & (sizes <= 64)
    if small.any():
        rows = np.repeat(small, sizes)
        out.append(_small(fps[rows], np.concatenate(([0], np.cumsum(sizes[small])[:-1])), radius))
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def _scan(radius: int, most: int | None):
    """mapInArrow function over (key, fp) sorted by key: edges, and the keys of buckets of over `most` members."""
    def result(edges=None, key=None, n=None):
        if edges is None:
            return pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()),
                                    pa.array([key], pa.int64()), pa.array([n], pa.int64())], ["a", "b", "key", "n"])
        e, none = edges.view(np.int64), pa.nulls(len(edges), pa.int64())
        return pa.record_batch([pa.array(e[:, 0]), pa.array(e[:, 1]), none, none], ["a", "b", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last bucket, which may go on
        passed, key = 0, None  # members of an oversize bucket that were let go
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                k, f = np.empty(0, np.int64), np.empty(0, np.int64)
            else:
                k, f = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            if passed:  # skip the rest of an oversize bucket
                same = int(np.searchsorted(k != key, True)) if len(k) else 0
                passed += same
                k, f = k[same:], f[same:]
                if batch is not None and not len(k):
                    continue
                yield result(key=key, n=passed)
                passed = 0
            if held:
                k, f = np.concatenate([x[0] for x in held] + [k]), np.concatenate([x[1] for x in held] + [f])
                held = []
            if batch is not None and len(k):
                last = int(np.flatnonzero(np.append(True, k[1:] != k[:-1]))[-1])
                if most and len(k) - last > most:
                    passed, key = len(k) - last, int(k[-1])
                else:
                    held = [(k[last:], f[last:])]
                k, f = k[:last], f[:last]
            if most and len(k):  # oversize buckets that lie whole in what was read
                starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                sizes = np.diff(np.append(starts, len(k)))
                for s, n in zip(starts[sizes > most], sizes[sizes > most]):
                    yield result(key=int(k[s]), n=int(n))
                fits = np.repeat(sizes <= most, sizes)
                k, f = k[fits], f[fits]
            if len(k):
                yield result(_forests(k, f.view(np.uint64), radius))

    return run


_OUT = "a bigint, b bigint, key bigint, n bigint"


def links(fps: DataFrame, radius: int = RADIUS, bands: int = BANDS, large: int = LARGE) -> DataFrame:
    """Edges (a, b) that connect what links within radius connect, of distinct fingerprints (column fp)."""
    rows = fps.select(F.explode(bucket_keys(F.col("fp"), radius, bands)).alias("key"), "fp")
    scan = lambda df, most: df.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_scan(radius, most), _OUT)
    found = cut_lineage(scan(rows, large))
    edges = found.filter("a is not null").select("a", "b")
    over = found.filter("key is not null").select(F.col("key").alias("hot"), F.ceil(F.col("n") * 2 / large).alias("parts"))
    if over.isEmpty():
        return edges.distinct()
    # a member of part p goes to the pairs (p, others); every two members meet in some pair
    split = join_keys(rows.withColumn("hot", F.col("key")), over, ["hot"], "inner")
    own = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts"))
    met = (split.withColumn("p", own).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
           .filter("p <> o")
           .select(F.xxhash64("key", F.least("p", "o"), F.greatest("p", "o")).alias("key"), "fp"))
    more = scan(met, None).filter("a is not null").select("a", "b")
    return edges.union(more).distinct()


def _grouped(docs: DataFrame, shingle: int, radius: int, bands: int, large: int, id_col: str, text_col: str) -> DataFrame:
    """Per document row: doc_id, text key, fp, root (a fingerprint that names the component) and component_id."""
    text = F.col(text_col)
    rows = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), *text_key(text), fingerprint(text, shingle).alias("fp"))
                       .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))))
    parts = cut_lineage(rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("low")))
    nodes = parts.groupBy("fp").agg(F.min("low").alias("low"))
    roots = components(links(nodes.select("fp"), radius, bands, large))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")
    return rows.join(parts.select("fp", "salt").join(named, "fp"), ["fp", "salt"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bands: int = BANDS,
                    large: int = LARGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, fp (bigint) and component_id (smallest doc_id reachable)."""
    return _grouped(docs, shingle, radius, bands, large, id_col, text_col).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bands: int = BANDS, large: int = LARGE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, unchanged: that of the smallest id (nulls last), of repeated rows one."""
    rows = cut_lineage(_grouped(docs, shingle, radius, bands, large, id_col, text_col)
                       .select("doc_id", "__text_hash", "__text_bytes", "root"))
    key = ["doc_id", "__text_hash", "__text_bytes"]
    order = F.struct(F.col("doc_id").isNull(), *key)
    kept = rows.groupBy("root").agg(F.min(order).alias("k")).select("k.*")
    counts = rows.groupBy("root", *key).agg(F.count(F.lit(1)).alias("n"))
    named = lambda df: df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)])
    on = [f"__k{i}" for i in range(len(key))]
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"k.{c}")) for c in key]
    same = same[0] & same[1] & same[2]
    gone = counts.alias("c").join(kept.alias("k"), same, "left_anti")
    repeated = counts.filter("n > 1").alias("c").join(kept.alias("k"), same, "left_semi")
    h, b = text_key(F.col(text_col))
    keyed = docs.select(whole_row(docs).alias("row"), *[c.alias(name) for c, name in zip((F.col(id_col), h, b), on)])
    out = join_keys(keyed, named(gone.distinct()), on, "left_anti")
    again = cut_lineage(named(repeated))
    if not again.isEmpty():  # rows that repeat a kept one
        out = join_keys(out, again, on, "left_anti").union(join_keys(out, again, on, "left_semi").dropDuplicates(on))
    return out.select("row.*")
