"""SimHash near-duplicates against brute force."""

import random
import tracemalloc

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash

from conftest import SF_SMALL


def brute_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=3):
    """{position: smallest id reachable} of (id, fingerprint) rows."""
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return [low[find(i)] for i in range(n)]


TEXTS = [None, "", " \t\n", "One", "two WORDS", "three little words", "Three little\x0bwords", "é É ñ", "a\x00b c d e",
         "x " * 5000, ("lorem ipsum dolor sit " * 200000), "über Straße mit nbsp hier", "𝔘nicode 😀 words and more"]


def test_fingerprints_equal_brute_force():
    got = simhash.fingerprints_of([None if t is None else t.encode() for t in TEXTS])
    for t, g in zip(TEXTS, got):
        if t is None or len(t) < 100000:
            assert int(g) == brute_fingerprint(t), t and t[:30]
    many = [" ".join(random.Random(i).choices("abcdefgh", k=i % 40)) for i in range(300)]
    assert [int(x) for x in simhash.fingerprints_of([t.encode() for t in many])] == [brute_fingerprint(t) for t in many]


def test_fingerprint_memory_does_not_follow_the_chunk(monkeypatch):
    many = [" ".join(random.Random(i).choices("abcdefgh", k=400)).encode() for i in range(4000)]
    tracemalloc.start()
    got = simhash.fingerprints_of(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # of 3 MB of text, half a MB at a time; all at once it took 122 MB
    monkeypatch.setattr(simhash, "TEXT_BYTES", 1000)
    assert (simhash.fingerprints_of(many) == got).all()
    assert len(simhash.fingerprints_of([])) == 0


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("n,large", [(3, 4096), (40, 4096), (300, 4096), (300, 50)])
def test_links_connect_what_brute_force_connects(spark, n, large):
    rng = random.Random(n)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({flipped(rng, rng.choice(base), rng.randint(0, 9)) for _ in range(n)} | {0, 7, 15})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), large=large).collect()
    index = {x: i for i, x in enumerate(signed)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        root[find(index[a])] = find(index[b])
    want = brute_components([(i, x) for i, x in enumerate(fps)])
    mine = {}
    for i in range(len(fps)):
        mine.setdefault(find(i), []).append(i)
    assert [min(mine[find(i)]) for i in range(len(fps))] == want


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_masks_count_bits(radius):
    rng = random.Random(radius)
    base = rng.getrandbits(64)
    fps = np.array([flipped(rng, base, rng.randint(0, 8)) for _ in range(64)], np.uint64)
    planes = simhash._slice(fps, np.array([0]), np.arange(64).astype(np.uint64))
    masks = simhash.near_masks(fps, planes, np.zeros(64, int), np.full(64, simhash._ALL), radius)
    for i in range(64):
        for j in range(64):
            assert bool(int(masks[i]) >> j & 1) == ((int(fps[i]) ^ int(fps[j])).bit_count() <= radius)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    rows = sorted((r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect())
    assert got == [(d, f, c) for (d, f), c in zip(rows, brute_components(rows))]


def test_nulls_repeats_empty_and_clashing_columns(spark):
    data = [(3, None, 1), (2, "", 1), (2, "", 1), (None, " ", 1), (9, "some text of a few words here", 1),
            (8, "some text of a few words here", 1), (None, "alone with no id at all", 1)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, fp int").withColumnRenamed("fp", "component_id")
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(
        [(3, 2), (2, 2), (2, 2), (None, 2), (9, 8), (8, 8), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
