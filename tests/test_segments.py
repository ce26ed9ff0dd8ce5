"""The segmented index equals a rebuilt one, writes what changed, and scores few postings."""

import os
import random

import pytest

from ledgerline.operators import search, segments
from ledgerline.session import local_path, scratch_path

from conftest import rows

WORDS = [f"w{i}" for i in range(40)]


def _body(rng, n=None):
    return " ".join(rng.choices(WORDS, weights=[1 / (i + 1) for i in range(40)], k=n or rng.randint(1, 30)))


def _bytes(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(local_path(root)) for f in fs if f.endswith(".parquet"))


def _frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id bigint, text string")


def _same_as_rebuilt(spark, root, docs, query, page=1):
    lazy = rows(search.search(spark, *search.build_index(_frame(spark, docs), "doc_id", ["text"]), query, page, 7), order=True)
    got = rows(segments.Search(spark, root, query).page(page, 7), order=True)
    if not lazy:
        return len(got) == 1 and got[0][:3] == (None, None, None)
    return [(r[0], r[1], round(r[2], 9), r[3]) for r in got] == [(r[0], r[1], round(r[2], 9), r[3]) for r in lazy]


def test_updates_equal_a_rebuild(spark):
    rng = random.Random(1)
    docs = {i: _body(rng) for i in range(1500)} | {-5: None, -6: "", 9_000_000_000: "w1 w39 w39"}
    root = segments.write_index(_frame(spark, docs), "doc_id", ["text"], scratch_path(spark, "t-segments"))
    with pytest.raises(ValueError, match="holds an index"):
        segments.write_index(_frame(spark, docs), "doc_id", ["text"], root)
    assert _same_as_rebuilt(spark, root, docs, "w30 w1")
    seen = []
    for turn in range(4):
        batch = []
        for i in rng.sample(sorted(docs), 12):
            op = rng.choice(["delete", "update"])
            batch.append((op, i, _body(rng) if op == "update" else None))
        batch += [("add", 5000 + 10 * turn + k, _body(rng)) for k in range(5)]
        if turn == 2:
            batch.append(("add", next(i for i in range(1500) if i not in docs), "w39 w39"))  # deleted before
        for op, i, body in batch:
            docs.pop(i, None)
            if op != "delete":
                docs[i] = body
        seen.append(segments.update_index(spark, root, spark.createDataFrame(batch, "op string, id bigint, body string")))
    assert all(len(s) <= 3 and s[0] == 0 for s in seen)  # small segments are merged, the large one stays
    want, _ = search.build_index(_frame(spark, docs), "doc_id", ["text"])
    assert rows(segments.live_postings(spark, root).select("term", "doc_id", "tf")) == rows(want)
    for query in ("w39", "w1 w35 w20", "w0", "nothing", "", "w1"):
        assert _same_as_rebuilt(spark, root, docs, query)
    assert _same_as_rebuilt(spark, root, docs, "w1 w2", page=3)
    now = segments.manifest(spark, root)
    assert now["n_docs"] == len(docs)


def test_a_small_batch_writes_little(spark):
    rng = random.Random(2)
    docs = {i: _body(rng, 60) for i in range(3000)}
    root = segments.write_index(_frame(spark, docs), "doc_id", ["text"], scratch_path(spark, "t-segments"))
    before = _bytes(root)
    segments.update_index(spark, root, spark.createDataFrame([("update", 7, "w1 w2")], "op string, id bigint, body string"))
    assert _bytes(root) - before < 0.1 * before


def test_a_failed_update_leaves_the_index(spark):
    rng = random.Random(3)
    docs = {i: _body(rng) for i in range(50)}
    root = segments.write_index(_frame(spark, docs), "doc_id", ["text"], scratch_path(spark, "t-segments"))
    # an update that died after writing its segment, before the manifest
    segments._write_segment(search.token_counts(_frame(spark, {1: "w39 " * 9}), "doc_id", ["text"]), segments._no_ids(spark), f"{root}/segment=1")
    assert _same_as_rebuilt(spark, root, docs, "w39")
    segments.update_index(spark, root, spark.createDataFrame([("update", 3, "w39")], "op string, id bigint, body string"))
    assert _same_as_rebuilt(spark, root, docs | {3: "w39"}, "w39 w38")


def test_blocks_that_cannot_reach_the_page_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(segments, "PROBE_BLOCKS", 2)
    rng = random.Random(4)
    docs = {i: "common " * rng.randint(1, 2) + "filler " * rng.randint(20, 40) for i in range(20_000)}
    docs |= {i: "common common common rare" for i in (77, 78, 79, 12_000)}
    root = segments.write_index(_frame(spark, docs), "doc_id", ["text"], scratch_path(spark, "t-segments"))
    found = segments.Search(spark, root, "common rare")
    kept, _ = found.candidates(3)
    assert kept.count() <= 6 < found.blocks.count()
    assert [r.doc_id for r in found.page(1, 3).collect()] == [77, 78, 79]
    assert found.total() == 20_000
    assert _same_as_rebuilt(spark, root, docs, "common rare") and _same_as_rebuilt(spark, root, docs, "common")


def test_a_page_past_the_end_has_the_total(spark):
    root = segments.write_index(_frame(spark, {1: "a b", 2: "a"}), "doc_id", ["text"], scratch_path(spark, "t-segments"))
    assert rows(segments.Search(spark, root, "a").page(9, 10)) == [(None, None, None, 2)]
    assert rows(segments.Search(spark, root, "zebra").page(1, 10)) == [(None, None, None, 0)]
    with pytest.raises(ValueError):
        segments.Search(spark, root, "a").page(1, 10_000)
    empty = segments.write_index(_frame(spark, {1: "a"}).limit(0), "doc_id", ["text"], scratch_path(spark, "t-segments"))
    assert segments.Search(spark, empty, "a").total() == 0
    segments.update_index(spark, empty, spark.createDataFrame([("add", 4, "a a")], "op string, id bigint, body string"))
    assert [r.doc_id for r in segments.Search(spark, empty, "a").page().collect()] == [4]
