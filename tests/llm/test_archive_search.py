"""WARC archives, nearest neighbours, components and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import ann, components, decontaminate, langid, mixing, simhash, warc
from ledgerline.session import scratch_path

from conftest import SF_SMALL


# ---- WARC -------------------------------------------------------------------------------------

BIG = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>" * 5
PAGES = [(5, "http://a/", BIG, 1), (3, "http://b/", BIG, 1), (9, None, BIG, 1), (3, "http://b/", BIG, 1), (4, "http://c/ x\r\nWARC-Type: evil", "short", 1),
         (6, "u", "short", 1), (7, "v", None, 1), (8, "", "", 1), (None, "n", BIG, 1), (None, "m", "z" * 100, 1), (11, "q", "y" * 99, 1), (12, "q", "y" * 99, 1)]


def brute_records(pages):
    low = {}
    for i, _, h, _ in pages:
        k = h or ""
        low[k] = min((x for x in (low.get(k), i) if x is not None), default=None)
    out = []
    for i, _, h, _ in pages:
        data = (h or "").encode()
        revisit = len(data) >= 100 and i != low[h or ""]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", low[h or ""] if revisit else None))
    return sorted(out, key=str)


def archive(spark, pages):
    path = scratch_path(spark, "t-warc")
    warc.write_archive(spark.createDataFrame(pages, "page_id bigint, url string, html string, digest int"), path)
    return path


def test_archive_round_trip(spark):
    path = archive(spark, PAGES)
    rows = warc.read_archive(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == brute_records(PAGES)
    stored = spark.read.parquet(f"{path}/payloads").collect()
    assert Counter(bytes(r.payload) for r in stored) == Counter({(h or "").encode() for _, _, h, _ in PAGES})
    for r in warc.original_records(spark, path).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        body = rest[:-4]
        assert rest.endswith(b"\r\n\r\n") and len(body) == int(fields["Content-Length"])
        assert "evil" not in fields.values() or fields["WARC-Type"] != "evil"
        if fields["WARC-Type"] == "response":
            assert "sha256:" + hashlib.sha256(body).hexdigest() == fields["WARC-Payload-Digest"]
        else:
            assert body == b"" and fields["WARC-Refers-To"] in {f"<urn:page:{i}>" for i in (3,)}


def test_warc_files_round_trip(spark):
    path = archive(spark, PAGES)
    out = scratch_path(spark, "t-warc-files")
    warc.write_warc_files(spark, path, out)
    back = Counter((r.header, bytes(r.block)) for r in warc.read_warc_files(spark, out).collect())
    want = Counter()
    for r in warc.original_records(spark, path).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        want[head.decode() + "\r\n\r\n", rest[:-4]] += 1
    assert back == want


def test_changed_payload_is_refused_and_empty_table(spark):
    path = archive(spark, PAGES[:2])
    bad = scratch_path(spark, "t-warc-bad")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, bad).collect()
    empty = scratch_path(spark, "t-warc-none")
    warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), empty)
    assert warc.read_archive(spark, empty).count() == 0


# ---- nearest neighbours -----------------------------------------------------------------------

def brute_neighbours(rows, k):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            near = sorted(((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def frame(spark, rows):
    clean = lambda v: v and [None if x is None else float(x) for x in v]
    return spark.createDataFrame([(i, clean(v), 0.5, 1) for i, v in rows], "vec_id bigint, embedding array<float>, score double, leaf int")


def test_small_sets_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]  # many ties and equal vectors
    rows = [(i, v if any(v) else [1.0, 0, 0, 0]) for i, v in rows]
    want = brute_neighbours(rows, 20)
    got = {}
    bad = [(100, None), (120, [0.0] * 4), (140, [1.0, None, 0, 0]), (160, [float("nan"), 1, 1, 1]), (180, [float("inf"), 0, 0, 0]), (None, [9.0] * 4), (200, [1.0, 2.0])]
    for r in ann.search(frame(spark, rows + bad + rows[:5]), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got == want


def test_few_candidates_and_empty_table(spark):
    rows = [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (40, [0.0, 1.0])]
    got = ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(20, 1, 1), (20, 2, 40), (40, 1, 1), (40, 2, 20)]
    assert ann.search(frame(spark, rows[1:2]), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_and_a_vector_shared_by_many(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 300)  # several shelves and parts
    rng = np.random.default_rng(4)
    data = rng.normal(size=(3000, 16)).astype(np.float32)
    data[rng.choice(3000, 1000, replace=False)] = data[0]
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    got = {}
    for r in ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    want = brute_neighbours(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert all(abs(s - float(np.dot(np.float64(data[q]), np.float64(data[i])))) < 1e-12 for q in got for i, s in got[q].items())


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e-12])
def test_recall_at_any_scale_and_mixed_lengths(spark, scale):
    rng = np.random.default_rng(6)
    data = (rng.normal(size=(1200, 12)) * scale).astype(np.float32)
    rows = [(i, [float(x) for x in (v[:5] if i % 5 == 0 else v)]) for i, v in enumerate(data)]
    got = {}
    for r in ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [i for i, _ in rows if i % 20 == 0]
    own = {i: brute_neighbours([r for r in rows if len(r[1]) == len(dict(rows)[i])], 20)[i] for i in asked}
    assert sorted(got) == asked and all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[i] & {j for j, _ in own[i]}) / 20 for i in asked]) >= 0.9


def test_equal_products_of_different_vectors(spark):
    """Every candidate has the same product with the query: the smallest ids win, however many there are."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, float(np.cos(i)), float(np.sin(i))]) for i in range(1, 400)]
    got = [r.vec_id for r in ann.search(frame(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == list(range(1, 21))


# ---- components -------------------------------------------------------------------------------

@pytest.mark.parametrize("n,m,seed", [(1, 0, 0), (30, 20, 1), (200, 180, 2), (60, 59, 3)])
def test_components_equal_brute_force(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(n - 1)] if seed == 3 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges * 2, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert len(got) == len({r.node for r in got})


# ---- pipeline ---------------------------------------------------------------------------------

def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    top = docs.agg(F.max("doc_id")).first()[0]
    more = spark.createDataFrame([(top + 1, None, "en", "src0", 0), (top + 2, "123 456 !!", "en", "src0", 10)], docs.schema)
    first = docs.filter("doc_id < 3").withColumn("doc_id", F.col("doc_id") + top + 10)
    docs = docs.union(more).union(first).union(docs.filter("doc_id = 1"))
    base, stages = scratch_path(spark, "t-pipeline"), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != "sharding":
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{base}/{name}")
        before, docs = docs, spark.read.parquet(f"{base}/{name}")
        kept[name] = before, docs
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    before, after = kept["language_id"]
    assert rows(before) - rows(after) == rows(more)
    before, after = kept["near_duplicates"]
    group = {r.doc_id: r.component_id for r in simhash.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(group.values()))
    assert not rows(after) - rows(before)
    before, after = kept["decontamination"]
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contamination(before, bench).filter("contaminated").collect()}
    assert bad and rows(after) == Counter({t: n for t, n in rows(before).items() if t[0] not in bad})
    before, after = kept["mixing"]
    taken = {r.doc_id: r.taken for r in mixing.mix(before).collect()}
    words = Counter()
    for r in after.collect():
        words[r.doc_id] += len(r.text.split())
    assert {d: n for d, n in taken.items() if n} == dict(words)
    before, after = kept["sharding"]
    sizes = Counter(r.shard for r in after.collect())
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    assert rows(after.drop("shard", "slot")) == rows(before)


def test_stages_on_empty_tables_nulls_and_extra_columns(spark):
    text = lambda k: " ".join(f"the house{k * j} and water{k + j}" for j in range(1, 30))
    rows = [(i, text(i), "en", "a", 10, 1, "x", 2, 3) for i in range(1, 9)] + [(None, text(20), None, None, None, None, None, None, None)]
    rows += [(30, None, "en", "a", 0, 1, "x", 2, 3), (31, "", "en", "a", 0, 1, "x", 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "row int, __lang string, __k_id int, item_id int")
    base, empty = scratch_path(spark, "t-pipeline"), docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(f"{base}/{name}")
        columns = [*docs.columns, "shard", "slot"] if name == "sharding" else docs.columns
        docs = spark.read.parquet(f"{base}/{name}")
        assert docs.columns == columns and docs.count() > 0
        if name != "sharding":  # words of each document are left, whatever the mix takes of them
            assert {r.doc_id for r in docs.collect()} == {None, *range(1, 9)} or name == "mixing"
        none = stage(spark, empty, SF_SMALL)
        assert none.columns == columns and none.count() == 0
    assert {(r["row"], r["__k_id"], r.item_id) for r in docs.collect()} <= {(1, 2, 3), (None, None, None)}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 100
    assert langid.UNKNOWN == "und"
