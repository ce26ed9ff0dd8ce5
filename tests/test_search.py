"""Text index, BM25 search, index maintenance and language tags."""

import math

from ledgerline.operators import search

from conftest import rows


def _docs(spark):
    return spark.createDataFrame([(1, "the cat sat"), (2, "the dog, the cat!"), (3, "Über café 42")],
                                 "doc_id long, text string")


def test_index_postings_and_lengths(spark):
    postings, lengths = search.build_index(_docs(spark), "doc_id", ["text"])
    p = rows(postings)
    assert ("the", 2, 2) in p and ("cat", 1, 1) in p and ("42", 3, 1) in p
    assert ("ber", 3, 1) in p and ("caf", 3, 1) in p  # ASCII token class splits accents
    assert rows(lengths) == [(1, 3), (2, 4), (3, 3)]


def test_bm25_scores_match_formula(spark):
    postings, lengths = search.build_index(_docs(spark), "doc_id", ["text"])
    got = {r.doc_id: (r.rank, r.score, r.total_hits) for r in
           search.search(spark, postings, lengths, "dog cat").collect()}
    n, avg = 3, 10 / 3

    def part(tf, df, dl):
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert math.isclose(got[2][1], part(1, 1, 4) + part(1, 2, 4))
    assert math.isclose(got[1][1], part(1, 2, 3))
    assert got[2][0] == 1 and got[1][0] == 2 and got[2][2] == 2


def test_search_without_hits_is_empty(spark):
    postings, lengths = search.build_index(_docs(spark), "doc_id", ["text"])
    assert search.search(spark, postings, lengths, "zebra").count() == 0
    assert search.search(spark, postings, lengths, "").count() == 0


def test_apply_changes(spark):
    postings, _ = search.build_index(_docs(spark), "doc_id", ["text"])
    ch = spark.createDataFrame([("delete", 1, None), ("update", 2, "bird"), ("add", 7, "cat")],
                               "op string, id long, body string")
    out = rows(search.apply_changes(postings, ch))
    assert {d for _, d, _ in out} == {2, 3, 7}
    assert [t for t, d, _ in out if d == 2] == ["bird"]


def test_language_tags(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "le chat et le chien"), (3, "xyz")],
                                 "doc_id long, text string")
    assert rows(search.language_tags(spark, docs)) == [(1, "en"), (2, "fr"), (3, "")]


def test_stored_index_search_and_maintenance(spark):
    from ledgerline.session import scratch_path
    docs = _docs(spark)
    root = search.write_index(docs, "doc_id", ["text"], scratch_path(spark, "t-index"))
    postings, lengths = search.read_index(spark, root)
    lazy_p, lazy_l = search.build_index(docs, "doc_id", ["text"])
    assert rows(postings) == rows(lazy_p) and rows(lengths) == rows(lazy_l)
    stored = {r.doc_id: r.score for r in search.search(spark, postings, lengths, "dog cat").collect()}
    lazy = {r.doc_id: r.score for r in search.search(spark, lazy_p, lazy_l, "dog cat").collect()}
    assert stored == lazy
    ch = spark.createDataFrame([("delete", 1, None), ("update", 2, "bird bird"), ("add", 7, "")],
                               "op string, id long, body string")
    p2, l2 = search.apply_changes(postings, ch, lengths)
    assert rows(l2) == [(2, 2), (3, 3), (7, 0)]
    assert [d for _, d, _ in rows(p2)].count(2) == 1


def test_stored_search_equals_lazy_and_is_updated(spark):
    import pytest
    from ledgerline.session import scratch_path
    docs = _docs(spark)
    root = search.write_index(docs, "doc_id", ["text"], scratch_path(spark, "t-index"))
    lazy = rows(search.search(spark, *search.build_index(docs, "doc_id", ["text"]), "dog cat"))
    found = search.search_stored(spark, root, "dog cat")
    assert rows(found) == lazy
    assert "lengths" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert search.search_stored(spark, root, "dog cat", page_no=9).count() == 0
    assert search.total_hits(spark, root, "dog cat") == 2 and search.total_hits(spark, root, "zebra") == 0
    with pytest.raises(ValueError):
        search.search_stored(spark, root, "dog", per_page=10_000)
    ch = spark.createDataFrame([("delete", 1, None), ("update", 2, "bird bird"), ("add", 7, "cat")], "op string, id long, body string")
    new = search.update_index(spark, root, ch, scratch_path(spark, "t-index"))
    p, lens = search.read_index(spark, new)
    assert rows(lens) == [(2, 2), (3, 3), (7, 1)] and ("bird", 2, 2) in rows(p)
    assert [r.doc_id for r in search.search_stored(spark, new, "cat").collect()] == [7]
    assert sorted(r.doc_id for r in search.search_stored(spark, root, "cat").collect()) == [1, 2]


def test_replaced_table_is_indexed_again(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from ledgerline.plans import registry

    path = str(tmp_path / "own documents.parquet")
    roots = []
    for text in ("alpha beta", "gamma delta and more"):
        pq.write_table(pa.table({"doc_id": [1], "text": [text]}), path)
        roots += [registry._stored_index(spark, spark.read.parquet(path), "doc_id", "text") for _ in range(2)]
    assert roots[0] == roots[1] != roots[2] == roots[3]
    terms = {r.term for r in spark.read.parquet(f"{roots[2]}/postings").collect() if r.term}
    assert "gamma" in terms and "alpha" not in terms


def test_tokens_are_counted_row_by_row(spark):
    """Counting needs no table of a task's terms and no shuffle; rows of one document are added up after it."""
    data = [(1, "a b a"), (1, "a c"), (2, None), (3, "..."), (None, "b"), (3, "b b"), (4, "")] + [(9, "x " * 700)] * 600
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    rows_of = search.token_rows(docs, "doc_id", ["text"])
    plan = rows_of._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    want = {("a", 1): (3, 3), ("b", 1): (1, 3), ("c", 1): (1, 2), (None, 2): (1, None), (None, 3): (1, 0), ("b", None): (1, 1),
            ("b", 3): (2, 2), (None, 4): (1, 0), ("x", 9): (420000, 700)}
    assert {(r.term, r.doc_id): (r.tf, r.doc_len) for r in search.token_counts(docs, "doc_id", ["text"]).collect()} == want
    assert rows_of.filter("doc_id = 9").count() == 600
    assert search.token_counts(docs.limit(0), "doc_id", ["text"]).count() == 0
