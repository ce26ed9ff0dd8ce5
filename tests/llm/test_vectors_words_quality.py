"""Whitening, spelling variants and quality scores against brute force, high precision and held-out labels."""

import binascii
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import quality, queries, spelling, whitening
from ledgerline.llm.sums import tree_sum

from conftest import SF_SMALL


# ---- whitening -------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, component int, whitened string, vector int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2) for i, v in rows], VECTORS)


def expected(vectors, k=16):
    """n, per vector deviations and whitened values (up to sign), and shares, in extended precision."""
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    centred = (n * u - s).astype(np.longdouble) / n
    w, q = np.linalg.eigh((centred.T @ centred / n).astype(float))
    w, q = w[::-1], q[:, ::-1]
    kept = min(k, int((w > 1e-9 * w[0]).sum()))
    white = ((n * x - s) / n) @ q[:, :kept] / np.sqrt(w[:kept])
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, white, w[:kept] / w.sum()


def same_up_to_sign(a, b):
    return np.allclose(a * np.sign((a * b).sum(0)), b, atol=1e-8)


def matrix(got):
    return got.pivot(index="vec_id", columns="component", values="whitened")


def test_whitening_of_the_table(spark):
    got = queries.QUERIES["op11_whiten_embeddings"](spark, SF_SMALL).toPandas()
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, deviation, white, shares = expected(np.stack(table.embedding))
    assert same_up_to_sign(matrix(got).to_numpy(), white) and (got.n == n).all()
    assert got[got.component == 1].sort_values("vec_id").deviation.tolist() == deviation
    assert np.allclose(got.groupby("component").explained.first(), shares, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


@pytest.mark.parametrize("spread", [1, 1e3, 1e6])
def test_directions_of_small_variance(spark, spread):
    """Variances that differ by the square of 10^6 each: a Gram matrix of the rows would lose the small ones."""
    rng = np.random.default_rng(4)
    turn, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    x = (rng.normal(size=(400, 6)) * np.geomspace(1, 1 / spread, 6) * 1e4) @ turn
    got = whitening.whiten(vectors_of(spark, list(enumerate(x)))).toPandas()
    assert sorted(got.component.unique()) == [1, 2, 3, 4, 5, 6] and got.identity_error[0] < 1e-6
    grid = np.floor(64 * x) + 1_000_000
    centred = grid - grid.mean(0)
    single = np.linalg.svd(centred, compute_uv=False)
    assert np.allclose(got.groupby("component").explained.first(), single ** 2 / (single ** 2).sum(), rtol=1e-6)


def test_dependent_dimensions_are_no_components(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-20, 20, size=(60, 3)).astype(float)
    x = np.column_stack((base, base[:, 0], base[:, 1] + base[:, 2], np.full(60, 7.0)))
    got = whitening.whiten(vectors_of(spark, list(enumerate(x)))).toPandas()
    n, _, white, shares = expected(x)
    assert sorted(got.component.unique()) == [1, 2, 3] and white.shape[1] == 3
    assert same_up_to_sign(matrix(got).to_numpy(), white) and np.allclose(got.groupby("component").explained.first(), shares)
    assert got.identity_error[0] < 1e-9


def test_vectors_that_take_no_part_repeats_and_lengths(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3))
    rows = list(enumerate(x)) + [(100 + i, x[0]) for i in range(30)] + [(None, x[1]), (0, x[0])]
    odd = [(500, None), (501, [1, None, 2]), (502, [1, float("nan"), 2]), (503, [1, float("inf"), 2]), (504, [])]
    short = [(600 + i, rng.normal(size=2)) for i in range(9)]
    got = whitening.whiten(vectors_of(spark, rows + odd + short)).toPandas()
    three, two = got[got.vec_id.isna() | (got.vec_id < 600)], got[got.vec_id >= 600]
    n, deviation, white, _ = expected(np.stack([v for _, v in rows]))
    assert n == 40 and (three.n == 40).all() and len(three) == 3 * len(rows) and len(two) == 18 and (two.n == 9).all()
    first = three[three.component == 1]
    assert sorted(first.deviation) == sorted(deviation)
    assert same_up_to_sign(matrix(three[(three.vec_id > 0) & (three.vec_id < 40)]).to_numpy(), white[1:40])
    zero = whitening.whiten(vectors_of(spark, [(1, [0, 0]), (2, [0, 0])]))
    assert zero.count() == 0 and whitening.whiten(vectors_of(spark, [])).count() == 0


def test_huge_entries(spark):
    rows = [(1, [1e300, 1]), (2, [-1e300, 2]), (3, [0, 3]), (4, [5, -9])]
    got = whitening.whiten(vectors_of(spark, rows)).toPandas()
    assert sorted(got.vec_id) == [1, 2, 3, 4] and np.isfinite(got.whitened).all()  # the other dimension varies by a part in 10^14
    assert got[got.vec_id < 3].deviation.isna().all() and got[got.vec_id > 2].deviation.notna().all()


def test_sums_over_many_tasks(spark):
    df = spark.range(1000).repartition(300)
    total = tree_sum(df, lambda b: np.array([b.column(0).to_numpy().sum(), b.num_rows], float), 2)
    assert total.tolist() == [499500, 1000]
    assert tree_sum(spark.range(0), lambda b: np.ones(2), 2).tolist() == [0, 0]


def test_substitution_and_factor():
    rng = np.random.default_rng(7)
    r = np.triu(rng.normal(size=(5, 5))) + 5 * np.eye(5)
    q = rng.normal(size=(9, 5))
    assert np.allclose(whitening.solve_right(q @ r, r), q)
    gram = np.ones((3, 3))  # of rank one: only a shifted factor exists
    made = whitening.factor(gram, 10, shifted=False)
    assert np.allclose(made.T @ made, gram, atol=1e-9) and np.allclose(made, np.triu(made))


# ---- spelling variants -----------------------------------------------------------------------

def brute_variants(docs, min_length=5, min_count=3, ratio=2, every=97):
    count = Counter()
    for doc_id, text in docs:
        for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", (text or "").encode().lower().decode())).items():
            h = binascii.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += n
    words = {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    near = defaultdict(list)
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for w in words:
        for length in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [v for v in by_length[length] if one_edit(w, v)]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= ratio * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w
    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def variants_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_group_spelling_variants"](spark, SF_SMALL)
    want = brute_variants(docs)
    assert len(want) > 1000 and variants_of(got) == want and got.count() == len(want)


@pytest.mark.parametrize("groups,size", [(2, 4), (3, 16), (5, 7), (8, 1024)])
def test_variants_with_any_groups_and_blocks(spark, groups, size):
    rng = random.Random(groups)
    words = ["".join(rng.choices("abcé", k=rng.randint(5, 8))) for _ in range(120)]
    docs = [(i, " ".join(rng.choices(words, k=60))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert variants_of(spelling.group_variants(df, groups=groups, size=size)) == brute_variants(docs)


def test_variant_cases(spark):
    long = "x" * 5000
    docs = [(1, "house house house house house house house house, HOUSE hous hous"), (2, "houses houses houses,housé housé housé"),
            (None, "abcde abcde abcde abcdf abcdf abcdf"), (3, None), (4, ""), (5, "12 !?"), (6, f"{long} {long} {long} {long}y {long}y {long}y"),
            (7, "Ärger Ärger Ärger ärger ärger ärger ÷×÷×÷ ÷×÷×÷ ÷×÷×÷")] + [(8, "strong strong strong")] * 3
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id bigint, text string, word string, n int")
    got = spelling.group_variants(df)
    assert variants_of(got) == brute_variants(docs)
    by = {r.word: r for r in got.collect()}
    assert by["strong"].n == 9 and by["strong"].root == "strong" and by["strong"].n_near == 0
    assert spelling.group_variants(df.limit(0)).count() == 0


def test_chains_of_forms_reach_their_root(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    docs = [(i, " ".join([w] * (3 * 2 ** i))) for i, w in enumerate(chain)]
    got = spelling.group_variants(spark.createDataFrame(docs, "doc_id bigint, text string"), misspelt=0)
    by = {r.word: r for r in got.collect()}
    assert [by[w].root for w in chain] == ["bbbbb"] * 6 and by["aaaaa"].form == "aaaab"


def test_near_pairs_equal_brute_force():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 3, (300, 6)).astype(np.uint8), rng.integers(0, 3, (200, 7)).astype(np.uint8)
    i, j = spelling.near_pairs(a, b)
    want = {(p, q) for p in range(300) for q in range(200) if any((np.delete(b[q], k) == a[p]).all() for k in range(7))}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
    i, j = spelling.near_pairs(a, a, True)
    assert set(zip(i.tolist(), j.tolist())) == {(p, q) for p in range(300) for q in range(p + 1, 300) if (a[p] != a[q]).sum() == 1}


def test_groups_follow_the_number_of_words():
    got = [spelling.groups_for(n) for n in (0, 10 ** 4, 10 ** 6, 10 ** 8, 10 ** 12)]
    assert got == sorted(got) and got[0] == 2 and got[-1] == spelling.MOST_GROUPS


# ---- quality ---------------------------------------------------------------------------------

def crc(d):
    return binascii.crc32(str(d).encode())


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_classify_quality"](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (got.held_out == [crc(d) % 4 == 2 for d in got.doc_id]).all() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").toPandas())
    held = both[both.held_out]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert (good.predicted == 1).mean() >= 0.95 and (bad.predicted == 0).mean() >= 0.8


def test_scores_equal_dense_gaussians():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(500, 4)), rng.integers(0, 2, 500)
    x[y == 1] = x[y == 1] @ np.diag([1, 2, 3, 4]) + 1
    counts = np.array([(y == c).sum() for c in (0, 1)], float)
    model = quality.Discriminant(counts, np.array([x[y == c].sum(0) for c in (0, 1)]), np.array([x[y == c].T @ x[y == c] for c in (0, 1)]))
    common = sum(counts[c] * np.cov(x[y == c].T, bias=True) for c in (0, 1)) / 500
    density = []
    for c in (0, 1):
        cov = (1 - quality.POOLED) * np.cov(x[y == c].T, bias=True) + quality.POOLED * common
        cov = (1 - quality.DIAGONAL) * cov + quality.DIAGONAL * np.diag(np.diag(cov)) + np.diag(1e-6 + 1e-3 * np.diag(common))
        d = x - x[y == c].mean(0)
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.log(np.linalg.det(cov))))
    margin = quality.TEMPER * (density[1] - density[0]) + np.log(counts[1] / counts[0])
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-margin)))


def test_statistics_do_not_depend_on_neighbours():
    texts = [b"", None, b"one", b"The cat. The cat sat on 12 mats!\nThe cat.", b"### a### B$$ " * 40, "Größe ändert\n\nnichts".encode(), b"   \n ", b"x" * 3000]
    whole = quality.statistics(texts)
    alone = np.concatenate([quality.statistics([t]) for t in texts])
    assert np.allclose(whole, alone) and np.isfinite(whole).all() and (whole[0] == whole[1]).all()


def test_statistics_by_hand():
    got = dict(zip(quality.STATISTICS, quality.statistics([b"Ab cd, CD 12 cd,\ncd, cd,"])[0]))
    odds = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5))
    assert got["words"] == pytest.approx(np.log1p(7)) and got["lines"] == pytest.approx(np.log1p(2))
    assert got["upper"] == pytest.approx(odds(3, 12)) and got["digits"] == pytest.approx(odds(2, 18)) and got["marks"] == pytest.approx(odds(4, 18))
    assert got["distinct_words"] == pytest.approx(odds(4, 7)) and got["commonest_word"] == pytest.approx(odds(4, 7))
    assert got["upper_words"] == pytest.approx(odds(1, 7)) and got["letterless_words"] == pytest.approx(odds(1, 7))
    assert got["repeated_next"] == pytest.approx(odds(2, 7)) and got["worst_repeats"] == pytest.approx(odds(3, 7))


def test_quality_cases(spark):
    rng = random.Random(2)
    clean = ["house", "water", "friend", "with", "the", "and"]
    texts = {i: " ".join(rng.choices(clean, k=rng.randint(20, 60))) + "." if i % 2 else "### $$ " * rng.randint(10, 40) for i in range(200)}
    docs = [(i, t) for i, t in texts.items()] + [(900, None), (901, ""), (902, " "), (None, "the house"), (1, texts[1])]
    df = spark.createDataFrame([(*d, 0.5, 7, "l") for d in docs], "doc_id bigint, text string, score double, predicted int, label string")
    marks = [(i, i % 2) for i in range(200)] + [(3, None), (None, 1), (5, 9)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    rows = quality.score_quality(df, labels).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and by[900].score == by[901].score and by[None].held_out is False
    assert all(by[i].predicted == i % 2 for i in range(200)) and 0 <= by[900].score <= 1
    assert {r.score for r in rows if r.doc_id == 1} == {by[1].score}
    none = quality.score_quality(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    one = quality.score_quality(df, labels.filter("quality = 1"))
    assert {r.score for r in one.collect()} == {1.0}
    assert quality.score_quality(df.limit(0), labels).count() == 0


def test_held_out_labels_are_not_learned(spark):
    """Turning the labels of held-out documents around changes nothing."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score_quality(docs, x).orderBy("doc_id").toPandas().score for x in (labels, turned))
    assert np.allclose(a, b, rtol=0, atol=1e-12)


def test_exact_deviation_of_large_sums():
    model = whitening.Model(3, [10 ** 15, 5], np.zeros((0, 2)), np.zeros(0), np.zeros(0), 1, 0)
    x = np.array([[10 ** 9, 2], [333333333333333, 1]])
    want = [sum((Fraction(3) * int(v) - s) ** 2 for v, s in zip(row, (10 ** 15, 5))) for row in x]
    assert model.deviations(x) == [int(v) if v < 1 << 63 else None for v in want]
