"""Language ID, PPM scoring, token counts and license scans against brute force and held-out texts."""

import binascii
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import langid, licenses, ppm, queries, tokens

from conftest import SF_SMALL


def docs_of(spark, rows, extra="n_tokens int, score int, found string"):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], f"doc_id bigint, text string, lang string, {extra}")


def crc(d):
    return binascii.crc32(("" if d is None else str(d)).encode())


# ---- language ID ------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    got = queries.QUERIES["op5_identify_language"](spark, SF_SMALL).toPandas()
    truth = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth)
    assert len(both) == len(truth) and (both.held_out == [crc(d) % 3 == 1 for d in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.9
    assert both.score.between(0, 1).all()


def test_margins_equal_dense_products():
    texts = [b"Der Hund und die Katze", b"the dog and the cat", b"", b"x", "él niño y la niña".encode(), b"le chien et le chat " * 50]
    rng = np.random.default_rng(1)
    n = len(langid.ORDERS) << langid.BITS
    model = langid.Model(["de", "en"], [("family:a", "family:b"), ("de", "en")], rng.normal(size=(n, 2)), np.array([0.5, -1.0]))
    dense = np.zeros((len(texts), n))
    for i, (at, value) in enumerate(langid._features(texts)):
        dense[i, at] = value
    assert np.allclose(model.margins(texts), dense @ model.weights + model.bias, atol=1e-4)


def test_svm_solves_its_problem():
    """The pairwise fit is the minimum of the squared-hinge objective, found here by plain gradient steps."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6)) / 2.5
    sign = np.where(x[:, 0] + 0.3 * rng.normal(size=40) > 0, 1.0, -1.0)
    coefficient, bias = langid._svm(x @ x.T, sign, epochs=3000)
    w = np.append(x.T @ coefficient, bias / 0.1)  # the constant feature is 0.1
    rows = np.column_stack((x, np.full(40, 0.1)))
    c = np.where(sign > 0, langid.COST * 40 / (2 * (sign > 0).sum()), langid.COST * 40 / (2 * (sign < 0).sum()))

    def slope(v):
        return v - 2 * rows.T @ (c * sign * np.maximum(0, 1 - sign * (rows @ v)))

    v = np.zeros(7)
    for _ in range(60000):
        v -= 2e-4 * slope(v)
    assert np.allclose(w, v, atol=1e-3) and np.abs(slope(w)).max() < 1e-3


def test_vote_equals_counting():
    rng = np.random.default_rng(4)
    names = ["a", "b", "c", "d"]
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1:]]
    column = {p: k for k, p in enumerate(pairs)}
    for _ in range(200):
        row = rng.integers(-2, 3, len(pairs)).astype(float)
        margin = lambda x, y: row[column[x, y]] if (x, y) in column else -row[column[y, x]]
        won = {x: sum(margin(x, y) > 0 or (margin(x, y) == 0 and x < y) for y in names if y != x) for x in names}
        total = {x: sum(margin(x, y) for y in names if y != x) for x in names}
        best = min(names, key=lambda x: (-won[x], -total[x], x))
        got, sure = langid._elect(names, "", row, column)
        assert got == best and 0 <= sure <= 1


def test_fit_memory_is_bounded():
    """A fit of TRAIN_ROWS dense rows never holds them spread out to all features."""
    import tracemalloc
    rng = np.random.default_rng(5)
    width = len(langid.ORDERS) << langid.BITS
    features = [(np.sort(rng.choice(width, 2000, replace=False)), rng.random(2000)) for _ in range(langid.TRAIN_ROWS)]
    names = [("en", "de", "fr", "es")[i % 4] for i in range(len(features))]
    tracemalloc.start()
    langid.fit(features, names)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20


def test_prediction_memory_does_not_follow_the_chunk(monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(chr(c) for c in rng.integers(97, 123, n)).encode() for n in (3, 40, 900, 1 << 20)]
    model = langid.Model(["de", "en", "fr"], [("de", "en"), ("de", "fr"), ("en", "fr")],
                         rng.normal(size=(len(langid.ORDERS) << langid.BITS, 3)), np.zeros(3))
    tracemalloc.start()
    got = model.margins(texts * 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # 3 MB of text; all at once it took 174 MB
    for i, text in enumerate(texts):  # text by text, feature by feature
        (at, value), = langid._features([text])
        assert np.allclose(got[i], value @ model.weights[at], atol=1e-6) and np.allclose(got[i], got[i + 4], rtol=0, atol=0)
    for piece in (1, 7, 64):  # parts of a text add up to the whole
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.allclose(model.margins(texts[:3]), got[:3], atol=1e-9)
    assert model.margins([]).shape == (0, 3)


def test_usual_level_equals_dense_means():
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["der", "hund", "die", "katze", "und", "haus"], 30)).encode() for _ in range(12)]
    features = langid._features(texts)
    width = len(langid.ORDERS) << langid.BITS
    dense = np.zeros((len(texts), width))
    for i, (at, value) in enumerate(features):
        dense[i, at] = value
    usual, least = langid._usual(features, width)
    assert np.allclose(usual, np.log(dense.mean(0) + langid.UNSEEN))
    left_out = [row @ np.log(np.delete(dense, i, 0).mean(0) + langid.UNSEEN) for i, row in enumerate(dense)]
    assert np.isclose(least, (min(left_out) + len(langid.ORDERS) * usual.mean()) / 2)
    model = langid.fit(features, ["de"] * 6 + ["en"] * 6)
    assert np.allclose(model._means(texts)[:, -1], dense @ usual, atol=1e-4)
    assert langid._usual(features[:1], width)[1] == -np.inf == langid.fit([], []).least
    assert langid.fit([], []).predict([b"x"]) == [("und", 0.0, False)]
    assert langid.fit(features[:1], ["de"]).predict([b"x", b""]) == [("de", 1.0, True)] * 2


def test_strange_texts_go_and_documents_stay(spark):
    """Rejected: texts of no learned language. Kept: every document with a letter, also its first five words."""
    import base64
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(7)
    strange = [base64.b64encode(rng.randbytes(n)).decode() for n in (60, 200, 1500) * 4]
    strange += ["Привет мир это русский текст о погоде и о людях", "今日は天気がいいですね", "καλημέρα τι κάνεις σήμερα φίλε μου"]
    added = docs_of(spark, [(10_000_000 + i, t, None) for i, t in enumerate(strange)]).select("doc_id", "text", "lang")
    short = docs.select((F.col("doc_id") + 20_000_000).alias("doc_id"), F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("text"),
                        F.lit(None).cast("string").alias("lang"))
    both = docs.unionByName(added).unionByName(short)
    kept = {r.doc_id for r in langid.keep_identified(both).collect()}
    lettered = {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()}
    assert lettered <= kept and not {d for d in kept if 10_000_000 <= d < 20_000_000}
    assert len([d for d in kept if d >= 20_000_000]) >= 0.98 * len(lettered)


def test_whole_rows_keep_clashing_columns(spark):
    rows = [(i, "the house and this water", "en" if i % 2 else "de", 1, 2, 3, 4) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, __lang int, row int, __k_id int, __lang_score int")
    assert langid.keep_identified(df).columns == df.columns and langid.keep_identified(df).count() == 20


def test_language_cases(spark):
    words = {"en": "the house and this water with that friend", "de": "das Haus und dieses Wasser mit jenem Freund",
             "fr": "la maison et cette eau avec cet ami", "xx": "zqo wkk jjv qqz xwv kzz vjq"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words[x].split(), k=12)), x) for i, x in enumerate(["en", "de", "fr", "xx"] * 30)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 !?", None), (903, "the house and this water", None), (None, "das Haus und dieses Wasser", "de")]
    docs = docs_of(spark, rows)
    got = {r.doc_id: (r["__lang_pred"], r["__lang_score"]) for r in langid.predict(docs).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[903][0] == "en" and got[None][0] == "de"
    assert np.mean([got[d][0] == lang for d, _, lang in rows[:120]]) > 0.95
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    unlabelled = langid.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["__lang_pred"] for r in unlabelled} == {"und"}
    single = langid.predict(docs.withColumn("lang", F.lit("en"))).filter("doc_id = 1").first()
    assert (single["__lang_pred"], single["__lang_score"]) == ("en", 1.0)
    assert langid.predict(docs.limit(0)).count() == 0


def test_training_rows_are_bounded(spark):
    docs = docs_of(spark, [(i, f"word{i} text", "en" if i % 3 else "de") for i in range(600)])
    got = Counter(r.lang for r in langid.training_rows(docs, most=100).collect())
    assert got == {"en": 50, "de": 50}


# ---- PPM --------------------------------------------------------------------------------------

class BrutePPM:
    def __init__(self, texts, order):
        self.order, self.counts = order, [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            s = [ppm.BEFORE] * order + list(t) + [ppm.END]
            for i in range(order, len(s)):
                for j in range(order + 1):
                    self.counts[j][tuple(s[i - j:i])][s[i]] += 1

    def probability(self, context, symbol):
        p, excluded = 1.0, set()
        for j in range(self.order, -1, -1):
            seen = {s: c for s, c in self.counts[j].get(tuple(context[len(context) - j:]), {}).items() if s not in excluded}
            total, kinds = sum(seen.values()), len(seen)
            if not kinds:
                continue
            if symbol in seen:
                return p * seen[symbol] / (total + kinds)
            p *= kinds / (total + kinds)
            excluded |= set(seen)
        return p / (ppm.SYMBOLS - len(excluded))

    def score(self, t):
        s = [ppm.BEFORE] * self.order + list(t) + [ppm.END]
        return sum(math.log10(self.probability(s[i - self.order:i], s[i])) for i in range(self.order, len(s)))


def trie(texts, order):
    if not texts:
        return ppm.Trie(np.empty(0, np.uint64), np.empty(0, np.int64), order)
    return ppm.Trie(*np.unique(ppm.ngram_keys(texts, order)[0], return_counts=True), order)


@pytest.mark.parametrize("order", [0, 1, 2, 4, 5])
def test_ppm_equals_brute_force(order):
    rng = random.Random(order)
    train = [bytes(rng.choices(b"abcd ", k=rng.randint(0, 60))) for _ in range(12)] + [b"", b"the the the"]
    test = train[:3] + [b"", b"abcdz", "é".encode(), bytes(rng.choices(b"abcdxyz", k=80)), b"the theme"]
    model, brute = trie(train, order), BrutePPM(train, order)
    assert np.allclose(model.score(test), [brute.score(t) for t in test], rtol=1e-5)
    for context in (b"", b"a", b"ab", b"zz", b"the t"):  # probabilities of all symbols add up to 1
        texts = [context + bytes([c]) for c in range(256)]
        ends = ppm.ngram_keys(texts, order)
        last = np.cumsum(ends[1]) - 2
        end = ppm.ngram_keys([context], order)[0][-1:]
        assert abs((10.0 ** model.log10_probabilities(np.concatenate((ends[0][last], end)))).sum() - 1) < 1e-4


def test_ppm_without_training():
    assert np.allclose(trie([], 3).score([b"", b"ab"]), [-math.log10(257), -3 * math.log10(257)])


def brute_base(rows):
    low = lambda t: (t or "").encode().lower().split()
    train = [low(t) for d, t in rows if crc(d) % 5 != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + bool(train)
    out = []
    for d, t in rows:
        counts = [c[w] for w in low(t)] + [len(train)]
        out.append((d, crc(d) % 5 == 1, len(counts), sum(x > 0 for x in counts), n,
                    sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in counts)))
    return out


def check_scores(df, rows, order=None):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=str)
    want = sorted(brute_base(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    if order is not None:
        brute = BrutePPM([ppm.normalised((t or "").encode()) for d, t in rows if crc(d) % 5 != 1], order)
        want = sorted(((d, crc(d) % 5 == 1, len((t or "").split()) + 1, brute.score(ppm.normalised((t or "").encode()))) for d, t in rows), key=str)
        assert np.allclose(sorted(g[6] for g in got), sorted(w[3] for w in want), rtol=1e-4)


def test_scores_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.QUERIES["op6_score_language_model"](spark, SF_SMALL)
    check_scores(df, rows)


def test_score_cases(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "A b a"), (3, "A b a"), (None, "b\x0bb c"), (6, "é É"), (7, "a " * 3000), (11, "new words"), (12, "a b c d")]
    monkeypatch.setattr(ppm, "CHUNK_TEXT", 1000)  # several chunks
    check_scores(ppm.score_documents(docs_of(spark, [(d, t, "en") for d, t in rows])), rows, ppm.MAX_ORDER)
    assert ppm.score_documents(docs_of(spark, []).limit(0)).count() == 0
    held = [(d, "only held out") for d in range(200) if crc(d) % 5 == 1][:3]
    check_scores(ppm.score_documents(docs_of(spark, [(d, t, "en") for d, t in held])), held, ppm.MAX_ORDER)


def test_order_of_the_scores_does_not_fall_with_size(spark):
    """More n-grams than a trie made in one piece may hold."""
    rng = np.random.default_rng(5)
    rows = [(d, rng.integers(97, 123, 25_000).astype(np.uint8).tobytes().decode()) for d in range(260)]
    learned = [t.encode() for d, t in rows if crc(d) % 5 != 1]
    whole = trie(learned, ppm.MAX_ORDER)
    assert len(whole.alone[ppm.MAX_ORDER]) > ppm.MAX_NODES
    got = {r.doc_id: r.score for r in ppm.score_documents(docs_of(spark, [(*r, "en") for r in rows])).collect()}
    some = [r for r in rows if crc(r[0]) % 5 == 1][:5] + rows[:5]
    assert len(got) == len(rows)
    assert np.allclose([got[d] for d, _ in some], whole.score([t.encode() for _, t in some]), rtol=1e-6)


def test_parts_of_a_trie_score_as_the_whole():
    rng = random.Random(8)
    train = [bytes(rng.choices(b"abcd ", k=rng.randint(0, 80))) for _ in range(15)] + [b""]
    keys = ppm.ngram_keys(train[:4] + [b"abcdz", b"zz a b", b""], 5)[0]
    base, whole = trie(train, ppm.SHARED), trie(train, 5)
    own, counts = np.unique(ppm.ngram_keys(train, 5)[0], return_counts=True)
    part = lambda k: (k >> np.uint64(9) & np.uint64((1 << 27) - 1)) % np.uint64(3)
    for p in range(3):
        one = ppm.Trie(own[part(own) == p], counts[part(own) == p], 5, base)
        asked = keys[part(keys) == p]
        assert len(asked) and np.array_equal(one.log10_probabilities(asked), whole.log10_probabilities(asked))


# ---- token counts -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def counts():
    return tokens.Counts(tokens.vocabulary_path())


def test_counts_equal_the_library(spark, counts):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: len(counts.tokenizer.encode(r.text, add_special_tokens=False).ids) for r in rows}
    got = queries.QUERIES["op8_count_tokens"](spark, SF_SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert {r.doc_id: r.n_bytes for r in got} == {r.doc_id: len(r.text.encode()) for r in rows}


def test_counts_of_odd_texts_equal_the_library(counts):
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "​", "'s", "'S", "'ll",
             "a", "Zz", "1", "²", "½", "é", "é", "😀", "-", "!!", "中", "ß", "՘", "؀", "'", "’s"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)]))
                     for _ in range(rng.randrange(14))) for _ in range(4000)] + ["x" * 50000, " " * 3000, "", "ab " * 9000]
    assert counts.count(texts) == [len(counts.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_splitting_is_proven_for_its_ranges(counts):
    """Every code point of the ranges falls in the same class here and in the tokenizer."""
    pre = counts.tokenizer.pre_tokenizer
    for lo, hi in ((0x80, 0x557), (0x1E00, 0x208E), (0x20A0, 0xA7CD)):
        for c in map(chr, range(lo, hi + 1)):
            assert not tokens.UNPROVEN.search(c)
            for probe in ("a" + c + "a", "1" + c + "1", "-" + c + "-", " " + c + " "):
                assert len(counts.split.findall(probe)) == len(pre.pre_tokenize_str(probe)), hex(ord(c))


def test_forgetting_does_not_change_counts(counts, monkeypatch):
    texts = [f"unseen{i}words{i * 7} and more{i}" for i in range(300)]
    want = counts.count(texts)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    assert [n for i in range(0, 300, 30) for n in counts.count(texts[i:i + 30])] == want


def test_token_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "hello world", "a"), (3, "hello world", "a"), (3, "hello world", "a")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 11, 2, False), (3, 11, 2, False), (3, 11, 2, False)], key=str)
    assert tokens.token_counts(docs_of(spark, rows).limit(0)).count() == 0


# ---- license scans ----------------------------------------------------------------------------

def words_of(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).split()


def brute_share(text, template):
    """Best share of a template's shingles within any stretch of twice its length."""
    w, t = words_of(text), words_of(template)
    want = {tuple(t[i:i + 5]) for i in range(len(t) - 4)}
    have = [tuple(w[i:i + 5]) in want and tuple(w[i:i + 5]) for i in range(max(0, len(w) - 4))]
    span = len(t)
    return max((len({h for h in have[i:i + span] if h}) / len(want) for i in range(max(1, len(have)))), default=0.0)


def test_licenses_equal_brute_force():
    rng = random.Random(11)
    noise = lambda n: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))
    scanner = licenses.Scanner()
    texts = ["", "the MIT License", noise(400)]
    for name, template in licenses.TEMPLATES:
        for edits in (0, 1, 3):
            words = template.split()
            for _ in range(edits):
                words[rng.randrange(len(words))] = "changed"
            texts.append(f"{noise(rng.randrange(60))} {' '.join(words).upper()} {noise(rng.randrange(60))}")
    texts.append(f"{licenses.TEMPLATES[9][1]}. {noise(50)} {licenses.TEMPLATES[9][1]}!")
    got = scanner.scan([t.encode() for t in texts])
    for text, rows in zip(texts, got):
        best = defaultdict(float)
        for name, template in licenses.TEMPLATES:
            best[name] = max(best[name], brute_share(text, template))
        assert {r[0] for r in rows} == {n for n, s in best.items() if s >= 0.8}, text[:80]
        for name, share, first, count in rows:
            assert share <= best[name] + 1e-9 and first >= 0 and count >= 1
    assert got[-1] == [("MIT", 1.0, 0, 2)]


def test_relatives_get_their_own_name():
    """Whole texts and notices of near relatives, alone, in upper case amid other words, and with a few words changed."""
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))
    scanner = licenses.Scanner()
    table = licenses.RELATIVES + licenses.WHOLE
    assert {"GPL-2.0", "LGPL-2.1", "AGPL-3.0", "BSD-2-Clause", "CC0-1.0", "Unlicense"} <= {n for n, _ in licenses.WHOLE}
    for name, text in table:
        words = text.split()
        assert [r[0] for r in scanner.scan([text.encode()])[0]] == [name]
        assert [r[0] for r in scanner.scan([f"{noise(30)} {text.upper()} {noise(30)}".encode()])[0]] == [name]
        if len(words) > 100:  # as many changes as a twentieth of the containment allows
            for _ in range(len(words) // 100):
                words[rng.randrange(len(words))] = "changed"
            assert [r[0] for r in scanner.scan([" ".join(words).encode()])[0]] == [name]
    both = f"{licenses.RELATIVES[0][1]}. {noise(40)} {licenses.RELATIVES[5][1]}."
    assert [r[0] for r in scanner.scan([both.encode()])[0]] == ["AGPL-3.0-or-later", "LGPL-2.1-or-later"]


def test_band_settings_guarantee():
    for m in range(1, 200):
        rows, bands = licenses.band_settings(m)
        j = licenses.least_jaccard(m)
        assert 1 - (1 - j ** rows) ** bands >= licenses.GUARANTEE or j >= 1


def test_license_scan_of_the_table_and_cases(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {(r.doc_id, r.license) for r in queries.QUERIES["op7_scan_licenses"](spark, SF_SMALL).collect()}
    want = {(r.doc_id, name) for r in docs.collect() for name, t in licenses.TEMPLATES if brute_share(r.text, t) >= 0.8}
    assert got == want
    rows = [(1, None, "a"), (2, "", "a"), (3, "Released under the MIT License.", "a"), (3, "Released under the MIT License.", "a"),
            (None, "x " * 30000 + "licensed under cc by-nc 4.0", "a")]
    found = licenses.scan_licenses(docs_of(spark, rows))
    assert sorted(((r.doc_id, r.license, r.first_word) for r in found.collect()), key=str) == sorted(
        [(3, "MIT", 0), (3, "MIT", 0), (None, "CC-BY-NC-4.0", 30000)], key=str)
    assert licenses.scan_licenses(docs_of(spark, rows).limit(0)).count() == 0


def test_chunk_counts_hold_few_keys_however_many_pieces(monkeypatch):
    """Equal keys are added up by the number of keys held, not by that of pieces; the counts stay the same."""
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 16_000, np.uint8)).decode()
    rows = pa.record_batch([pa.array(range(60)), pa.array([i % 5 == 1 for i in range(60)]), pa.array([text] * 60), pa.array([0] * 59 + [1])],
                           ["doc_id", "held_out", "text", "chunk"])
    run = ppm._chunk_counts(lambda texts: ppm.ngram_keys(texts, ppm.MAX_ORDER))
    whole = [b.to_pydict() for b in run(iter([rows]))]
    monkeypatch.setattr(ppm, "MAX_HELD", 40_000)
    monkeypatch.setattr(ppm, "WORK_BYTES", 16_000)
    tracemalloc.start()
    got = list(run(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b.to_pydict() for b in got] == whole
    assert peak < 8 << 20  # sixty pieces of 16,001 keys and counts take 15 MB


def test_chunk_counts_add_up_distinct_keys_a_range_at_a_time(monkeypatch):
    """Where all keys differ, adding them up takes little besides the keys and counts held."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 16_000, np.uint8)).decode() for _ in range(60)]
    rows = pa.record_batch([pa.array(range(60)), pa.array([i % 5 == 1 for i in range(60)]), pa.array(texts), pa.array([0] * 60)],
                           ["doc_id", "held_out", "text", "chunk"])
    monkeypatch.setattr(ppm, "MAX_HELD", 40_000)
    monkeypatch.setattr(ppm, "WORK_BYTES", 16_000)
    monkeypatch.setattr(ppm, "WORK_KEYS", 10_000, raising=False)
    n, peak, got = 0, 0, Counter()
    tracemalloc.start()
    for batch in ppm._chunk_counts(lambda part: ppm.ngram_keys(part, ppm.MAX_ORDER))(iter([rows])):
        n += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 900_000
    assert peak < 48 * n  # 16 bytes a key and count: the pieces, and what they are added up to
    seen, _ = ppm.ngram_keys([ppm.normalised(t.encode()) for i, t in enumerate(texts) if i % 5 != 1], ppm.MAX_ORDER)
    for batch in ppm._chunk_counts(lambda part: ppm.ngram_keys(part, ppm.MAX_ORDER))(iter([rows])):
        got.update(dict(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))
    want = Counter(seen.view(np.int64).tolist())
    assert len(got) == n and {k: c for k, c in got.items() if c} == want


def test_pieces_are_added_up_by_ranges_of_bounded_size(monkeypatch):
    rng = np.random.default_rng(1)
    for most in (1, 7, 100):
        monkeypatch.setattr(ppm, "WORK_KEYS", most)
        for n_pieces in (1, 3, 12):
            pieces = [(np.unique(rng.integers(0, top, 200).astype(np.uint64)), None) for top in rng.choice([3, 90, 5000], n_pieces)]
            pieces = [(k, rng.integers(0, 4, len(k))) for k, _ in pieces] + [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            got = list(ppm._added(pieces))
            want = Counter()
            for k, c in pieces:
                want.update(dict(zip(k.tolist(), c.tolist())))
            assert [k for part, _ in got for k in part.tolist()] == sorted(want)
            assert [c for _, part in got for c in part.tolist()] == [want[k] for k in sorted(want)]
            assert max(len(k) for k, _ in got) <= 2 * max(most, len(pieces))
