"""Learned language tags: brute-force scores, held-out accuracy, short and accented texts, odd inputs."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import language

from conftest import SF_SMALL, rows

SAID = {"en": "the house and the water with that friend is here", "de": "das Haus und das Wasser mit jenem Freund ist für Öl hier",
        "fr": "la maison et l'eau avec cet ami est déjà là où garçon", "el": "το σπίτι και το νερό με τον φίλο είναι εδώ"}


def _docs(spark, more=()):
    known = [(i, SAID[x], x) for i, x in enumerate(list(SAID) * 3)]
    return spark.createDataFrame([*known, *more], "doc_id bigint, text string, lang string")


def _tags(spark, docs):
    words = language.document_words(docs)
    return {r.doc_id: r.lang_tag for r in language.tag(docs, words, language.learn(words, docs)).collect()}


def test_short_and_accented_texts(spark):
    more = [(100, "für", None), (101, "garçon", None), (102, "φίλο", None), (103, "water", None), (104, None, None), (105, "", None), (106, "12 !?", None)]
    got = _tags(spark, _docs(spark, more))
    assert [got[i] for i in range(100, 107)] == ["de", "fr", "el", "en", "", "", ""]
    assert all(got[i] == x for i, x in enumerate(list(SAID) * 3))


def test_scores_equal_brute_force(spark):
    docs = _docs(spark, [(50, "haus house maison", None), (51, "zzz qqq", None), (52, "the the the das", None)])
    data = [tuple(r) for r in docs.collect()]
    grams = lambda w: [f"^{w}$"[i:i + 3] for i in range(len(w))]
    import re
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    count = defaultdict(Counter)
    for _, text, lang in data:
        if lang:
            count[lang].update(g for w in words(text) for g in grams(w))
    kinds = len(set().union(*count.values()))

    def best(text):
        found = [g for w in words(text) for g in grams(w)]
        score = {x: sum(math.log((c[g] + 0.5) / (c.total() + 0.5 * kinds)) for g in found) for x, c in count.items()}
        return min(score, key=lambda x: (-score[x], x)) if found else ""
    assert _tags(spark, docs) == {i: best(t) for i, t, _ in data}


def test_accuracy_of_held_out_documents(spark):
    tags = language.measured_tags(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang"))
    held = tags.filter("held_out and lang is not null")
    assert held.count() > 20 and held.filter(F.col("lang") == F.col("lang_tag")).count() / held.count() > 0.95


def test_nothing_labelled_and_long_labels(spark):
    docs = _docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert set(_tags(spark, docs).values()) == {""}
    assert _tags(spark, docs.limit(0)) == {}
    long = _docs(spark).withColumn("lang", F.lit("language"))
    assert set(_tags(spark, long).values()) == {""}  # a tag has at most five characters


@pytest.mark.parametrize("word,want", [("ab", ["^ab", "ab$"]), ("é", ["^é$"]), ("𐐷x", ["^𐐷x", "𐐷x$"])])
def test_trigrams(spark, word, want):
    assert rows(spark.createDataFrame([(word,)], "w string").select(language.trigrams(F.col("w")))) == [(want,)]
