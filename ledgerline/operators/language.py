"""Language tags from letter trigrams: probabilities learned from labelled documents by aggregates, applied by joins.

A word is padded (``^word$``) and cut into trigrams of letters, of any alphabet.  Learning counts the trigrams
of each language's words; with add-ALPHA smoothing, a trigram counted c times adds ln(1 + c / ALPHA) to a
language's score beyond what an unseen one adds, so only seen trigrams are joined.  A document's score is the
sum over its words; a distinct word is scored once, however often it occurs.

The languages are columns: there is one for each label, a small list.  A document without a letter is tagged
``''``, and so is every document if nothing is labelled; equal scores go to the first tag.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..session import cut_lineage

#: Runs of letters, and the trigrams of a padded word (each from its own place, so in one pass; none from inside a letter).
WORD, TRIGRAM = r"\p{L}+", r"(?=([\p{L}^]..))"
#: Count that an unseen trigram is given.
ALPHA = 0.5


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word, n): lower-cased words of whole texts."""
    return (docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(WORD), 0)).alias("word"))
            .groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")))


def trigrams(word: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit("^"), word, F.lit("$")), F.lit(TRIGRAM), 1)


@dataclass
class LanguageModel:
    """Languages with the score of an unseen trigram, and a row per trigram with a column of scores per language
    (beyond the unseen one's), named by the language's place."""

    unseen: dict[str, float]
    grams: DataFrame

    def scores(self) -> list[str]:
        return [f"s{i}" for i in range(len(self.unseen))]


def learn(words: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> LanguageModel | None:
    """Model of the words (doc_id, word, n) of the documents that labels name; null labels are left out."""
    known = labels.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    spelt = words.join(known, "doc_id").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = cut_lineage(spelt.select("lang", "n", F.explode(trigrams(F.col("word"))).alias("gram"))
                         .groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    sizes = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()}
    if not sizes:
        return None
    kinds = counts.select("gram").distinct().count()
    unseen = dict(counts.sparkSession.createDataFrame(list(sizes.items()), "lang string, n bigint")
                  .select("lang", F.log(F.lit(ALPHA) / (F.col("n") + ALPHA * kinds))).collect())
    score = F.log1p(F.col("n") / ALPHA)
    grams = counts.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == lang, score)), F.lit(0.0)).alias(f"s{i}")
                                         for i, lang in enumerate(unseen)])
    return LanguageModel(unseen, cut_lineage(grams))


def tag(docs: DataFrame, words: DataFrame, model: LanguageModel | None, keep: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, *keep, lang_tag) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *(keep or []))
    if model is None:
        return rows.withColumn("lang_tag", F.lit(""))
    spelt = words.select("word").distinct().select("word", F.explode(trigrams(F.col("word"))).alias("gram"))
    scored = spelt.join(model.grams, "gram").groupBy("word").agg(*[F.sum(s).alias(s) for s in model.scores()])
    found = (words.join(scored, "word", "left").groupBy("doc_id")
             .agg(F.sum(F.col("n") * F.char_length("word")).alias("size"), *[F.sum(F.col("n") * F.coalesce(s, F.lit(0.0))).alias(s) for s in model.scores()]))
    best = F.array_min(F.array(*[F.struct((-(F.col(s) + F.col("size") * F.lit(floor))).alias("less"), F.lit(lang).alias("lang"))
                                 for s, (lang, floor) in zip(model.scores(), model.unseen.items())]))["lang"]
    own = F.when(F.char_length(best) <= config.MAX_LANGUAGE_TAG_LEN, best)
    return rows.join(found.select("doc_id", own.alias("own")), "doc_id", "left").select(
        "doc_id", *(keep or []), F.coalesce("own", F.lit("")).alias("lang_tag"))


def held_out(id_col: Column) -> Column:
    """Documents that a measured model does not learn from: 3 of 16, by a digest of the id."""
    return F.substring(F.md5(id_col.cast("string").cast("binary")), 1, 1).isin("0", "1", "2")


def measured_tags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, held_out, lang_tag): all documents, learned from the labels of those not held out."""
    words = cut_lineage(document_words(docs, id_col, text_col))
    apart = F.coalesce(held_out(F.col(id_col)), F.lit(False))
    model = learn(words, docs.filter(~apart).select(id_col, lang_col), id_col, lang_col)
    return tag(docs.withColumn("held_out", apart), words, model, [lang_col, "held_out"], id_col)
