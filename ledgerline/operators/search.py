"""Full-text index and ranked search as DataFrame jobs.

The index is a postings table (term, doc_id, tf) plus a document-length
table, built once and stored (``write_index``); search filters the postings on
the query terms (pushed into the scan), joins the document lengths and scores
with BM25 as column arithmetic.  Whole texts are tokenised; nothing is
truncated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import STOP_WORDS, query_terms, tokens


def _text_of(df: DataFrame, text_cols: list[str]):
    if len(text_cols) == 1:
        return F.col(text_cols[0])
    return F.concat_ws(" ", *[F.col(c) for c in text_cols])


#: Rows whose tokens are counted at once.
WORK_ROWS = 256


def _rows_counted():
    """mapInArrow function: rows (doc_id, words: tokens joined by blanks, doc_len) -> a row for each distinct
    token of each row; one with a null term where there is no token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, WORK_ROWS):
                ids, words, lens = whole.slice(a, WORK_ROWS).columns
                filled = np.flatnonzero(pc.fill_null(pc.greater(lens, 0), False).to_numpy(zero_copy_only=False))
                none = np.setdiff1d(np.arange(len(lens)), filled)
                toks = pc.split_pattern(words.take(pa.array(filled)), " ")
                coded = toks.flatten().dictionary_encode()
                kinds = max(len(coded.dictionary), 1)
                rows = np.repeat(np.arange(len(filled)), pc.list_value_length(toks).to_numpy())
                keys, tf = np.unique(rows * kinds + coded.indices.to_numpy(), return_counts=True)
                row = pa.array(np.concatenate([filled[keys // kinds], none]))
                term = pa.concat_arrays([coded.dictionary.take(pa.array(keys % kinds)), pa.nulls(len(none), coded.dictionary.type)])
                tf = pa.array(np.concatenate([tf, np.ones(len(none), np.int64)]))
                yield pa.RecordBatch.from_arrays([term, ids.take(row), tf, lens.take(row)], ["term", "doc_id", "tf", "doc_len"])
    return run


def token_rows(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(term, doc_id, tf, doc_len): the tokens of each row, counted within the row; a row without tokens
    appears once with a null term (so its length is kept).

    Only documents of several rows have a term twice: :func:`merged` adds these up.  Counting row by row holds
    a few rows; a hash table of all (term, doc_id) of a task would grow with its texts and spill."""
    tok = docs.select(F.col(id_col).alias("doc_id"), tokens(_text_of(docs, text_cols)).alias("_toks"))
    kind = tok.schema["doc_id"].dataType.simpleString()
    return (tok.select("doc_id", F.array_join("_toks", " ").alias("words"), F.size("_toks").cast("long").alias("doc_len"))
            .mapInArrow(_rows_counted(), f"term string, doc_id {kind}, tf bigint, doc_len bigint"))


def merged(rows: DataFrame, *more: str) -> DataFrame:
    """One row per (term, doc_id) of token rows that are partitioned by any of these columns, sorted by them.

    The largest length is that of a struct: Spark then merges neighbours of the sorted rows.  A hash table
    would hold a whole partition, twice."""
    return (rows.groupBy("term", *more, "doc_id").agg(F.sum("tf").alias("tf"), F.max(F.struct("doc_len")).alias("_l"))
            .select("term", *more, "doc_id", "tf", F.col("_l.doc_len").alias("doc_len")))


def token_counts(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(term, doc_id, tf, doc_len) from one tokenisation pass; a document
    without tokens appears once with a null term (so its length is kept).

    Rows are shuffled as they are: nearly all are distinct, so adding them up before would save nothing."""
    return merged(token_rows(docs, id_col, text_cols).repartition("term", "doc_id"))


def build_index(docs: DataFrame, id_col: str, text_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings (term, doc_id, tf) and lengths (doc_id, doc_len), lazily.

    Each of the two is a separate plan over the texts; jobs that use both
    should store the index once with :func:`write_index`.
    """
    counts = token_counts(docs, id_col, text_cols)
    postings = counts.filter(F.col("term").isNotNull()).select("term", "doc_id", "tf")
    lengths = counts.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
    return postings, lengths


def _store(rows: DataFrame, root: str) -> str:
    """Write token rows (term, doc_id, tf, doc_len) as an index: one shuffle, by range, merges and sorts them."""
    root = root.rstrip("/")
    (merged(rows.repartitionByRange("term", "doc_id")).sortWithinPartitions("term", "doc_id")
     .write.mode("overwrite").parquet(f"{root}/postings"))
    spark = rows.sparkSession
    (spark.read.parquet(f"{root}/postings").groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
     .write.mode("overwrite").parquet(f"{root}/lengths"))
    (spark.read.parquet(f"{root}/lengths").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
     .coalesce(1).write.mode("overwrite").parquet(f"{root}/corpus"))
    return root


def write_index(docs: DataFrame, id_col: str, text_cols: list[str], root: str) -> str:
    """Build and store the index: ``<root>/postings`` (term, doc_id, tf,
    doc_len), ``<root>/lengths`` (doc_id, doc_len) and ``<root>/corpus`` (one
    row: n_docs, avg_len).

    Postings are range-partitioned and sorted by (term, doc_id): a term lies in
    few files, which a term filter finds by their statistics, and a frequent
    term is still split over several.  The texts are tokenised twice (the ranges come from a sample); lengths
    and corpus numbers are read back from the stored postings."""
    return _store(token_rows(docs, id_col, text_cols), root)


def update_index(spark: SparkSession, root: str, changes: DataFrame, new_root: str) -> str:
    """Store the index after a change batch (op, id, body) under ``new_root``:
    ``delete`` and ``update`` drop a document's postings, ``add`` and
    ``update`` index the body.  Readers keep the old index until then."""
    touched = changes.select(F.col("id").alias("doc_id")).distinct()
    old = spark.read.parquet(f"{root.rstrip('/')}/postings")
    kept = old.join(touched, "doc_id", "left_anti").select("term", "doc_id", "tf", "doc_len")
    fresh = token_rows(changes.filter(F.col("op").isin("add", "update")), "id", ["body"])
    return _store(kept.unionByName(fresh), new_root)


def read_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of a stored index."""
    root = root.rstrip("/")
    postings = (spark.read.parquet(f"{root}/postings").filter(F.col("term").isNotNull())
                .select("term", "doc_id", "tf"))
    return postings, spark.read.parquet(f"{root}/lengths")


def _matching(postings: DataFrame, query: str) -> DataFrame:
    """Postings of the query's terms.  An IN-list on the grouping key is pushed
    below the postings aggregate, and into the scan of a stored index."""
    terms = query_terms(query)
    return postings.filter(F.col("term").isin(terms)) if terms else postings.limit(0)


def _page_of_hits(hits: DataFrame, n_docs, avg_len, page_no: int, per_page: int, k1: float, b: float) -> DataFrame:
    """Score matching postings (term, doc_id, tf, doc_len) and cut the page."""
    if per_page > config.API_PER_PAGE_MAX:
        raise ValueError(f"a page has at most {config.API_PER_PAGE_MAX} hits, not {per_page}")
    # One row per query term (bounded by the request): broadcast, so the
    # postings of a very common term are never a hot join key.
    dfreq = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(F.broadcast(dfreq), "term")
    idf = F.log(F.lit(1.0) + (n_docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("doc_len") / avg_len)
    part = idf * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + norm)
    per_doc = scored.groupBy("doc_id").agg(F.sum(part).alias("score"))
    total = hits.agg(F.count_distinct("doc_id")).scalar()
    p = max(int(page_no), 1)
    top = per_doc.orderBy(F.col("score").desc(), F.col("doc_id")).offset((p - 1) * per_page).limit(per_page)
    # The page holds at most per_page rows: ranking it in one task is bounded.
    w = Window.orderBy(F.col("score").desc(), F.col("doc_id"))
    ranked = top.withColumn("rank", F.row_number().over(w) + F.lit((p - 1) * per_page))
    return ranked.select("rank", "doc_id", "score", total.alias("total_hits"))


def search(spark: SparkSession, postings: DataFrame, lengths: DataFrame, query: str,
           page_no: int = 1, per_page: int = config.API_PER_PAGE_DEFAULT,
           k1: float = config.BM25_K1, b: float = config.BM25_B) -> DataFrame:
    """One page of BM25 hits of an index that is not stored: (rank, doc_id,
    score, total_hits).

    Any query term may match (OR).  Order: score desc, doc_id asc.  No
    matching term -> empty page; a page has at most API_PER_PAGE_MAX hits.
    The query terms are a request parameter (bounded by the query text).
    """
    stats = lengths.agg(F.struct(F.count(F.lit(1)).alias("n_docs"),
                                 F.avg("doc_len").alias("avg_len")).alias("s")).scalar()
    hits = _matching(postings, query).join(lengths, "doc_id")
    return _page_of_hits(hits, stats.getField("n_docs"), stats.getField("avg_len"), page_no, per_page, k1, b)


def search_stored(spark: SparkSession, root: str, query: str, page_no: int = 1,
                  per_page: int = config.API_PER_PAGE_DEFAULT,
                  k1: float = config.BM25_K1, b: float = config.BM25_B) -> DataFrame:
    """As :func:`search`, of a stored index.  Lengths come with the postings
    and the corpus numbers are stored, so only the query's postings are read."""
    root = root.rstrip("/")
    corpus = spark.read.parquet(f"{root}/corpus")
    n_docs, avg_len = corpus.select("n_docs").scalar(), corpus.select("avg_len").scalar()
    return _page_of_hits(_matching(spark.read.parquet(f"{root}/postings"), query), n_docs, avg_len, page_no, per_page, k1, b)


def total_hits(spark: SparkSession, root: str, query: str) -> int:
    """Number of documents that match, whatever the page (a page past the last
    hit has no row to carry it)."""
    return _matching(spark.read.parquet(f"{root.rstrip('/')}/postings"), query).agg(F.count_distinct("doc_id")).first()[0]


def hit_rows(rows: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of a page of hits, in rank order, with rank / score / total.

    The page holds at most API_PER_PAGE_MAX ids, so it is broadcast to the
    scan of the rows.
    """
    h = hits.withColumnRenamed("doc_id", id_col)
    return rows.join(F.broadcast(h), id_col).orderBy("rank")


def apply_changes(postings: DataFrame, changes: DataFrame,
                  lengths: DataFrame | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Postings after a change batch (op, id, body): ``delete`` and ``update``
    drop the document's old postings, ``add`` and ``update`` index the body.
    With ``lengths`` given, returns (postings, lengths) both updated."""
    touched = changes.select(F.col("id").alias("doc_id")).distinct()
    kept = postings.join(touched, "doc_id", "left_anti").select(*postings.columns)
    fresh_docs = changes.filter(F.col("op").isin("add", "update"))
    counts = token_counts(fresh_docs, "id", ["body"])
    fresh = counts.filter(F.col("term").isNotNull()).select("term", "doc_id", "tf")
    new_postings = kept.unionByName(fresh.select(*postings.columns))
    if lengths is None:
        return new_postings
    fresh_len = counts.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
    new_lengths = (lengths.join(touched, "doc_id", "left_anti").select("doc_id", "doc_len")
                   .unionByName(fresh_len))
    return new_postings, new_lengths


def stop_word_table(spark: SparkSession) -> DataFrame:
    rows = [(w, lang) for lang, words in STOP_WORDS.items() for w in words]
    return spark.createDataFrame(rows, "term string, lang string")


def language_tags(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, lang_tag): the language whose function words the text uses
    most (ties -> alphabetical); '' when none is found or the tag is longer
    than 5 characters.

    Tokens are exploded and probe the broadcast word list (a left join, so a
    document without any listed word still yields rows); one aggregate per
    document counts every language at once -- map-side partial aggregation
    reduces each document to one row before the single shuffle.  Everything
    stays in whole-stage code generation (higher-order array functions would
    run interpreted, several times slower per row).
    """
    keep = keep or []
    langs = sorted(STOP_WORDS)
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep,
                       F.explode_outer(tokens(F.col(text_col))).alias("term"))
    words = stop_word_table(spark).withColumnRenamed("lang", "_word_lang")
    hits = rows.join(F.broadcast(words), "term", "left")
    counts = hits.groupBy("doc_id", *keep).agg(
        *[F.count(F.when(F.col("_word_lang") == lang, F.lit(1))).alias(f"_n_{lang}") for lang in langs])
    best = F.array_min(F.array(*[F.struct((-F.col(f"_n_{lang}")).alias("neg_n"), F.lit(lang).alias("lang"))
                                 for lang in langs]))
    tag = F.when(best["neg_n"] < 0, best["lang"]).otherwise(F.lit(""))
    tag = F.when(F.length(tag) > config.MAX_LANGUAGE_TAG_LEN, F.lit("")).otherwise(tag)
    return counts.select("doc_id", *keep, tag.alias("lang_tag"))
