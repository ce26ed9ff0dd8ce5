"""A stored text index in immutable segments, with postings in blocks.

A change batch adds one segment: the postings of the new bodies, and the ids whose earlier postings are
dead.  Nothing stored before is written again, until the merge rule joins the newest segments: a segment
is merged with the one before it once that one is no longer MERGE_RATIO times its size.  So a posting is
rewritten a number of times that grows with the logarithm of the index, and there are as few segments.

A block holds the postings of one term in a range of 2^BLOCK_BITS ids, with the largest term frequency and
the smallest document length among them, which bound the score any of its postings can give.  A search
first scores the blocks of the highest bounds; documents that cannot reach the page's last score found
there are never scored: a block is left out if its bound, plus the best that the other terms offer in the
same ids, stays below.  The result is that of a full scan.

``<root>/segment=N`` is written before the manifest that names it, and readers take the newest complete
manifest, so a failed or repeated update leaves the index as it was.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import query_terms
from ..sinks import epochs
from . import search

#: Ids that a block covers, in bits.
BLOCK_BITS = 9
#: A segment stays apart while the one before it is more than so many times as large.
MERGE_RATIO = 4
#: Blocks that are scored first.
PROBE_BLOCKS = 64

_MANIFEST = "segments array<int>, sizes array<bigint>, n_docs bigint, n_texts bigint, total_len bigint"


# ---- storage ---------------------------------------------------------------------------------

def manifest(spark: SparkSession, root: str) -> dict:
    """The current generation: segments (oldest first), their numbers of postings, documents and tokens."""
    generations = epochs.numbered(spark, f"{root}/manifest", "gen")
    if not generations:
        return {"gen": -1, "segments": [], "sizes": [], "n_docs": 0, "n_texts": 0, "total_len": 0}
    row = spark.read.schema(_MANIFEST).json(f"{root}/manifest/gen={generations[-1]}").first()
    return {"gen": generations[-1], **row.asDict()}


def _publish(spark: SparkSession, root: str, now: dict) -> None:
    row = (now["segments"], now["sizes"], now["n_docs"], now["n_texts"], now["total_len"])
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifest/gen={now['gen'] + 1}")


def _sums(lengths: DataFrame) -> dict[str, int]:
    """Documents, documents with a text (a null one has no length), tokens."""
    row = lengths.agg(F.count(F.lit(1)), F.count("doc_len"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    return dict(zip(("n_docs", "n_texts", "total_len"), row))


def _write_segment(rows: DataFrame, gone: DataFrame, path: str) -> tuple[int, dict[str, int]]:
    """Store token rows (term, doc_id, tf, doc_len; a null term for a document without tokens) and dead ids;
    returns the number of postings, and the sums of the lengths.  One shuffle, by range, merges rows of one
    document, makes the blocks and sorts them."""
    spark = rows.sparkSession
    dealt = rows.withColumn("block", F.shiftright("doc_id", BLOCK_BITS)).repartitionByRange("term", "block")
    posting = F.struct("doc_id", F.col("tf").cast("int").alias("tf"), F.col("doc_len").cast("int").alias("doc_len"))
    rows = (search.merged(dealt, "block").groupBy("term", "block").agg(
        F.array_sort(F.collect_list(posting)).alias("p"), F.max("tf").cast("int").alias("max_tf"), F.min("doc_len").cast("int").alias("min_len")))
    (rows.select("term", "block", F.size("p").alias("n"), "max_tf", "min_len", F.col("p.doc_id").alias("docs"),
                 F.col("p.tf").alias("tfs"), F.col("p.doc_len").alias("lens"))
     .sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks"))
    stored = spark.read.parquet(f"{path}/blocks")
    (stored.select(F.explode(F.arrays_zip("docs", "lens")).alias("p")).groupBy(F.col("p.docs").alias("doc_id"))
     .agg(F.max("p.lens").cast("long").alias("doc_len")).write.mode("overwrite").parquet(f"{path}/lengths"))
    gone.select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/gone")
    size = stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return size, _sums(spark.read.parquet(f"{path}/lengths"))


def _no_ids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id bigint")


def write_index(docs: DataFrame, id_col: str, text_cols: list[str], root: str) -> str:
    """Index whole texts as the first segment of a new index."""
    spark, root = docs.sparkSession, root.rstrip("/")
    if manifest(spark, root)["segments"]:
        raise ValueError(f"{root} holds an index")
    size, sums = _write_segment(search.token_rows(docs, id_col, text_cols), _no_ids(spark), f"{root}/segment=0")
    _publish(spark, root, {"gen": -1, "segments": [0], "sizes": [size], **sums})
    return root


def update_index(spark: SparkSession, root: str, changes: DataFrame) -> list[int]:
    """Apply a change batch (op, id, body): ``delete`` and ``update`` end a document's postings, ``add`` and
    ``update`` index the body.  Writes a segment of the batch, and merges by the rule; returns the segments."""
    root = root.rstrip("/")
    now = manifest(spark, root)
    number = max(now["segments"], default=-1) + 1
    touched = changes.select(F.col("id").alias("doc_id")).distinct()
    fresh = search.token_rows(changes.filter(F.col("op").isin("add", "update")), "id", ["body"])
    size, sums = _write_segment(fresh, touched, f"{root}/segment={number}")
    touched = spark.read.parquet(f"{root}/segment={number}/gone")
    if now["segments"]:
        ended = _sums(_live(_tables(spark, root, now, "lengths").join(touched, "doc_id", "left_semi"),
                            _gone(spark, root, now).join(touched, "doc_id", "left_semi")))
        sums = {k: now[k] - ended[k] + v for k, v in sums.items()}
    now = {"gen": now["gen"], "segments": [*now["segments"], number], "sizes": [*now["sizes"], size], **sums}
    _publish(spark, root, now)
    return _merge(spark, root)


def _merge(spark: SparkSession, root: str) -> list[int]:
    """Join the newest segments while the one before is not MERGE_RATIO times as large."""
    now = manifest(spark, root)
    segments, sizes = now["segments"], now["sizes"]
    first = len(segments) - 1
    while first > 0 and sizes[first - 1] <= MERGE_RATIO * sum(sizes[first:]):
        first -= 1
    if first == len(segments) - 1:
        return segments
    part = {"segments": segments[first:]}
    number = segments[-1] + 1
    gone = _gone(spark, root, part) if first else _no_ids(spark)  # with nothing before, no id has dead postings
    rows = _live(_postings(_blocks(spark, root, part)), _gone(spark, root, part))
    size, _ = _write_segment(rows.select("term", "doc_id", "tf", "doc_len"), gone, f"{root}/segment={number}")
    _publish(spark, root, {**now, "segments": [*segments[:first], number], "sizes": [*sizes[:first], size]})
    return [*segments[:first], number]


# ---- reading ---------------------------------------------------------------------------------

def _tables(spark: SparkSession, root: str, now: dict, name: str) -> DataFrame:
    """A table of all segments of a generation, with its segment's place (pos; later ones are newer)."""
    out = None
    for pos, number in enumerate(now["segments"]):
        own = spark.read.parquet(f"{root}/segment={number}/{name}").withColumn("pos", F.lit(pos))
        out = own if out is None else out.unionByName(own)
    return out


def _blocks(spark: SparkSession, root: str, now: dict) -> DataFrame:
    return _tables(spark, root, now, "blocks")


def _gone(spark: SparkSession, root: str, now: dict) -> DataFrame:
    """(doc_id, gone): the newest segment that ends a document's earlier postings."""
    return _tables(spark, root, now, "gone").groupBy("doc_id").agg(F.max("pos").alias("gone"))


def _live(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, ...) whose document no later segment ends."""
    return rows.join(gone, "doc_id", "left").filter(F.col("gone").isNull() | (F.col("gone") <= F.col("pos"))).drop("gone")


def _postings(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, tf, doc_len, pos) of blocks."""
    return (blocks.select("term", "pos", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("p"))
            .select("term", "pos", F.col("p.docs").alias("doc_id"), F.col("p.tfs").cast("long").alias("tf"),
                    F.col("p.lens").cast("long").alias("doc_len")))


def live_postings(spark: SparkSession, root: str) -> DataFrame:
    """(term, doc_id, tf, doc_len): all postings of the index, as a rebuild would give them."""
    now = manifest(spark, root.rstrip("/"))
    rows = _postings(_blocks(spark, root.rstrip("/"), now))
    return _live(rows, _gone(spark, root.rstrip("/"), now)).filter(F.col("term").isNotNull()).select("term", "doc_id", "tf", "doc_len")


# ---- search ----------------------------------------------------------------------------------

def _per_term(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("term")]


class Search:
    """A search of the current generation: whole matches, totals, and pages that read few postings."""

    def __init__(self, spark: SparkSession, root: str, query: str, k1: float = config.BM25_K1, b: float = config.BM25_B):
        self.spark, self.root, self.k1, self.b = spark, root.rstrip("/"), k1, b
        self.now, self.terms = manifest(spark, self.root), query_terms(query)
        self.blocks = None
        if self.now["segments"] and self.terms:
            self.blocks = _blocks(spark, self.root, self.now).filter(F.col("term").isin(self.terms))
        self.changed = len(self.now["segments"]) > 1

    def _alive(self, rows: DataFrame) -> DataFrame:
        return _live(rows, _gone(self.spark, self.root, self.now)) if self.changed else rows

    def _ids(self) -> DataFrame:
        """(term, doc_id) of all live matches; reads no frequencies or lengths."""
        return self._alive(self.blocks.select("term", "pos", F.explode("docs").alias("doc_id")))

    def frequencies(self) -> dict[str, int]:
        """Live documents of each term (a row per term of the request): from the blocks' headers as long as no
        segment ends postings."""
        rows = (self._ids().groupBy("term").agg(F.count(F.lit(1)).alias("df")) if self.changed
                else self.blocks.groupBy("term").agg(F.sum("n").alias("df")))
        return {r.term: r.df for r in rows.collect()}

    def total(self) -> int:
        """Documents that match any term, exactly: ids become bits, so tasks pass on bitmaps instead of ids."""
        if self.blocks is None:
            return 0
        bits = (self._ids().groupBy(F.bitmap_bucket_number("doc_id").alias("at"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits")))
        return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]

    def _bounded(self, idf: dict[str, float], avg_len: float) -> DataFrame:
        """Blocks with `most`: the highest score a document in them can have."""
        best = self._part(F.col("max_tf"), F.col("min_len"), idf, avg_len)
        tops = self.blocks.select("block", "term", best.alias("best")).groupBy("block", "term").agg(F.max("best").alias("top"))
        sums = tops.groupBy("block").agg(F.sum("top").alias("all"))
        others = tops.join(sums, "block").select("block", "term", (F.col("all") - F.col("top")).alias("others"))
        return self.blocks.join(others, ["block", "term"]).withColumn("most", best + F.col("others"))

    def _part(self, tf: Column, doc_len: Column, idf: dict[str, float], avg_len: float) -> Column:
        norm = F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * doc_len / F.lit(avg_len))
        return _per_term(idf) * tf * F.lit(self.k1 + 1) / (tf + norm)

    def _scores(self, blocks: DataFrame, idf: dict[str, float], avg_len: float) -> DataFrame:
        rows = self._alive(_postings(blocks))
        part = self._part(F.col("tf"), F.col("doc_len"), idf, avg_len)
        return rows.groupBy("doc_id").agg(F.sum(part).alias("score"))

    def candidates(self, wanted: int) -> tuple[DataFrame, DataFrame] | None:
        """Blocks that may hold one of the `wanted` best documents, and the scores of what they hold."""
        df = self.frequencies() if self.blocks is not None else {}
        if not df:
            return None
        n, avg_len = self.now["n_docs"], self.now["total_len"] / self.now["n_texts"]
        idf = {t: math.log(1.0 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        bounded = self._bounded(idf, avg_len)
        probe = bounded.orderBy(F.col("most").desc(), "term", "pos", "block").limit(PROBE_BLOCKS)
        last = self._scores(probe, idf, avg_len).orderBy(F.col("score").desc()).offset(wanted - 1).limit(1).first()
        kept = bounded if last is None else bounded.filter(F.col("most") >= last.score * (1 - 1e-9))
        return kept, self._scores(kept, idf, avg_len)

    def page(self, page_no: int = 1, per_page: int = config.API_PER_PAGE_DEFAULT) -> DataFrame:
        """(rank, doc_id, score, total_hits) of one page, best first, ties to the smaller id.  A page without
        hits is one row of nulls with the total."""
        if per_page > config.API_PER_PAGE_MAX:
            raise ValueError(f"a page has at most {config.API_PER_PAGE_MAX} hits, not {per_page}")
        before = (max(int(page_no), 1) - 1) * per_page
        total = self.total()
        none = self.spark.createDataFrame([(None, None, None, total)], "rank int, doc_id bigint, score double, total_hits bigint")
        found = self.candidates(before + per_page) if before < total else None
        if found is None:
            return none
        best = [F.col("score").desc(), F.col("doc_id")]
        top = found[1].orderBy(*best).offset(before).limit(per_page)  # a page: ranking it in one task is bounded
        ranked = top.withColumn("rank", (F.row_number().over(Window.orderBy(*best)) + F.lit(before)).cast("int"))
        return ranked.select("rank", "doc_id", "score", F.lit(total).cast("long").alias("total_hits"))
