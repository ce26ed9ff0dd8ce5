"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every window of n benchmark words is hashed into a set; each training document is scanned once, one
hash per word position, and a position found in the set is verified against all the window's words
(the hash itself takes every third word and the last, which is as selective and a third of the work).
The hit words are the union of the verified occurrences. Built-in functions only.

The set is broadcast while it has at most BROADCAST_ROWS windows and BROADCAST_BYTES bytes. A larger
one is joined through a shuffle, which a broadcast bitmap of the window hashes (MOST_BITS bits at
most) keeps small: of all positions only those whose bit is set leave their task, each with its own
words and without the text. A text of any length is worked on whole, in one task.

Defined results: a null or wordless text has no words and is never hit; an item of fewer words
than n is one window, a wordless item none; a null item id counts as the empty string; repeated
document rows each get the row's result, repeated items count once; an empty benchmark hits
nothing; columns beside the id and the text are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import BROADCAST_ROWS, ascii_lower, join_keys, text_key, whole_row

#: A word after lower-casing A-Z: digits, a-z and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, with what follows it up to the next word.
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
LEAD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"

WINDOW = 13
#: A document is contaminated if at least one word in SHARE is hit.
SHARE = 20
#: Most bytes of windows and item ids that are broadcast.
BROADCAST_BYTES = 32 << 20
#: The bitmap: bits per window, bits in all at most (32 MB), 64-bit words in a row of it.
WINDOW_BITS, MOST_BITS, ROW_WORDS = 16, 1 << 28, 512


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """One row per distinct window: its hash, its words, their number and the items that hold it."""
    words = (benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                              _words(F.col(text_col)).alias("w"))
             .filter(F.size("w") > 0))
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    return (words.select("item", "w", F.explode(at).alias("i"))
            .select("item", F.slice("w", F.col("i"), F.lit(n)).alias("w"))
            .select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("len"), _hash_of("w").alias("h"))
            .groupBy("h", "window", "len").agg(F.collect_set("item").alias("items")))


def _keyed(k: int, length: int) -> bool:
    """Whether a window's hash takes its k-th word: every third one and the last."""
    return k % 3 == 0 or k == length - 1


def _hash_of(window: str) -> Column:
    return F.xxhash64(F.filter(window, lambda x, k: (k % 3 == 0) | (k == F.size(window) - 1)))


def _window_hashes(words: Column, length: int) -> Column:
    """One hash per position of a window of `length` words, equal to :func:`_hash_of` of its words."""
    n = F.size(words)
    at = F.when(n >= length, F.sequence(F.lit(0), n - length))
    parts = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(length) if _keyed(k, length)])
    return F.coalesce(F.transform(at, parts), F.array().cast("array<bigint>"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id",
              text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document row: id, text key, n_words, hits (sorted array of struct(pos, len) of verified
    occurrences, 0-based word positions) and items (sorted ids of the items found)."""
    windows = cut_lineage(benchmark_windows(benchmark, n, item_col, item_text_col))
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # n values at most
    item_bytes = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
    count, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window") + item_bytes + 32), F.lit(0))).first()
    words = docs.select(F.col(id_col).alias("__id"), *text_key(F.col(text_col)), _words(F.col(text_col)).alias("__w"))
    # element 0 stands for the document itself, so that each row survives the scan
    scanned = F.concat(F.array(F.lit(0).cast("long")), *[_window_hashes(F.col("__w"), k) for k in lengths])
    rows = words.select("__id", "__text_hash", "__text_bytes", "__w", F.size("__w").alias("__n"),
                        F.posexplode(scanned).alias("__g", "__h"))
    pos, length = F.col("__g"), F.lit(0)
    for i, k in reversed(list(enumerate(lengths))):
        later = F.col("__g") >= _start(lengths, i + 1)
        pos = F.when(later, pos).otherwise(F.col("__g") - _start(lengths, i))
        length = F.when(later, length).otherwise(F.lit(k))
    own = F.array_join(F.slice("__w", F.col("__pos") + 1, F.col("__len")), " ")
    small = count <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    if small:
        found = (rows.join(F.broadcast(windows), (F.col("__g") > 0) & (F.col("__h") == F.col("h")), "left")
                 .withColumns({"__pos": pos, "__len": length})
                 .filter((F.col("__g") == 0) | ((F.col("len") == F.col("__len")) & (own == F.col("window")))))
    else:
        found = _shuffled(rows, windows, count, pos, length, own)
    hit = F.when(F.col("__g") > 0, F.struct(F.col("__pos").alias("pos"), F.col("__len").alias("len")))
    marked = found.select("__id", "__text_hash", "__text_bytes", "__n", hit.alias("hit"),
                          F.when(F.col("__g") > 0, F.col("items")).alias("items"),
                          (F.col("__g") == 0).cast("int").alias("one"))
    if not small:  # the documents themselves take no part in that join
        marked = marked.unionByName(words.select(
            "__id", "__text_hash", "__text_bytes", F.size("__w").alias("__n"),
            F.lit(None).cast(marked.schema["hit"].dataType).alias("hit"),
            F.lit(None).cast("array<string>").alias("items"), F.lit(1).alias("one")))
    return (marked.groupBy("__id", "__text_hash", "__text_bytes")
            .agg(F.max("__n").alias("n_words"), F.sum("one").cast("int").alias("__copies"),
                 F.array_sort(F.collect_set("hit")).alias("hits"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))


def _bitmap(windows: DataFrame, bits: int) -> DataFrame:
    """(part, words): the bits of all window hashes modulo `bits`, ROW_WORDS 64-bit words in a row."""
    at = F.pmod("h", F.lit(bits))
    ones = windows.select(at.alias("at")).selectExpr("at div 64 as word", "shiftleft(1L, cast(at % 64 as int)) as mask")
    none = windows.sparkSession.range(bits // 64).selectExpr("id as word", "0L as mask")
    words = ones.unionByName(none).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    row = F.array_sort(F.collect_list(F.struct("word", "mask")))  # ROW_WORDS of them in each group
    return (words.groupBy(F.expr(f"word div {ROW_WORDS}").alias("part"))
            .agg(F.transform(row, lambda x: x["mask"]).alias("words")))


def _shuffled(rows: DataFrame, windows: DataFrame, count: int, pos: Column, length: Column, own: Column) -> DataFrame:
    """The verified positions, where the windows are too large to be broadcast."""
    bits = min(MOST_BITS, 1 << max(15, (count * WINDOW_BITS).bit_length()))
    at = F.pmod("__h", F.lit(bits))
    held = F.getbit(F.get("words", F.expr(f"cast(__at div 64 % {ROW_WORDS} as int)")), F.expr("cast(__at % 64 as int)"))
    maybe = (rows.filter("__g > 0").withColumn("__at", at)
             .join(F.broadcast(cut_lineage(_bitmap(windows, bits))), F.expr(f"__at div {64 * ROW_WORDS} = part"))
             .filter(held == 1).withColumns({"__pos": pos, "__len": length}).withColumn("__own", own)
             .select("__id", "__text_hash", "__text_bytes", "__n", "__g", "__h", "__pos", "__len", "__own"))
    return maybe.join(windows, (F.col("__h") == F.col("h")) & (F.col("__len") == F.col("len")) & (F.col("__own") == F.col("window")))


def _start(lengths: list[int], upto: int) -> Column:
    """Index of the first element of the upto-th length's hashes."""
    at = F.lit(1)
    for j in lengths[:upto]:
        at = at + F.greatest(F.col("__n") - (j - 1), F.lit(0))
    return at


def _covered(hits: Column) -> Column:
    """Number of positions in the union of sorted (pos, len) ranges."""
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["pos"] + x["len"]).alias("end"),
        (a["words"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(a["end"], x["pos"]))).alias("words"))
    return F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.lit(0).alias("words")), step)["words"]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: int = SHARE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (array), contaminated, and the text key."""
    n_hit = _covered(F.col("hits")).cast("long")
    found = find_hits(docs, benchmark, n, id_col, text_col).withColumn("n_hit", n_hit)
    return (found.select(F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"), "*")
            .select(F.col("__id").alias("doc_id"), "__text_hash", "__text_bytes", F.col("n_words").cast("long").alias("n_words"), "n_hit",
                    F.size("items").cast("long").alias("n_items"), "items",
                    ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: int = SHARE,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, unchanged, with all their columns."""
    bad = (contamination(docs, benchmark, n, share, id_col, text_col).filter("contaminated")
           .select(F.col("doc_id").alias("__k_id"), F.col("__text_hash").alias("__k_hash"),
                   F.col("__text_bytes").alias("__k_bytes")).distinct())
    h, b = text_key(F.col(text_col))
    keyed = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("__k_id"), h.alias("__k_hash"), b.alias("__k_bytes"))
    return join_keys(keyed, bad, ["__k_id", "__k_hash", "__k_bytes"], "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The documents with every hit word cut out of its text, together with what separates it from the next word."""
    h, b = text_key(F.col(text_col))
    hits = (find_hits(docs, benchmark, n, id_col, text_col).filter(F.size("hits") > 0)
            .select(F.col("__id").alias("__k_id"), F.col("__text_hash").alias("__k_hash"),
                    F.col("__text_bytes").alias("__k_bytes"), F.col("hits").alias("__hits")))
    text = F.col("row").getField(text_col)
    keyed = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("__k_id"), h.alias("__k_hash"), b.alias("__k_bytes"))
    joined = join_keys(keyed, hits, ["__k_id", "__k_hash", "__k_bytes"], "left")
    covered = lambda i: F.exists(F.col("__hits"), lambda x: (i >= x["pos"]) & (i < x["pos"] + x["len"]))
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    cut = F.concat(F.regexp_extract(text, LEAD, 0), F.array_join(F.filter(pieces, lambda x, i: ~covered(i)), ""))
    left = F.when(F.col("__hits").isNotNull(), cut).otherwise(text)
    return joined.select(*[left.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
