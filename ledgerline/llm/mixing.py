"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of a source, in seeded document order, form one stream that is cut into blocks of equal
length. Blocks are seats: the sources get them by the highest quotients target / (2k + 1); a
source's seats become whole passes over its stream and a remainder, which its shards share out by
the same rule; a shard then selects its quota of blocks, evenly spaced from a seeded phase. A
document's `taken` follows in closed form from its place in the stream, so no block is ever a row.
DataFrame functions only: two small shuffles of (id, size, source), none of texts.

Defined results: a null text has size 0; a null source is a source of its own and comes last; an
empty table gives no rows; repeated rows are separate documents; null ids are ordered like the
empty text, and an id (or null) that very many rows have is placed in parts; a text of any length is one
document, cut at its words; a source without words has target 0 and takes nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import BROADCAST_ROWS, SPACED_WORD, hash48

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Longest block, and blocks that the smallest target gets at least (so rounding stays under 1 in 400).
MAX_BLOCK, MIN_SEATS = 256, 200
ROWS_PER_SHARD = 2048
SEED = 20240
#: Rows of a source's shard that one task places; a shard with more (rows of one id) is split by size, equal sizes in COPIES parts.
HOT_ROWS, COPIES, SIZE_BITS = 100_000, 1024, 6


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """Seats of each party: (group, key, quota). Within a group, `seats` (the same in all its rows) go
    to the highest quotients votes / (2k + 1), ties to the smaller key. All seats that are sure to be
    won are counted at once; only the last few, about as many as parties, are ranked as rows."""
    whole = W.partitionBy(*group)
    v, s = F.sum(votes).over(whole), F.count(F.lit(1)).over(whole)
    base = F.when((F.col("__v") > 0) & (F.col(seats) > F.col("__s")), F.greatest(F.lit(0.0), F.floor(
        F.col(votes) / F.col("__v") * (F.col(seats) - F.col("__s") / F.lit(2.0)) + 0.5 - 1e-9))).otherwise(0.0).cast("long")
    more = F.when(F.col("__v") > 0, F.ceil(F.col(votes) / F.col("__v") * F.col("__s") * 1.5) + 2).otherwise(1).cast("long")
    first = (parties.select(*group, *key, votes, seats).withColumns({"__v": v, "__s": s})
             .withColumn("__base", base)
             .withColumn("__left", F.col(seats) - F.sum("__base").over(whole)))
    tries = first.select("*", F.explode(F.sequence(F.col("__base"), F.col("__base") + more)).alias("__k"))
    rank = F.row_number().over(whole.orderBy((F.col(votes) / (F.col("__k") * 2 + 1)).desc(), *key, "__k"))
    won = (F.col(votes) > 0) & (rank <= F.col("__left"))
    return (tries.withColumn("__won", won.cast("long")).groupBy(*group, *key)
            .agg((F.first("__base") + F.sum("__won")).alias("quota")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds rank (1-based, by code point, null last), weight and target to (src_null, src, source_size).

    The targets share out all sizes by weight; a source stops at max_repeats times its size and its
    excess goes to the others. Taken in order of size per weight, the stopped sources come first, so
    the level that the rest reaches is found with running sums."""
    order = W.orderBy("src_null", "src")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = (sources.withColumn("rank", F.row_number().over(order).cast("long"))
              .withColumn("weight", w.cast("long"))
              .withColumn("cap", F.col("source_size") * max_repeats)
              .withColumn("ratio", F.col("cap") / F.col("weight")))
    every = W.partitionBy(F.lit(0))
    before = every.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    levels = (ranked.withColumn("total", F.sum("source_size").over(every))
              .withColumn("w_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("t_left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
              .withColumn("level", F.col("t_left") / F.col("w_left")))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))
    return (levels.withColumn("level", F.min(fits).over(every)["level"])
            .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
            .select("src_null", "src", "source_size", "rank", "weight", "target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.withColumns({"__id": F.col(id_col), "__source": F.col(source_col), "__size": word_count(F.col(text_col))})


def _plan(sized: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: int) -> DataFrame:
    """Adds to rows with __id, __source and __size where each document stands (__s, __e in its shard's part
    of the source's stream), its source's size, target and passes, and the shard's selection of blocks."""
    own = lambda df: df.withColumns({"src_null": F.col("__source").isNull(), "src": F.coalesce("__source", F.lit("")),
                                     "__h": hash48(seed, F.col("__id"))})
    small = cut_lineage(own(sized.select("__id", "__source", "__size")))
    shards = max(1, -(-small.count() // ROWS_PER_SHARD))
    shard = F.col("__h") % shards

    src = ["src_null", "src"]
    cells = cut_lineage(small.withColumn("shard", shard).groupBy(*src, "shard").agg(F.sum("__size").alias("words"), F.count(F.lit(1)).alias("rows")))
    goals = targets(cells.groupBy(*src).agg(F.sum("words").alias("source_size")), weights, max_repeats)
    every = W.partitionBy(F.lit(0))
    block = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(
        F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / MIN_SEATS)))
    goals = (goals.withColumn("block", F.coalesce(block, F.lit(1)).cast("long"))
             .withColumn("seats", F.round(F.sum("target").over(every) / F.col("block")).cast("long"))
             .withColumn("all", F.lit(0)))
    goals = cut_lineage(goals)
    won = sainte_lague(goals, ["all"], ["rank"], "target", "seats").select("rank", "quota")
    plan = (goals.join(won, "rank")
            .withColumn("n", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
            .withColumn("quota", F.least("quota", F.col("n") * max_repeats))
            .withColumn("passes", F.when(F.col("n") > 0, F.expr("quota div n")).otherwise(0))
            .withColumn("rest", F.col("quota") - F.col("passes") * F.col("n"))
            .select(*src, "rank", "source_size", "target", "block", "passes", "rest"))

    # each shard's part of the source's stream: where it begins, its first block, its number of blocks
    stream = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    up = lambda c: F.expr(f"({c} + block - 1) div block")
    parts = cut_lineage(cells.join(plan, src)
                        .withColumn("at", F.coalesce(F.sum("words").over(stream), F.lit(0)))
                        .withColumn("first", up("at")).withColumn("n", up("(at + words)") - F.col("first"))
                        .withColumn("votes", F.col("n").cast("double")))
    quota = sainte_lague(parts, ["rank"], ["shard"], "votes", "rest")
    picked = (parts.join(quota, ["rank", "shard"])
              .withColumn("phase", F.when(F.col("n") > 0, hash48(seed, F.col("src"), F.col("shard")) % F.col("n")).otherwise(0))
              .withColumn("head", F.col("first") * F.col("block") - F.col("at"))
              .withColumn("carry", F.coalesce(F.last(F.when(F.col("n") > 0, _picked("n - 1")), True).over(stream), F.lit(0)))
              .select(F.struct(*src, "shard", "source_size", "target", "block", "passes", "n", "quota", "phase", "head", "carry").alias("__p")))

    rows = (small if set(sized.columns) == {"__id", "__source", "__size"} else own(sized)).withColumn("__shard", shard)
    run = _placed(rows, cells.withColumnRenamed("shard", "__shard")).withColumn("__s", F.col("__e") - F.col("__size"))
    return run.join(picked, (F.col("src_null") == F.col("__p.src_null")) & (F.col("src") == F.col("__p.src"))
                    & (F.col("__shard") == F.col("__p.shard")))


def _placed(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with __e: the words of its source's shard up to and with the row, by hash, id, size (and text).

    A shard beyond HOT_ROWS never meets in one task: its rows are counted by (id, upper bits of the size), then
    by (size, copy); running sums over these counts give where each group begins, and only a group's own
    rows, equal in size, are numbered."""
    cell, order = ["src_null", "src", "__shard"], ["__h", "__id", "__size"]
    tie = [c for c in ("__tie",) if c in rows.columns]
    usual = F.sum("__size").over(W.partitionBy(*cell).orderBy(*order, *tie).rowsBetween(W.unboundedPreceding, 0))
    hot = cells.filter(F.col("rows") > HOT_ROWS).select(*[F.col(c).alias(f"hot{c}") for c in cell])
    many = hot.count()
    if not many:
        return rows.withColumn("__e", usual)
    if many <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    same = [F.col(c) == F.col(f"hot{c}") for c in cell]
    cold = rows.join(hot, same, "left_anti").withColumn("__e", usual)
    # rows of one id and size get a part each by where they lie, kept as it is by the checkpoint
    salted = cut_lineage(rows.join(hot, same).select(*rows.columns).withColumns({
        "__upper": F.shiftright("__size", SIZE_BITS), "__copy": F.pmod(F.monotonically_increasing_id(), F.lit(COPIES))}))
    first, second = [*cell, "__h", "__id", "__upper"], ["__size", "__copy"]
    groups = cut_lineage(salted.groupBy(*first, *second).agg(F.sum("__size").alias("w")))
    before = lambda own, by: F.coalesce(F.sum("w").over(W.partitionBy(*own).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    large = groups.groupBy(*first).agg(F.sum("w").alias("w")).withColumn("base", before(cell, first[3:])).drop("w")
    inner = groups.withColumn("begin", before(first, second)).drop("w")
    starts = inner.alias("i").join(large.alias("l"), [F.col(f"i.{c}").eqNullSafe(F.col(f"l.{c}")) for c in first]).select(
        *[F.col(f"i.{c}").alias(f"g{c}") for c in first + second], (F.col("begin") + F.col("base")).alias("begin"))
    nth = F.row_number().over(W.partitionBy(*first, *second).orderBy(*(tie or ["__size"])))
    placed = salted.withColumn("nth", nth).join(starts, [salted[c].eqNullSafe(F.col(f"g{c}")) for c in first + second])
    return cold.unionByName(placed.select(*rows.columns, (F.col("begin") + F.col("nth") * F.col("__size")).alias("__e")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's) and taken (its words in the mix)."""
    placed = _plan(_sized(docs, id_col, text_col, source_col).select("__id", "__source", "__size"), weights, max_repeats, seed)
    taken = F.col("__size") * F.col("__p.passes") + _selected("__e") - _selected("__s")
    return placed.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"),
                         F.col("__p.source_size").alias("source_size"), F.col("__p.target").alias("target"),
                         taken.cast("long").alias("taken"))


def mix_texts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
              id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole pass over a document, and one for
    the words of its selected blocks (with what follows each word); chars_col, if there, is the new
    text's length. A document of which nothing is taken is left out."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    sized = row.select("__row", F.col(f"__row.{id_col}").alias("__id"), F.col(f"__row.{source_col}").alias("__source"),
                       word_count(F.col(f"__row.{text_col}")).alias("__size"),
                       F.xxhash64(F.col(f"__row.{text_col}")).alias("__tie"))
    placed = _plan(sized, weights, max_repeats, seed)
    text = F.col(f"__row.{text_col}")
    pieces = F.regexp_extract_all(text, F.lit(SPACED_WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    lead = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    cut = lambda own: F.array_join(F.flatten(F.transform(
        "__own", lambda r: F.slice(own, (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int")))), "")
    # an array of one element binds the pieces to a name, so that the pattern runs once for a document
    part = F.when(F.size("__own") > 0, F.concat(lead, F.get(F.transform(F.array(pieces), cut), 0)))
    chosen = _selected("__e") - _selected("__s")
    rows = (placed.withColumn("__own", F.when((chosen > 0) & (chosen < F.col("__size")), _ranges()))
            .withColumn("__some", F.when(chosen == F.col("__size"), text).otherwise(part))
            .withColumn("__texts", F.concat(F.when(F.col("__size") > 0, F.array_repeat(text, F.col("__p.passes").cast("int"))).otherwise(F.array().cast("array<string>")),
                                            F.when((chosen > 0), F.array("__some")).otherwise(F.array().cast("array<string>"))))
            .select("__row", F.explode("__texts").alias("__text")))
    new = {text_col: F.col("__text"), chars_col: F.char_length("__text").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def _ranges() -> Column:
    """The document's selected words as ranges [a, b) of its own word numbers, one per selected block."""
    p, s, e = "__p.", "__s", "__e"
    before = F.when((F.col(p + "carry") == 1) & (F.col(s) < F.col(p + "head")), F.array(F.struct(
        F.lit(0).cast("long").alias("a"), (F.least(F.col(e), F.col(p + "head")) - F.col(s)).alias("b"))))
    first = F.floor((F.greatest(F.col(s), F.col(p + "head")) - F.col(p + "head")) / F.col(p + "block")).cast("long")
    last = F.floor((F.col(e) - 1 - F.col(p + "head")) / F.col(p + "block")).cast("long")
    step = lambda j: F.floor((j * F.col(p + "quota") + F.col(p + "phase")) / F.col(p + "n"))
    mine = F.filter(F.sequence(first, last), lambda j: step(j + 1) > step(j))
    cut = F.transform(mine, lambda j: F.struct(
        (F.greatest(F.col(s), F.col(p + "head") + j * F.col(p + "block")) - F.col(s)).alias("a"),
        (F.least(F.col(e), F.col(p + "head") + (j + 1) * F.col(p + "block")) - F.col(s)).alias("b")))
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return F.concat(F.coalesce(before, empty), F.when((F.col(p + "n") > 0) & (F.col(e) > F.col(p + "head")), cut).otherwise(empty))


def _picked(j: str, p: str = "") -> Column:
    """1 if the shard's block j is selected: its evenly spaced quota steps up there."""
    return F.expr(f"(({j} + 1) * {p}quota + {p}phase) div {p}n - (({j}) * {p}quota + {p}phase) div {p}n")


def _selected(x: str, p: str = "__p.") -> Column:
    """Selected words among the first x of a shard's part of the stream."""
    j = f"(({x} - {p}head) div {p}block)"
    inside = F.expr(f"{p}carry * {p}head + {p}block * (({j} * {p}quota + {p}phase) div {p}n)") + \
        F.expr(f"({x} - {p}head) % {p}block") * _picked(j, p)
    return F.when((F.col(p + "n") > 0) & (F.col(x) >= F.col(p + "head")), inside).otherwise(
        F.col(p + "carry") * F.least(F.col(x), F.col(p + "head")))
