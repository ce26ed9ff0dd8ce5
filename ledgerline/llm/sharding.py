"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes sit on a ring of RING positions. A key belongs to the next virtual node
clockwise; keys are admitted in ring order, and those that meet a full shard go on clockwise to the
next one with room. With slack 0 the capacities add up to the number of rows, so the shards end at
most one row apart; a positive slack trades balance for less movement when shards are added.

The walk needs only the number of keys in each arc (RING positions at most, whatever the data), so
it is one fold over that histogram; rows are then ranked within their ring position and find their
shard through a broadcast table of at most RING + nodes + shards rows. DataFrame functions only.

Defined results: a null id hashes like the empty text; repeated ids are separate rows at one ring
position, and a position of many rows is ranked in parts; a null text has size 1 and the checksum of the empty text; an empty table gives no rows;
other columns are not read. Equal texts need not share a shard: one group may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

RING_BITS = 16
RING = 1 << RING_BITS
SHARDS = 16
NODES_PER_SHARD = 64
#: Rows of a ring position that one task ranks; a position with more is split by checksum, equal rows in COPIES parts.
HOT_ROWS, COPIES, SALT_BITS = 100_000, 1024, 20


def _position(key: Column) -> Column:
    """Ring position of a key: the first 16 bits of its md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, RING_BITS // 4), 16, 10).cast("long")


def key_position(id_col: Column) -> Column:
    return _position(F.concat(F.lit("key:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def arcs(spark: SparkSession, shards: int = SHARDS, per_shard: int = NODES_PER_SHARD) -> DataFrame:
    """One row per virtual node: arc number, shard, the ring positions lo..hi of its arc (the first arc
    begins behind the last node, at negative numbers) and the shards in clockwise order from it."""
    nodes = (spark.range(shards * per_shard).select((F.col("id") % shards).cast("int").alias("shard"),
                                                    F.expr(f"id div {shards}").alias("replica"))
             .withColumn("hi", _position(F.concat_ws(":", F.lit("node"), "shard", "replica"))))
    every = W.partitionBy(F.lit(0)).orderBy("hi", "shard", "replica")
    whole = W.partitionBy(F.lit(0)).orderBy("hi", "shard", "replica").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = shards * per_shard
    order = F.collect_list("shard").over(whole)
    return (nodes.select(F.row_number().over(every).alias("arc"), "shard", "hi",
                         F.coalesce(F.lag("hi").over(every), F.last("hi").over(whole) - RING).alias("before"),
                         order.alias("order"))
            .select("arc", "shard", (F.col("before") + 1).alias("lo"), "hi",
                    F.array_distinct(F.slice(F.concat("order", "order"), F.col("arc"), n)).alias("clockwise")))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold."""
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _walk(loads: DataFrame, caps: list[int]) -> DataFrame:
    """Pieces of the ring order: rows from_rank..to_rank-1 go to `shard`, from its slot `slot` on."""
    piece = F.struct(F.lit(0).cast("long").alias("from_rank"), F.lit(0).cast("long").alias("to_rank"),
                     F.lit(0).alias("arc"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cap = F.array(*[F.lit(c).cast("long") for c in caps])
    start = F.struct(cap.alias("room"), F.lit(0).cast("long").alias("rank"), F.filter(F.array(piece), lambda p: p["to_rank"] > 0).alias("pieces"))

    def arc_step(acc, a):
        def shard_step(st, s):
            take = F.least(st["need"], F.get(st["room"], s))
            grown = F.concat(st["pieces"], F.array(F.struct(
                st["rank"].alias("from_rank"), (st["rank"] + take).alias("to_rank"), a["arc"].alias("arc"), s.alias("shard"),
                (F.get(cap, s) - F.get(st["room"], s)).alias("slot"))))
            room = F.transform(st["room"], lambda r, i: F.when(i == s, r - take).otherwise(r))
            return F.when(take > 0, F.struct((st["need"] - take).alias("need"), room.alias("room"),
                                             (st["rank"] + take).alias("rank"), grown.alias("pieces"))).otherwise(st)

        begin = F.struct(a["load"].alias("need"), acc["room"].alias("room"), acc["rank"].alias("rank"), acc["pieces"].alias("pieces"))
        end = F.aggregate(a["clockwise"], begin, shard_step)
        return F.struct(end["room"].alias("room"), end["rank"].alias("rank"), end["pieces"].alias("pieces"))

    one = loads.groupBy().agg(F.array_sort(F.collect_list(F.struct("arc", "load", "clockwise"))).alias("arcs"))
    return one.select(F.explode(F.aggregate("arcs", start, arc_step)["pieces"]).alias("p")).select("p.*")


def _ranked(keyed: DataFrame, histogram: DataFrame) -> DataFrame:
    """keyed with `nth`: its place among the rows of its ring position, by id, checksum and size.

    A position beyond HOT_ROWS (an id, or null, that very many rows have) never meets in one task: its rows
    are counted by (id, upper bits of the checksum), then by (checksum, size, copy), running sums over these
    counts give where each group begins, and only a group's own rows are ranked."""
    order = ["doc_id", "text_crc32", "size"]
    hot = histogram.filter(F.col("n") > HOT_ROWS).select("pos")
    usual = F.row_number().over(W.partitionBy("pos").orderBy(*order)) - 1
    if hot.isEmpty():
        return keyed.withColumn("nth", usual.cast("long"))
    hot = F.broadcast(hot)  # ring positions: RING rows at most
    cold = keyed.join(hot, "pos", "left_anti").withColumn("nth", usual.cast("long"))
    # rows that are equal in all of the order get a part each by where they lie, kept as it is by the checkpoint
    warm = cut_lineage(keyed.join(hot, "pos").withColumn("copy", F.pmod(F.monotonically_increasing_id(), F.lit(COPIES))))
    salted = warm.withColumn("salt", F.shiftright("text_crc32", SALT_BITS))
    first, second = ["pos", "doc_id", "salt"], ["text_crc32", "size", "copy"]
    small = cut_lineage(salted.groupBy(*first, *second).agg(F.count(F.lit(1)).alias("n")))
    before = lambda group, by: F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    large = small.groupBy(*first).agg(F.sum("n").alias("n")).withColumn("base", before(["pos"], first[1:])).drop("n")
    inner = small.withColumn("begin", before(first, second)).drop("n")
    named = lambda df, cols: df.select(*[F.col(c).alias(f"g_{c}") for c in cols], *[c for c in df.columns if c not in cols])
    same = lambda cols: [salted[c].eqNullSafe(F.col(f"g_{c}")) for c in cols]
    starts = inner.alias("i").join(large.alias("l"), [F.col(f"i.{c}").eqNullSafe(F.col(f"l.{c}")) for c in first]).select(
        *[F.col(f"i.{c}").alias(c) for c in first + second], (F.col("begin") + F.col("base")).alias("begin"))
    own = F.row_number().over(W.partitionBy(*first, *second).orderBy(F.xxhash64("row"))) - 1
    ranked = salted.withColumn("own", own).join(named(starts, first + second), same(first + second))
    return cold.unionByName(ranked.select(*keyed.columns, (F.col("begin") + F.col("own")).cast("long").alias("nth")))


def shard(docs: DataFrame, shards: int = SHARDS, slack: float = 0.0, per_shard: int = NODES_PER_SHARD,
          id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard (0-based) and slot (0-based place in the shard, gapless).
    With whole_rows: all columns of docs instead of the first three, then shard and slot (which take
    the place of columns of these names)."""
    spark = docs.sparkSession
    histogram = cut_lineage(docs.select(key_position(F.col(id_col)).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("n")))
    rows = histogram.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ring = arcs(spark, shards, per_shard)
    places = (ring.filter("lo <= hi").select("arc", F.explode(F.sequence("lo", "hi")).alias("at"))
              .withColumn("pos", F.pmod("at", F.lit(RING)))
              .join(histogram, "pos"))  # ring positions that hold keys
    in_order = W.partitionBy(F.lit(0)).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    places = cut_lineage(places.withColumn("start", F.coalesce(F.sum("n").over(in_order), F.lit(0))))
    loads = ring.join(places.groupBy("arc").agg(F.sum("n").alias("load")), "arc")
    pieces = cut_lineage(_walk(loads, capacities(rows, shards, slack)))
    # at most RING + nodes + shards rows: a piece ends with its arc or with the room of a shard
    where = (places.join(pieces, "arc").filter("from_rank < start + n and to_rank > start")
             .select("pos", "start", "from_rank", "to_rank", "shard", "slot"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns] if whole_rows else [F.lit(0)]).alias("row"),
                        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"), key_position(F.col(id_col)).alias("pos"))
    placed = (_ranked(keyed, histogram).join(F.broadcast(where), "pos")
              .withColumn("rank", F.col("start") + F.col("nth"))
              .filter("rank >= from_rank and rank < to_rank")
              .withColumn("slot", F.col("slot") + F.col("rank") - F.col("from_rank")))
    if whole_rows:
        own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
        return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "shard", "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")
