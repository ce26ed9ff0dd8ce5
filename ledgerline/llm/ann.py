"""Approximate nearest neighbours by inner product in a hierarchical k-means tree.

The tree is fitted on at most SAMPLE vectors (those of smallest hash); every vector is then indexed
under the leaf it descends to. A query walks the tree best bin first: a priority queue holds the
nodes by inner product of query and centre plus a part of the node's radius, and the first leaves
popped are visited. How many is calibrated: for CALIBRATION queries the true neighbours are found by
brute force over all vectors, and visits widen until the leaves of TARGET of them are reached.

Equal vectors are one class that keeps its k + 1 smallest ids, which is all a result can hold of it,
so a vector that a third of all rows share is compared once. Neighbouring leaves form shelves of about
PART classes; a shelf with more of them, or of queries, is dealt out in parts, and one task compares
the queries of one part with the leaves they visit in another.

Defined results: vectors that are null, zero or hold a null or non-finite component, rows with a
null id take no part; vectors are searched among those of their own length (each length has its tree);
an id with several vectors asks with each (with vectors of several lengths, for the best of all) and is
a candidate with each; repeated rows count once; a candidate never has the query's own id; equal scores go to the smaller id; with fewer
candidates all are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

K = 20
SAMPLE = 20_000
LEAF_ROWS, LEAF_SAMPLE, BRANCHES = 96, 16, 8
CALIBRATION, TARGET = 128, 0.94
PART = 8192
#: Queries that one task walks through the tree.
WALKS = 256
#: Weight of a node's radius in its priority: how far beyond its centre its vectors may lie.
REACH = 0.5
SEED = 5


class Tree:
    """Nodes in arrays: centres, children (first, count; none for a leaf) and leaf numbers."""

    def __init__(self, sample: np.ndarray, leaf_size: int):
        rng = np.random.default_rng(SEED)
        self.centre, self.first, self.count, self.leaf, self.leaves = [sample.mean(0) if len(sample) else np.zeros(0)], [0], [0], [-1], 0
        radius = [0.0]
        todo = [(0, sample)]
        while todo:
            node, own = todo.pop()
            groups = _kmeans(own, BRANCHES, rng) if len(own) > leaf_size else []
            if len(groups) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            self.first[node], self.count[node] = len(self.centre), len(groups)
            for g in groups:
                todo.append((len(self.centre), g))
                self.centre.append(g.mean(0))
                radius.append(float(np.sqrt(((g - self.centre[-1]) ** 2).sum(1).mean())))
                self.first.append(0)
                self.count.append(0)
                self.leaf.append(-1)
        self.centre, self.radius = np.array(self.centre), np.array(radius)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child at every level."""
        at = np.zeros(len(vectors), np.int64)
        out = np.full(len(vectors), -1)
        live = np.arange(len(vectors))
        while len(live):
            nxt = []
            for node in np.unique(at[live]):
                own = live[at[live] == node]
                if self.leaf[node] >= 0:
                    out[own] = self.leaf[node]
                    continue
                a = self.first[node]
                c = self.centre[a:a + self.count[node]]
                at[own] = a + np.argmin((c * c).sum(1) - 2 * vectors[own] @ c.T, 1)
                nxt.append(own)
            live = np.concatenate(nxt) if nxt else np.empty(0, np.int64)
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves of a best-bin-first walk."""
        near = (self.centre @ query + REACH * np.sqrt(query @ query) * self.radius).tolist()
        queue, out = [(-near[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for child in range(self.first[node], self.first[node] + self.count[node]):
                heapq.heappush(queue, (-near[child], child))
        return out


def _kmeans(rows: np.ndarray, k: int, rng, rounds: int = 8) -> list[np.ndarray]:
    """Non-empty clusters of the rows."""
    k = min(k, len(rows))
    centre = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        own = np.argmin((centre * centre).sum(1) - 2 * rows @ centre.T, 1)
        centre = np.array([rows[own == i].mean(0) if (own == i).any() else centre[i] for i in range(k)])
    return [rows[own == i] for i in range(k) if (own == i).any()]


def _matrix(column) -> np.ndarray:
    """float64 matrix of a column of equally long lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(vkey, vector, ids): distinct vectors with their k + 1 smallest ids, ascending."""
    order = W.partitionBy("vkey").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    return few.groupBy("vkey").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of q[i] with c[i], summed from the first component to the last."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


def _best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
          visited: np.ndarray | None = None, bin_of: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, candidate, score) arrays of each query's k best, in blocks of queries. ids ascend.
    With visited[query, bin], only candidates of the bins a query visits count.

    A matrix product differs from the exact score by at most its rounding error, relative to the lengths
    of both vectors. Every candidate that may be among the k best by that much is scored exactly, so ties
    and vectors of any size are told apart as the exact scores tell them."""
    step = max(1, (1 << 21) // max(1, len(vectors)))
    unit = vectors / (np.abs(vectors).max(initial=0) or 1.0)  # products of tiny or huge vectors neither vanish nor overflow
    length = np.sqrt((unit * unit).sum(1))
    for lo in range(0, len(queries), step):
        q = queries[lo:lo + step]
        size = np.abs(q).max(1, initial=0)[:, None]
        near = (q / np.where(size > 0, size, 1)) @ unit.T
        slack = 4 * vectors.shape[1] * np.sqrt(vectors.shape[1]) * np.finfo(float).eps * length
        if visited is not None:
            near[~visited[lo:lo + step][:, bin_of]] = -np.inf
        if near.shape[1] > k:
            edge = -np.partition(-(near - slack), k - 1, axis=1)[:, k - 1:k]
            row, at = np.nonzero((near + slack >= edge) & (near > -np.inf))
        else:
            row, at = np.nonzero(near > -np.inf)
        exact = np.empty(len(row))
        for part in range(0, len(row), 1 << 17):
            cut = slice(part, part + (1 << 17))
            exact[cut] = _exact(q[row[cut]], vectors[at[cut]])
        order = np.lexsort((at, -exact, row))
        row, at, exact = row[order], at[order], exact[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = nth < k
        yield row[kept] + lo, at[kept], exact[kept]


def _low_ids(ids) -> np.ndarray:
    """First of each list of ids."""
    return np.array([x[0].as_py() for x in ids], np.int64)


def _compare(k: int):
    """Cogroup function: one part of a shelf's queries against one part of its classes."""
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        parts = []
        if queries.num_rows and index.num_rows:
            low = _low_ids(index["ids"].combine_chunks())
            index = index.take(np.argsort(low, kind="stable"))
            keys, ids = queries["qkey"].combine_chunks(), index["ids"].combine_chunks().cast(pa.list_(pa.int64()))
            bins, bin_of = np.unique(index["leaf"].to_numpy(), return_inverse=True)
            leaves = queries["leaves"].combine_chunks()
            visited = np.zeros((queries.num_rows, len(bins) + 1), bool)
            at = np.searchsorted(bins, leaves.flatten().to_numpy())
            at[bins[np.minimum(at, len(bins) - 1)] != leaves.flatten().to_numpy()] = len(bins)  # leaves without a class here
            visited[np.repeat(np.arange(len(leaves)), leaves.value_lengths().to_numpy()), at] = True
            for q, c, s in _best(_matrix(queries["vector"]), _matrix(index["vector"]), np.sort(low), k, visited, bin_of):
                parts.append(pa.table([keys.take(pa.array(q)), ids.take(pa.array(c)), pa.array(s)], names=["qkey", "ids", "score"]))
        return pa.concat_tables(parts) if parts else pa.table(
            {"qkey": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
    return run


def _brute(queries: np.ndarray, k: int):
    """mapInArrow function: each batch's best classes for every given query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(queries):
                low = _low_ids(batch.column(1))
                order = np.argsort(low, kind="stable")
                low = low[order]
                for q, c, s in _best(queries, _matrix(batch.column(0))[order], low, k):
                    leaf = batch.column(2).to_numpy()[order][c]
                    yield pa.record_batch([pa.array(q, pa.int32()), pa.array(low[c]), pa.array(leaf, pa.int32()), pa.array(s)], ["q", "id", "leaf", "score"])
    return run


def build(rows: DataFrame, k: int = K, sample: int = SAMPLE) -> tuple[DataFrame, Tree]:
    """Index of (vec_id, vector, vkey): all classes with their leaf (checkpointed), and the tree."""
    whole = cut_lineage(classes(rows, k))
    n = whole.count()
    fit = _matrix(whole.orderBy(F.xxhash64("vkey"), "vkey").limit(sample).select("vector").toArrow()["vector"])
    leaf_size = max(LEAF_SAMPLE, int(LEAF_ROWS * len(fit) / max(1, n)))
    tree = Tree(fit, leaf_size)

    @F.arrow_udf("int")
    def leaf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            yield pa.array(tree.assign(_matrix(vectors)) if len(vectors) else [], pa.int32())

    return cut_lineage(whole.withColumn("leaf", leaf("vector"))), tree


def calibrate(index: DataFrame, tree: Tree, queries: DataFrame, k: int = K, target: float = TARGET,
              most: int = CALIBRATION) -> tuple[int, float]:
    """Leaves to visit so that `target` of the true neighbours of at most `most` queries are reached, and the share reached."""
    asked = queries.orderBy(F.xxhash64("qkey"), "qkey").limit(most).select("vector").toArrow()["vector"]
    vectors = _matrix(asked)
    if not len(vectors):
        return 1, 1.0
    near = index.select("vector", "ids", "leaf").mapInArrow(_brute(vectors, k), "q int, id bigint, leaf int, score double")
    order = W.partitionBy("q").orderBy(F.col("score").desc(), "id")
    found = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("q", "leaf").collect()
    turn = [{leaf: i for i, leaf in enumerate(tree.visits(v, tree.leaves))} for v in vectors]
    needed = sorted(turn[r.q][r.leaf] + 1 for r in found)
    if not needed:
        return 1, 1.0
    visits = needed[min(len(needed), int(np.ceil(target * len(needed)))) - 1]
    return visits, sum(x <= visits for x in needed) / len(needed)


def search(rows: DataFrame, is_query: Column, k: int = K, target: float = TARGET, sample: int = SAMPLE,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that is_query (over vec_id) names."""
    vector = F.col(vector_col).cast("array<double>")
    valid = (rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
             .filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))))
    lengths = [r.dim for r in valid.select(F.size("vector").alias("dim")).distinct().orderBy("dim").collect()]
    out = None
    for dim in lengths or [0]:
        found = _search(valid.filter(F.size("vector") == dim), is_query, k, target, sample)
        out = found if out is None else out.unionByName(found)
    return out if len(lengths) < 2 else _ranked(out, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over its vectors of all lengths (an id may have several)."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _search(valid: DataFrame, is_query: Column, k: int, target: float, sample: int) -> DataFrame:
    """The search among (vec_id, vector) of one length."""
    valid = valid.withColumn("vkey", F.md5(F.array_join(F.col("vector").cast("array<string>"), ",").cast("binary")))
    index, tree = build(valid, k, sample)
    asked = valid.filter(is_query)
    queries = cut_lineage(asked.groupBy(F.col("vkey").alias("qkey")).agg(F.first("vector").alias("vector")))
    visits, _ = calibrate(index, tree, queries, k + 1, target)

    n_shelves = max(1, -(-index.count() // PART))
    shelf_of = lambda leaf: leaf * n_shelves // tree.leaves  # noqa: E731  leaves are numbered depth first, so neighbours share a shelf

    @F.arrow_udf("array<struct<shelf:int,leaves:array<int>>>")
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("shelf", pa.int32()), ("leaves", pa.list_(pa.int32()))]))
        for vectors in batches:
            rows = []
            for v in _matrix(vectors):
                shelves: dict[int, list[int]] = {}
                for leaf in tree.visits(v, visits):
                    shelves.setdefault(shelf_of(leaf), []).append(leaf)
                rows.append([{"shelf": s, "leaves": x} for s, x in shelves.items()])
            yield pa.array(rows, kind)

    # a walk costs far more than its bytes tell, so the queries are dealt out by number
    turns = max(1, -(-queries.count() // WALKS))
    going = cut_lineage(queries.repartition(turns, "qkey").select("qkey", "vector", F.explode(walk("vector")).alias("w"))
                        .select("qkey", "vector", "w.shelf", "w.leaves"))
    shelved = index.withColumn("shelf", F.expr(f"cast(leaf * {n_shelves}L div {tree.leaves} as int)"))
    parts = lambda df, name: df.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / PART).alias(name))
    plan = F.broadcast(parts(shelved, "parts").join(parts(going, "turns"), "shelf"))  # a row per leaf of the tree at most
    own = lambda key, of: F.pmod(F.xxhash64(key), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    group = ["shelf", "part", "turn"]
    left = going.join(plan, "shelf").withColumn("turn", own("qkey", "turns")).withColumn("part", every("parts")).select(*group, "qkey", "vector", "leaves")
    right = shelved.join(plan, "shelf").withColumn("part", own("vkey", "parts")).withColumn("turn", every("turns")).select(*group, "leaf", "ids", "vector")
    near = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_compare(k + 1), "qkey string, ids array<bigint>, score double")

    best = lambda by: W.partitionBy("qkey").orderBy(F.col("score").desc(), by)
    top = (near.withColumn("n", F.row_number().over(best(F.col("ids")[0]))).filter(F.col("n") <= k + 1)
           .select("qkey", "score", F.explode("ids").alias("id"))
           .withColumn("n", F.row_number().over(best("id"))).filter(F.col("n") <= k + 1)
           .groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("near")))
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("vkey").alias("qkey")).distinct().join(top, "qkey")
    kept = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (pairs.select("query_id", F.posexplode(kept).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score")))
