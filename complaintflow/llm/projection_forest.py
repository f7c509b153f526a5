"""Approximate nearest neighbours by a forest of random-projection trees.

A tree halves its vectors at the median of their projections on the difference of two of them, down to its leaves. The
forest is fitted to a bounded sample (``SAMPLE`` expected vectors); every vector is then placed in one leaf of each tree.
A query searches all trees through one priority queue: what is taken from it is the subtree with the least sum of squared
distances to the hyperplanes that had to be crossed; a leaf is visited, a node puts its two halves back. The vectors of the
visited leaves are compared with the query exactly.

How many leaves are visited follows from the data: for ``PROBES`` sampled vectors the nearest neighbours are found by
comparing them with all vectors, and the queue is followed until ``RECALL`` of these lie in visited leaves. Clustered
vectors need few leaves. Vectors without any structure need a large part of them, whatever the size of the table: there no
tree tells near from far.

Equal vectors are one class with its k + 1 smallest vec_ids: no query can get more of them, and copies never meet in one
group. Leaves beyond ``PIECE_ROWS`` expected rows are searched in pieces.

Defined results: rows whose vector is null, empty, zero or has a null or non-finite component take no part, nor do rows
without vec_id; vectors of different lengths are never neighbours; a repeated row is a row of its own, hence a neighbour at
distance 0; ties go to the smaller vec_id; a query with fewer than k candidates gets all; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from complaintflow.llm.shared import columns, stored, table

K = 10
TREES = 4
SAMPLE = 16_384
#: Leaves have so many rows on average while the sample has ``LEAF_SAMPLE`` vectors for each of them.
LEAF_ROWS = 512
LEAF_SAMPLE = 16
PIECE_ROWS = 1 << 16
PROBES = 128
RECALL = 0.97
SEED = 11


class Forest:
    """Complete binary trees as arrays: node i has the halves 2i + 1 (at or below the median) and 2i + 2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.nodes = (1 << depth) - 1
        self.normals = np.zeros((trees, self.nodes, sample.shape[1]))
        self.medians = np.zeros((trees, self.nodes))
        for t in range(trees):
            parts = [np.arange(len(sample))]
            for node in range(self.nodes):
                part = parts[node]
                if len(part) > 1:
                    a, b = sample[rng.choice(part, 2, replace=False)]
                    length = np.linalg.norm(a - b)
                    if length > 0 and np.isfinite(length):
                        self.normals[t, node] = (a - b) / length
                at = sample[part] @ self.normals[t, node]
                self.medians[t, node] = np.median(at) if len(at) else 0.0
                low = at <= self.medians[t, node]
                parts += [part[low], part[~low]]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector (rows) in each tree (columns)."""
        node = np.zeros((len(vectors), self.trees), np.int64)
        for t in range(self.trees):
            for _ in range(self.depth):
                at = node[:, t]
                side = np.einsum("ij,ij->i", vectors, self.normals[t, at]) > self.medians[t, at]
                node[:, t] = 2 * at + 1 + side
        return node - self.nodes

    def visits(self, vectors: np.ndarray, least: int) -> Iterator[list[tuple[int, int]]]:
        """For each vector the first ``least`` (tree, leaf) that the queue gives."""
        margins = np.stack([vectors @ n.T - m for n, m in zip(self.normals, self.medians)], 1) if self.nodes else None
        for i in range(len(vectors)):
            crossed = None if margins is None else margins[i].tolist()
            queue, found = [(0.0, t, 0) for t in range(self.trees)], []
            while queue and len(found) < least:
                cost, t, node = heapq.heappop(queue)
                if node >= self.nodes:
                    found.append((t, node - self.nodes))
                    continue
                m = crossed[t][node]
                far = cost + m * m
                heapq.heappush(queue, (far if m > 0 else cost, t, 2 * node + 1))
                heapq.heappush(queue, (cost if m > 0 else far, t, 2 * node + 2))
            yield found


def usable(vector: Column) -> Column:
    """A vector with finite components, one of them not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An array column without nulls, each of ``dim`` components, as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _first(lists: pa.ChunkedArray) -> np.ndarray:
    """The first element of each list."""
    return np.asarray(pc.list_element(lists, 0))


def _nearest(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the k nearest rows by (distance, id)."""
    rough = np.einsum("ij,ij->i", vectors, vectors) - 2 * (vectors @ query)
    if len(rough) > k:
        limit = np.partition(rough, k - 1)[k - 1] + 1e-9 * (query @ query + np.abs(rough).max())  # far above what this formula can be off
        some = np.flatnonzero(rough <= limit) if np.isfinite(limit) else np.arange(len(rough))
    else:
        some = np.arange(len(rough))
    off = vectors[some] - query
    exact = np.sqrt((off * off).sum(axis=1))
    order = np.lexsort((ids[some], exact))[:k]
    return some[order], exact[order]


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """embedding, ids: the k + 1 smallest vec_ids of equal vectors, class_id: a number for them (stored rows keep it)."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class_id", F.monotonically_increasing_id())


def _probe(classes: DataFrame, forest: Forest, dim: int, k: int, n: int, recall: float) -> int:
    """How many leaves a query visits, by the exact neighbours of sampled vectors."""
    spark = classes.sparkSession
    chosen = classes.filter(_share(PROBES, n, "probe")).select("class_id", "embedding").toArrow()
    if not chosen.num_rows:
        return forest.trees << forest.depth
    probes = spark.sparkContext.broadcast((np.asarray(chosen["class_id"]), _matrix(chosen["embedding"], dim), forest))

    def compare(batches):
        names, vectors, forest = probes.value
        for batch in batches:
            ids, rows = np.asarray(batch.column("class_id")), _matrix(batch.column("embedding"), dim)  # any order of ties will do here
            out = []
            for p, q in zip(names.tolist(), vectors):
                other = np.flatnonzero(ids != p)
                at, far = _nearest(q, rows[other], ids[other], k)
                out += [(p, float(d), int(ids[i]), leaf) for d, i, leaf in zip(far, other[at], forest.leaves(rows[other[at]]).tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())))],
                                                 ["probe", "score", "class_id", "leaf"])

    near = classes.select("class_id", "embedding").mapInArrow(compare, "probe long, score double, class_id long, leaf array<long>")
    best = near.withColumn("at", F.row_number().over(Window.partitionBy("probe").orderBy("score", "class_id"))).filter(F.col("at") <= k).collect()
    wanted: dict[int, list] = {}
    for r in best:
        wanted.setdefault(r["probe"], []).append(r["leaf"])
    needed = []
    for name, visited in zip(probes.value[0].tolist(), forest.visits(probes.value[1], forest.trees << forest.depth)):
        place = {leaf: i for i, leaf in enumerate(visited, 1)}
        needed += [min(place[t, leaf] for t, leaf in enumerate(leaves)) for leaves in wanted.get(name, [])]
    needed.sort()
    return needed[min(len(needed) - 1, int(recall * len(needed)))] if needed else forest.trees << forest.depth


def _share(of: int, n: int, salt: str) -> Column:
    """About ``of`` of n rows, the same ones in each run."""
    return F.lit(n <= of) | (F.pmod(F.xxhash64(F.col("ids")[0], F.lit(salt)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, of / n)))


def _search(index: DataFrame, queries: DataFrame, forest, dim: int, least: int, pieces: int, k: int) -> DataFrame:
    """query, class_id, ids, score: what each query finds in each leaf it visits, k + 1 classes at most."""
    vector = dict(index.dtypes)["embedding"]

    def place(batches):
        for batch in batches:
            for t, leaf in enumerate(forest.value.leaves(_matrix(batch.column("embedding"), dim)).T):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t), pa.int32()), pa.array(leaf, pa.int32()), batch.column("class_id"),
                                                  batch.column("ids"), batch.column("embedding")], ["tree", "leaf", "class_id", "ids", "embedding"])

    def visit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                visited = list(forest.value.visits(_matrix(part.column("embedding"), dim), least))
                row = np.repeat(np.arange(part.num_rows), [len(v) for v in visited])
                tree, leaf = (pa.array([x[c] for v in visited for x in v], pa.int32()) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([tree, leaf, *(part.column(c).take(pa.array(row)) for c in ("class_id", "embedding"))],
                                                 ["tree", "leaf", "query", "vector"])

    def compare(visitors: pa.Table, members: pa.Table) -> pa.Table:
        found = []
        if visitors.num_rows and members.num_rows:
            ids, rows = _first(members["ids"]), _matrix(members["embedding"], dim)
            for q, v in zip(visitors["query"].to_pylist(), _matrix(visitors["vector"], dim)):
                at, far = _nearest(v, rows, ids, k + 1)
                found.append((np.full(len(at), q), at, far))
        query, at, far = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        near = members.select(["class_id", "ids"]).take(pa.array(at, pa.int64()))
        return pa.table([pa.array(query, pa.int64()), near["class_id"], near["ids"], pa.array(far, pa.float64())], ["query", "class_id", "ids", "score"])

    placed = index.select("class_id", "ids", "embedding").mapInArrow(place, f"tree int, leaf int, class_id long, ids array<long>, embedding {vector}")
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("class_id"), F.lit(pieces)).cast("int"))
    visits = queries.select("class_id", "embedding").mapInArrow(visit, f"tree int, leaf int, query long, vector {vector}")
    visits = visits.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    keys = ["tree", "leaf", "piece"]
    return (visits.groupBy(*keys).cogroup(placed.groupBy(*keys))
            .applyInArrow(compare, "query long, class_id long, ids array<long>, score double"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """query, near: (score, vec_id) of its k + 1 nearest rows; a class found in several trees counts once."""
    order = Window.partitionBy("query").orderBy("score", F.col("ids")[0], "class_id")
    few = found.withColumn("at", F.dense_rank().over(order)).filter(F.col("at") <= k + 1)
    once = few.groupBy("query").agg(F.collect_set(F.struct("score", "ids", "class_id")).alias("c"))
    rows = F.flatten(F.transform("c", lambda c: F.transform(c["ids"], lambda i: F.struct(c["score"].alias("score"), i.alias("vec_id")))))
    return once.select("query", F.slice(F.sort_array(rows), 1, k + 1).alias("near"))


def nearest_neighbours(rows: DataFrame, is_query: Column, k: int = K, trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of ``rows`` (vec_id, embedding) with ``is_query``."""
    spark = rows.sparkSession
    valid = columns(rows, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    classes = stored(_classes(valid, k))
    asked = (valid.filter(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
             .join(classes.select("embedding", "class_id"), "embedding"))
    asked = stored(asked.select("query_id", "class_id", "embedding"))
    best = None
    for dim, n in sorted(tuple(r) for r in classes.groupBy(F.size("embedding")).count().collect()):
        of_dim = F.size("embedding") == dim
        index, queries = classes.filter(of_dim), asked.filter(of_dim).dropDuplicates(["class_id"])
        sample = _matrix(index.filter(_share(SAMPLE, n, "sample")).select("embedding").toArrow()["embedding"], dim)
        depth = 0
        while n >> depth > leaf_rows and len(sample) >> depth > LEAF_SAMPLE:
            depth += 1
        forest = Forest(sample, trees if depth else 1, depth)
        least = _probe(index, forest, dim, k, n, recall) if depth else 1
        shipped = spark.sparkContext.broadcast(forest)
        pieces = -(-(n >> depth) // PIECE_ROWS)
        found = stored(_best(_search(index, queries, shipped, dim, least, pieces, k), k))
        short = queries.join(found.filter(F.size("near") < k + 1).select(F.col("query").alias("class_id")), "class_id", "left_semi")
        if depth and not short.isEmpty():  # too few rows in the visited leaves: these queries visit all
            rest = _best(_search(index, short, shipped, dim, trees << depth, pieces, k), k)
            found = found.filter(F.size("near") >= k + 1).unionByName(rest)
        best = found if best is None else best.unionByName(found)
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = F.expr("array_position(transform(near, x -> x.score = 0 AND x.vec_id = query_id), true)")
    others = F.expr("filter(near, (x, i) -> i + 1 != own)")
    listed = asked.select("query_id", F.col("class_id").alias("query")).join(best, "query").withColumn("own", own)
    return (listed.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")))


QUERY_STEP = 100


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
