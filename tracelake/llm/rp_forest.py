"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue, then exact reranking.

Each tree halves a bounded sample again and again by the plane between two random points; every vector of the table is
then routed to one leaf of each tree. A query opens leaves of all trees through one shared queue, nearest plane first,
until they hold enough vectors, and these are ranked by their true distance.

Equal vectors are one entry of the index with the ids that can be in a result, so very many copies of one vector are as
cheap as one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.shared import bounded_sample, slices, written

# Vectors that the trees are grown on, at most, and those that a leaf of the sample may have.
SAMPLE_ROWS = 20_000
LEAF_ROWS = 24
TREES = 12
# A query stops opening leaves when they hold this share of all leaves' rows, and so many rows at least. On vectors
# without any structure recall needs a share of the table; on clustered ones a smaller share will do.
SEARCH_SHARE, SEARCH_ROWS = 0.06, 12_000
NEIGHBOURS = 10
# Vectors and queries of a leaf meet in blocks of about so many.
MEMBERS, ASKING = 256, 64


@dataclass
class Forest:
    """All trees' planes in one list of nodes: children 0 and more are nodes, others are leaves -1, -2, ..."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaves: int

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.roots)), np.int64)
        for tree, root in enumerate(self.roots):
            node = np.full(len(vectors), root, np.int64)
            open_ = np.flatnonzero(node >= 0)
            while open_.size:
                at = node[open_]
                margin = np.einsum("ij,ij->i", vectors[open_], self.normals[at]) - self.offsets[at]
                node[open_] = self.children[at, (margin > 0).astype(np.int64)]
                open_ = open_[node[open_] >= 0]
            out[:, tree] = -1 - node
        return out

    def search(self, vector: np.ndarray, sizes: np.ndarray, rows: int) -> list[int]:
        """Leaves, nearest plane first, until they hold ``rows`` rows."""
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < rows:
            distance, node = heapq.heappop(queue)
            if node < 0:
                if sizes[-1 - node]:
                    found.append(-1 - node)
                    held += int(sizes[-1 - node])
                continue
            margin = float(self.normals[node] @ vector - self.offsets[node])
            near, far = (1, 0) if margin > 0 else (0, 1)
            heapq.heappush(queue, (distance, int(self.children[node, near])))
            heapq.heappush(queue, (max(distance, abs(margin)), int(self.children[node, far])))
        return found


def grow(sample: np.ndarray, trees: int, leaf_rows: int = LEAF_ROWS, seed: int = 3) -> Forest:
    rng = np.random.default_rng(seed)
    normals, offsets, children, roots = [], [], [], []
    leaves = 0

    def leaf() -> int:
        nonlocal leaves
        leaves += 1
        return -leaves

    for _ in range(trees):
        stack = [(np.arange(len(sample)), None, 0)]
        while stack:
            rows, parent, side = stack.pop()
            split = _plane(sample, rows, rng) if len(rows) > leaf_rows else None
            node = leaf() if split is None else len(normals)
            if parent is None:
                roots.append(node)
            else:
                children[parent][side] = node
            if split is not None:
                normal, offset, right = split
                normals.append(normal)
                offsets.append(offset)
                children.append([0, 0])
                stack += [(rows[~right], node, 0), (rows[right], node, 1)]
    width = sample.shape[1] if sample.ndim == 2 else 0
    return Forest(
        np.array(normals).reshape(len(normals), width), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), roots, leaves
    )


def _plane(sample: np.ndarray, rows: np.ndarray, rng: np.random.Generator):
    """The unit plane between two random points, and which rows are beyond it; none if it parts nothing."""
    for _ in range(8):
        a, b = sample[rng.choice(rows, 2, replace=False)]
        normal = b - a
        length = np.linalg.norm(normal)
        if not np.isfinite(length) or length == 0:
            continue
        normal = normal / length
        offset = float(normal @ ((a + b) / 2))
        right = sample[rows] @ normal - offset > 0
        if right.any() and not right.all():
            return normal, offset, right
    return None


def usable(vectors: DataFrame, vector_id: str, vector: str) -> DataFrame:
    """(id, vec): rows with an id and a vector that is not null, empty or zero and has only finite components.

    Of vectors of different lengths the most frequent length takes part, of equally frequent ones the longest.
    """
    plain = vectors.select(F.col(vector_id).cast("long").alias("id"), F.col(vector).alias("vec")).where(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    sizes = plain.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return plain.where(F.size("vec") == (sizes["n"] if sizes else 0))


def entries(plain: DataFrame, k: int) -> DataFrame:
    """(key, vec, ids): each different vector once, by its smallest id, with its ``k + 1`` smallest ids.

    No other copy can be among the ``k`` nearest of any query, as the smaller ids come first and one may be its own.
    """
    ranked = plain.distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("vec").orderBy("id")))
    few = ranked.where(F.col("_rank") <= k + 1)
    return few.groupBy("vec").agg(F.min("id").alias("key"), F.sort_array(F.collect_list("id")).alias("ids"))


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of double."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _with_leaves(rows: DataFrame, key: str, shared, sizes=None, search_rows: int = 0) -> DataFrame:
    """(key, vec, leaf): the leaves that each vector is in, or with ``sizes`` those that a search of it opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for part in slices(batches, 1024):
            vectors = _vectors(part.column("vec"))
            if sizes is None:
                leaves = forest.route(vectors).tolist()
            else:
                leaves = [forest.search(v, sizes.value, search_rows) for v in vectors]
            columns = [part.column(key), part.column("vec"), pa.array(leaves, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [key, "vec", "leaves"])

    kind = rows.schema["vec"].dataType.simpleString()
    found = rows.select(key, "vec").mapInArrow(run, f"{key} long, vec {kind}, leaves array<long>")
    return found.select(key, "vec", F.explode("leaves").alias("leaf"))


def _blocks(rows: DataFrame, key: str, sizes: DataFrame, size: int, name: str) -> DataFrame:
    """(leaf, name): the rows of a leaf in lists of about ``size`` (key, vec), by a hash of the key."""
    n = F.ceil(F.col("_rows") / size).cast("int")
    dealt = rows.join(sizes, "leaf").withColumn("_block", F.pmod(F.xxhash64(key), n))
    lists = dealt.groupBy("leaf", "_block").agg(F.collect_list(F.struct(F.col(key).alias("key"), "vec")).alias(name))
    return lists.select("leaf", name)


def _nearest_in_blocks(met: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score): of each query in a pair of blocks the ``k + 1`` nearest vectors of the other block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 16):
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for n in range(part.num_rows):
                asking, members = (part.column(c)[n].values for c in ("asking", "members"))
                queries, keys = (x.field("key").to_numpy() for x in (asking, members))
                a, b = (_vectors(x.field("vec")) for x in (asking, members))
                for query, own in zip(queries, a):
                    score = np.sqrt(((b - own) ** 2).sum(axis=1))
                    first = np.lexsort((keys, score))[: k + 1]
                    out.append((np.full(len(first), query), keys[first], score[first]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "key", "score"])

    return met.select("asking", "members").mapInArrow(run, "query_id long, key long, score double")


def nearest(
    vectors: DataFrame,
    queries: Column,
    vector_id: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    trees: int = TREES,
    search_share: float = SEARCH_SHARE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, ``vector_id``, score): the ``k`` nearest other rows found for each row where ``queries`` holds.

    ``queries`` is a condition on the id. Nearest first by Euclidean distance, ties by smaller id. Vectors that are null,
    empty or zero, or hold null or other than finite components, take no part, nor do rows without an id or with another
    length than most. Rows that repeat an id are one row if their vectors are equal. The trees are grown on at most
    ``sample_rows`` vectors; every vector is in the index. No vectors, no rows.
    """
    spark = vectors.sparkSession
    plain = usable(vectors, vector_id, vector)
    table = written(spark, entries(plain, k), "vectors")
    sample = bounded_sample(table.select("key", "vec"), sample_rows, ["key"]).orderBy("key").collect()
    grown = grow(np.array([r["vec"] for r in sample], np.float64), trees if sample else 0)
    forest = spark.sparkContext.broadcast(grown)
    index = written(spark, _with_leaves(table, "key", forest), "leaves")
    held = index.groupBy("leaf").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = np.zeros(max(1, grown.leaves), np.int64)
    # One row per leaf; the sample bounds their number.
    for row in held.collect():
        sizes[row["leaf"]] = row["_rows"]
    enough = int(max(SEARCH_ROWS, search_share * sizes.sum()))
    asked = plain.where(queries).distinct().select(F.col("id").alias("query_id"), "vec")
    opened = written(
        spark, _with_leaves(asked, "query_id", forest, spark.sparkContext.broadcast(sizes), enough), "opened"
    )
    asking = opened.groupBy("leaf").agg(F.count(F.lit(1)).alias("_rows"))
    met = _blocks(opened, "query_id", asking, ASKING, "asking").join(_blocks(index, "key", held, MEMBERS, "members"), "leaf")
    scored = _nearest_in_blocks(met, k).distinct()
    few = scored.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "key"))
    ).where(F.col("_rank") <= k + 1)
    each = few.join(table.select("key", "ids"), "key").select("query_id", F.explode("ids").alias("id"), "score")
    each = each.where("id <> query_id").distinct()
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(vector_id), "score")
