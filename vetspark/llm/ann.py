"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, skew_join

#: Vectors that the trees are fitted on; every vector is indexed.
SAMPLE = 10_000
#: Leaves that are searched together share a subtree of so many levels (a bit for each leaf makes a long), so that a query's bests are
#: taken over many leaves before they are dealt out; rows of such a subtree that one task compares at a time.
GROUP_LEVELS, GROUP_ROWS = 6, 8_192
#: How fast the chance falls that a neighbour lies beyond a cut, by the cut's distance over the spread of all vectors along its direction.
LEAN = 0.82


@dataclass
class Forest:
    """Trees of equal depth; a tree has one random direction per level, and its nodes cuts of their own down to the level ``fitted``.

    Node i of a level has the children 2i and 2i + 1 on the next; a node below ``fitted`` uses the cut of its ancestor there.
    """

    axis: np.ndarray  # (trees, depth, dim)
    cuts: list[np.ndarray]  # per level: (trees, nodes down to the level fitted)
    spread: float
    fitted: int

    @property
    def shape(self) -> tuple[int, int]:
        return self.axis.shape[:2]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree, (rows, trees)."""
        trees, depth = self.shape
        out = np.zeros((len(x), trees), np.int64)
        for t in range(trees):
            along = x @ self.axis[t].T
            for level in range(depth):
                out[:, t] = 2 * out[:, t] + (along[:, level] > self.cuts[level][t, out[:, t] >> max(0, level - self.fitted)])
        return out

    def visit(self, q: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """The ``leaves`` (tree, leaf) that a neighbour of the query most likely lies in, by one queue over all trees.

        A branch waits under the sum of what its steps cost: the negative logarithm of the chance that a neighbour lies on their side.
        """
        trees, depth = self.shape
        cost = []  # per level: (trees, nodes, 2)
        for level in range(depth):
            m = LEAN * ((self.axis[:, level] @ q)[:, None] - self.cuts[level]) / self.spread
            cost.append(np.stack([np.logaddexp(0, m), np.logaddexp(0, -m)], axis=2).tolist())
        found, queue = [], [(0.0, t, 0, 0) for t in range(trees)]
        while queue and len(found) < leaves:
            so_far, t, level, node = heapq.heappop(queue)
            if level == depth:
                found.append((t, node))
                continue
            low, high = cost[level][t][node >> max(0, level - self.fitted)]
            heapq.heappush(queue, (so_far + low, t, level + 1, 2 * node))
            heapq.heappush(queue, (so_far + high, t, level + 1, 2 * node + 1))
        return found


def fit(sample: np.ndarray, rows: int, trees: int = 8, leaf: int = 64, seed: int = 11) -> Forest:
    """Random directions, cut at the median of the sample's rows that reach a node; as deep as ``rows`` rows need for leaves of ``leaf``."""
    rng = np.random.default_rng(seed)
    depth = max(0, math.ceil(math.log2(max(1, rows) / leaf)))
    fitted = max(0, min(depth, int(math.log2(max(1, len(sample)) / 32)) if len(sample) else 0))
    axis = rng.normal(size=(trees, depth, sample.shape[1]))
    axis /= np.maximum(np.linalg.norm(axis, axis=2, keepdims=True), 1e-300)
    cuts = [np.zeros((trees, 2 ** min(level, fitted))) for level in range(depth)]
    spread = []
    for t in range(trees):
        along, node = sample @ axis[t].T, np.zeros(len(sample), np.int64)
        spread.append(along.std() if along.size else 1.0)
        for level in range(depth):
            at = node >> max(0, level - fitted)
            for i in range(cuts[level].shape[1]):
                if len(here := along[at == i, level]):
                    cuts[level][t, i] = np.median(here)
            node = 2 * node + (along[:, level] > cuts[level][t, at])
    return Forest(axis, cuts, max(float(np.mean(spread)), 1e-300), fitted)


def searched(trees: int, depth: int, effort: float, power: float) -> int:
    """How many leaves a query searches."""
    return min(trees * 2**depth, math.ceil(effort * (trees * 2**depth) ** power))


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10,
    effort: float = 0.9, power: float = 0.7, trees: int = 8, leaf: int = 64, sample: int = SAMPLE, seed: int = 11,
) -> DataFrame:
    """The ``k`` nearest rows found of every row that ``is_query`` (a condition on ``vec_id`` as named) selects: (query_id, rank, vec_id, score).

    Score is the Euclidean distance of the original vectors in double
    precision, computed for every candidate; ties go to the smaller id.  A row
    isn't its own neighbour.  The trees are fitted on ``sample`` rows chosen by hash and get deeper with the table; all
    rows are indexed.  A query searches ``effort`` * n ^ ``power`` of the n leaves of all trees, so that the
    rows it is compared with are a smaller share of a larger table; 1 and 1 search all.  Rows go to their leaf of every
    tree, queries to the leaves that they search, and meet there; a leaf with many rows is split by hash.

    Vectors that are null, zero, or hold null or non-finite components, rows
    without id, and vectors of another length than most have take no part.
    Equal vectors are searched once; of those only the ``k`` + 1 smallest ids can be among the nearest, so others
    stand back.  A row that repeats id and vector counts once; an id with several
    vectors stands once for each, and never as its own neighbour.  Fewer candidates give fewer rows; no rows give no rows.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), is_query.alias("is_query")).filter(_usable(F.col("v")) & F.col("vec_id").isNotNull())
    rows = materialise(rows.withColumn("key", F.xxhash64("v")), "ann-rows")
    usual = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    id_type = rows.schema["vec_id"].dataType.simpleString()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    dim = usual["dim"]
    rows = rows.filter(F.size("v") == dim)
    picked = rows.select("v", F.xxhash64(F.lit(seed), "vec_id").alias("h")).orderBy("h", "v").limit(sample).drop("h").toPandas()["v"]

    among = F.dense_rank().over(Window.partitionBy("key", "v").orderBy("vec_id"))
    held = rows.select("key", "v", "vec_id").withColumn("among", among).filter(F.col("among") <= k + 1)
    unique = held.groupBy("key", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    unique = materialise(unique.select(F.monotonically_increasing_id().alias("row"), "ids", "v"), "ann-distinct")
    forest = fit(np.array(picked.tolist(), np.float64).reshape(-1, dim), unique.count(), trees, leaf, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(forest)
    up = min(GROUP_LEVELS, forest.shape[1])
    n_leaves = searched(*forest.shape, effort, power)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = shared.value.leaves(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.tolist(), pa.list_(pa.int64()))], names=["row", "ids", "v", "leaf"])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The subtrees that a query searches, and a bit for each of their leaves that it does."""
        for b in batches:
            visits = []
            for x in _matrix(b.column(1)):
                masks: defaultdict[tuple[int, int], int] = defaultdict(int)
                for t, at in shared.value.visit(x, n_leaves):
                    masks[t, at >> up] |= 1 << (at & (2**up - 1))
                visits.append([{"tree": t, "subtree": at, "mask": m - (m >> 63 << 64)} for (t, at), m in masks.items()])
            kind = pa.list_(pa.struct([("tree", pa.int32()), ("subtree", pa.int64()), ("mask", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(visits, kind)], names=["query", "q", "visits"])

    indexed = unique.mapInArrow(index, f"row long, ids array<{id_type}>, v array<double>, leaf array<long>")
    indexed = indexed.select("row", "ids", "v", F.posexplode("leaf").alias("tree", "leaf")).withColumn("subtree", F.shiftright("leaf", up)).withColumn("within", F.col("leaf").bitwiseAND(F.lit(2**up - 1))).drop("leaf")
    asked = rows.filter("is_query").select("key", "v", "vec_id").distinct()
    distinct = asked.select("key", F.col("v").alias("q")).distinct()
    numbered = materialise(distinct.select(F.monotonically_increasing_id().alias("query"), "key", "q"), "ann-queries")
    planned = numbered.select("query", "q").mapInArrow(plan, "query long, q array<double>, visits array<struct<tree:int,subtree:long,mask:long>>").select("query", "q", F.inline("visits"))

    large = materialise(indexed.groupBy("tree", "subtree").count().filter(F.col("count") > GROUP_ROWS).select("tree", "subtree", F.ceil(F.col("count") / GROUP_ROWS).alias("pieces")), "ann-large")
    pieces = F.coalesce("pieces", F.lit(1).cast("long"))
    by_row = indexed.join(large, ["tree", "subtree"], "left").withColumn("piece", F.pmod(F.xxhash64("row"), pieces)).select("tree", "subtree", "piece", "row", "ids", "v", "within")
    by_query = planned.join(large, ["tree", "subtree"], "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).select("tree", "subtree", "piece", "query", "q", "mask")

    shape = {"query": pa.int64(), "row": pa.int64(), "vec_id": to_arrow_type(rows.schema["vec_id"].dataType), "score": pa.float64()}

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c in shape}
        if left.num_rows and right.num_rows:
            x, within, number, ids = _matrix(left.column("v").combine_chunks()), left.column("within").to_numpy(), left.column("row").to_pylist(), left.column("ids").to_pylist()
            for query, v, mask in zip(right.column("query").to_pylist(), _matrix(right.column("q").combine_chunks()), right.column("mask").to_pylist(), strict=True):
                near = np.flatnonzero(mask >> within & 1)
                d = np.sqrt(((x[near] - v) ** 2).sum(axis=1))
                if len(d) > k + 1:
                    best = d <= np.partition(d, k)[k]
                    near, d = near[best], d[best]
                for s, i, r in sorted((s, i, r) for s, r in zip(d.tolist(), near.tolist(), strict=True) for i in ids[r])[: k + 1]:
                    found["query"].append(query)
                    found["row"].append(number[r])
                    found["vec_id"].append(i)
                    found["score"].append(s)
        return pa.table({c: pa.array(found[c], t) for c, t in shape.items()})

    keys = ("tree", "subtree", "piece")
    hits = by_row.groupBy(*keys).cogroup(by_query.groupBy(*keys)).applyInArrow(search, f"query long, row long, vec_id {id_type}, score double")
    first = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    best = hits.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    best = materialise(skew_join(numbered, best, ["query"]).select("key", F.col("q").alias("v"), "best"), "ann-best", unique, large)
    each = skew_join(asked.withColumnRenamed("vec_id", "query_id"), best, ["key", "v"])
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = each.select("query_id", F.posexplode(own).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
