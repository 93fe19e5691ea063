"""Approximate nearest neighbours by a forest of random-projection trees.

The trees' splits are fitted on a bounded sample; every vector is then put into its leaf of every tree. A query walks
all trees through one priority queue, always opening the branch with the least distance to the splits crossed on its
way, until the opened leaves hold a share of all vectors. The leaves' vectors are compared with it exactly.

The index is a table of (tree, leaf, block) and the walk needs the splits and the leaves' sizes only, which are bounded
by the sample. Leaves meet their queries in a cogroup: no pairs are written, each task keeps the best few per query.
A leaf with many rows is cut into blocks of bounded size. Rows with equal vectors are one entry of the index, the one of
the least id; their ids are joined back at the end, so copies of one vector use up no query's share.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm.common import saved, spread_join

TREES, LEAF, SAMPLE = 24, 16, 8192
SHARE = 0.75
BLOCK_ROWS, GROUP_ROWS, QUERY_ROWS = 4096, 16384, 4096


class Tree:
    """Arrays of splits: node i sends x to ``right`` where x . normal > offset, else to ``left``; a leaf has normal -1."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals, self.offsets, self.left, self.right, self.which = [], [], [], [], []
        self._grow(sample, np.arange(len(sample)), leaf, rng)
        self.normals = np.array(self.normals, np.float32).reshape(-1, sample.shape[1])

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        me = len(self.which)
        for column, value in ((self.which, -1), (self.offsets, 0.0), (self.left, -1), (self.right, -1)):
            column.append(value)
        if len(rows) <= leaf:
            return me
        a = x[rng.choice(rows)]
        others = rows[(x[rows] != a).any(axis=1)]
        if not len(others):
            return me
        b = x[rng.choice(others)]
        for _ in range(4):  # two means of the rows, from two random ones
            side = x[rows] @ (a - b) > 0
            if side.all() or not side.any():
                break
            a, b = x[rows[side]].mean(axis=0), x[rows[~side]].mean(axis=0)
        normal = (a - b) / max(float(np.linalg.norm(a - b)), 1e-12)
        at = x[rows] @ normal
        offset = float(np.median(at))
        side = at > offset
        if not side.any():  # half of the rows or more have the largest value: they go to one side
            below = at[at < offset]
            if not len(below):
                return me
            offset = (float(below.max()) + offset) / 2
            side = at > offset
            if side.all() or not side.any():
                return me
        self.which[me], self.offsets[me] = len(self.normals), offset
        self.normals.append(normal)
        self.left[me] = self._grow(x, rows[~side], leaf, rng)
        self.right[me] = self._grow(x, rows[side], leaf, rng)
        return me

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.which[node] < 0:
                out[rows] = node
            elif len(rows):
                side = x[rows] @ self.normals[self.which[node]] > self.offsets[node]
                todo += [(self.left[node], rows[~side]), (self.right[node], rows[side])]
        return out


def walk(trees: list[Tree], query: np.ndarray, sizes: list[dict[int, int]], enough: float) -> list[tuple[int, int]]:
    """The leaves (tree, node) that one shared queue opens for a query, until they hold ``enough`` vectors."""
    at = [t.normals @ query for t in trees]
    queue, found, held = [(0.0, i, 0) for i in range(len(trees))], [], 0
    heapq.heapify(queue)
    while queue and held < enough:
        far, i, node = heapq.heappop(queue)
        tree = trees[i]
        if tree.which[node] < 0:
            n = sizes[i].get(node, 0)
            if n:
                found.append((i, node))
                held += n
            continue
        margin = float(at[i][tree.which[node]]) - tree.offsets[node]
        near, other = (tree.right, tree.left) if margin > 0 else (tree.left, tree.right)
        heapq.heappush(queue, (far, i, near[node]))
        heapq.heappush(queue, (max(far, abs(margin)), i, other[node]))
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _rows(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _best(frame_q: pd.DataFrame, frame_v: pd.DataFrame, k: int) -> tuple[list, list, list]:
    """The k best vectors of one leaf block for each query: largest cosine, ties to the smaller id."""
    q, v = np.array(frame_q["vector"].tolist()), np.array(frame_v["vector"].tolist())
    qi, vi = frame_q["id"].to_numpy(), frame_v["id"].to_numpy()
    qn, vn = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    rough = (q @ v.T) / qn[:, None] / vn
    out_q, out_v, out_s = [], [], []
    floor = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    for i in range(len(q)):
        near = np.flatnonzero(rough[i] >= floor[i] - 1e-9)
        exact = (v[near] * q[i]).sum(axis=1) / (qn[i] * vn[near])
        top = np.lexsort((vi[near], -exact))[:k]
        out_q += [qi[i]] * len(top)
        out_v += vi[near][top].tolist()
        out_s += exact[top].tolist()
    return out_q, out_v, out_s


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    trees: int = TREES,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    share: float = SHARE,
    seed: int = 7,
) -> DataFrame:
    """The ``k`` nearest of ``vectors`` found for each of ``queries`` (same columns): ``query_id``, ``rank`` (from 1),
    the id as ``vec_id``, and ``score``, the cosine in double precision.

    ``sample`` distinct vectors at most, those of the least hash of their id, fit the trees; all are indexed. A query opens
    leaves until they hold ``share`` of all distinct vectors, counted over all trees (a vector counts once for each tree,
    however many rows have it), which sets recall against work: vectors without structure need most of the table,
    clustered ones a small share. Of rows that repeat an id the one of the least vector is a candidate, and the query. Null vectors, vectors of zero length and vectors with null or non-finite
    components take no part, nor do null ids; vectors of another dimension than most of the sample's are left out too.
    Ties go to the smaller id. An empty table gives no rows; a query with fewer candidates than ``k`` gets all of them.
    Other columns are not read. The splits' number is bounded by ``sample`` and so is what a walk needs; with more rows
    leaves hold more, unless ``sample`` is raised with them.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")

    def valid(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vector")).where("id IS NOT NULL AND size(vector) > 0")
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.where(finite).where(F.exists("vector", lambda x: x != 0)).groupBy("id").agg(F.min("vector").alias("vector"))

    # of rows with one vector, the k + 1 of the least ids can be among a query's k best
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    least = valid(vectors).withColumn("rank", rank).where(F.col("rank") <= k + 1)
    base = saved(least.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "vector", "ids"))
    fitted = base.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toPandas()["vector"]
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(fitted):
        return vectors.sparkSession.createDataFrame([], schema)
    dim = int(fitted.map(len).mode()[0])
    points = _unit(np.array([x for x in fitted if len(x) == dim]))
    base = base.where(F.size("vector") == dim)
    copies = base.select(F.col("id").alias("first_id"), "ids")
    rng = np.random.default_rng(seed)
    sc = vectors.sparkSession.sparkContext
    forest = sc.broadcast([Tree(points, leaf, rng) for _ in range(trees)])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_rows(batch.column(1)))
                found = np.stack([t.leaves(x) for t in forest.value], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.tolist(), pa.list_(pa.int32()))], names=["id", "vector", "leaves"])

    placed = saved(base.select("id", "vector").mapInArrow(leaves, "id long, vector array<double>, leaves array<int>"))
    each = placed.select("id", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    # bounded by the sample: trees * nodes rows
    counts = [(r["tree"], r["leaf"], r["n"]) for r in each.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()]
    sizes: list[dict[int, int]] = [{} for _ in range(trees)]
    for t, node, n in counts:
        sizes[t][node] = n
    total = sum(sizes[0].values())
    shared = sc.broadcast(sizes)
    groups = max(1, total * trees // GROUP_ROWS)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [walk(forest.value, x, shared.value, share * total) for x in _unit(_rows(batch.column(1)))]
                trees_of, leaves_of = ([[p[i] for p in f] for f in found] for i in (0, 1))
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees_of, ints), pa.array(leaves_of, ints)], names=["id", "vector", "trees", "leaves"])

    asked = valid(queries).where(F.size("vector") == dim).repartition(max(8, groups // 4), "id")
    asked = saved(asked.mapInArrow(probes, "id long, vector array<double>, trees array<int>, leaves array<int>"))
    asked = asked.select("id", "vector", F.explode(F.arrays_zip("trees", "leaves")).alias("p"))
    asked = asked.select("id", "vector", F.col("p.trees").alias("tree"), F.col("p.leaves").alias("leaf"))
    # of a leaf that many rows lie in or many queries open, every block of rows meets every block of queries
    opened = {(r["tree"], r["leaf"]): r["n"] for r in asked.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = [(t, node, -(-n // BLOCK_ROWS), -(-opened.get((t, node), 1) // QUERY_ROWS)) for t, node, n in counts]
    blocks = [b for b in blocks if b[2] > 1 or b[3] > 1] or [(-1, -1, 1, 1)]
    wide = F.broadcast(vectors.sparkSession.createDataFrame(blocks, "tree int, leaf int, row_blocks int, query_blocks int"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("own", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("others", F.lit(1)) - 1))
    held = each.join(wide.withColumnsRenamed({"row_blocks": "own", "query_blocks": "others"}), ["tree", "leaf"], "left")
    held = held.withColumn("block", part).withColumn("query_block", other).drop("own", "others")
    asked = asked.join(wide.withColumnsRenamed({"query_blocks": "own", "row_blocks": "others"}), ["tree", "leaf"], "left")
    asked = asked.withColumn("query_block", part).withColumn("block", other).drop("own", "others")
    group = F.pmod(F.xxhash64("tree", "leaf", "block", "query_block"), F.lit(groups)).cast("int")
    asked, held = asked.withColumn("group", group), held.withColumn("group", group)

    def compare(asked_frame: pd.DataFrame, held_frame: pd.DataFrame) -> pd.DataFrame:
        out_q, out_v, out_s = [], [], []
        keys = ["tree", "leaf", "block", "query_block"]
        mine = {key: frame for key, frame in held_frame.groupby(keys)}
        for key, frame in asked_frame.groupby(keys):
            if key in mine:
                for into, some in zip((out_q, out_v, out_s), _best(frame, mine[key], k + 1)):
                    into += some
        found = pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, np.float64)})
        found = found.drop_duplicates(["query_id", "vec_id"]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("query_id").head(k + 1)

    best = asked.groupBy("group").cogroup(held.groupBy("group")).applyInPandas(compare, "query_id long, vec_id long, score double")
    # k + 1 distinct vectors, since one may be the query's own; then their rows without the query's. Ranks are limited in
    # each task before rows are dealt by query, and a vector that several trees found has one rank
    near = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = best.withColumn("near", near).where(F.col("near") <= k + 1).groupBy("query_id", "vec_id").agg(F.first("score").alias("score"))
    hits = top.withColumnRenamed("vec_id", "first_id")

    def first(n: int, what: str) -> Column:
        return F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("far"), what))), 1, n).alias("top")

    hits = spread_join(hits, copies, ["first_id"], ["query_id"]).select("query_id", "score", F.explode("ids").alias("vec_id"))
    out = hits.where("vec_id <> query_id").groupBy("query_id").agg(first(k, "vec_id")).select("query_id", F.posexplode("top").alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
