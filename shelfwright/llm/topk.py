"""Exact top-k inner products by two cover trees.

Rows are dealt to cells, each with a centre and a covering radius, and large cells to blocks. Each query cell
meets its own cell first. What it found bounds the worst kth score of its queries, and only those other cells
follow whose balls can reach that score. A pair of blocks is one task's group: there both sides are indexed by
a cover tree (nested nets whose radius halves by level), and the pair of trees is walked together: a pair of
nodes is dropped when no inner product between their balls can reach the worst kth score of the query node.
What the blocks found is merged by rank, so the result is exact. In many dimensions, and without clusters,
the balls of all cells reach each other, and all pairs of blocks meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, small_batches

LEAF = 64
#: Cells at most: their centres and pairs are held by the driver and each task.
MAX_CELLS = 512


class CoverTree:
    """Nets over the rows of x: centre c and radius r hold each row of a node's range of `order`."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.low, self.high, self.children = [], [], [], [], []
        if len(x):
            rows = np.arange(len(x))
            self._node(rows, 0, np.sqrt(((x - x[0]) ** 2).sum(axis=1)), 0)

    def _node(self, rows: np.ndarray, centre: int, far: np.ndarray, at: int) -> int:
        """rows: those of the node, far: their distances to its centre, at: where its range starts."""
        node, r = len(self.centre), float(far.max())
        self.centre.append(centre), self.radius.append(r), self.low.append(at), self.high.append(at + len(rows)), self.children.append([])
        self.order[at : at + len(rows)] = rows
        if len(rows) <= LEAF or r == 0:
            return node
        left, d = rows, far
        while len(left):  # a net of half the radius: the first row left is a centre, and takes what it covers
            near = int(left[np.argmin(d)]) if not self.children[node] else int(left[0])
            to = np.sqrt(((self.x[left] - self.x[near]) ** 2).sum(axis=1))
            own = to <= r / 2
            if own.sum() * 4 < LEAF and len(left) > LEAF:  # a sparse net: the nearest rows make a node, whatever its radius
                own = np.zeros(len(left), bool)
                own[np.argpartition(to, LEAF - 1)[:LEAF]] = True
            self.children[node].append(self._node(left[own], near, to[own], at))
            at += int(own.sum())
            left, d = left[~own], d[~own]
        return node


def dual_top_k(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best rows of data for each query, best first, ties to smaller ids; scores of -inf where there are fewer.

    Scores under a query's `least` need not be found. Both arrays hold whole numbers in float64, and inner products stay below 2**53.
    """
    n = len(queries)
    least = np.full(n, -np.inf) if least is None else least
    score, ident, count = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.zeros(n, int)
    if not n or not len(data):
        return score, ident
    q, d = CoverTree(queries), CoverTree(data)
    q_norm, d_norm = (np.sqrt((t.x[t.centre] ** 2).sum(axis=1)) for t in (q, d))
    between = q.x[q.centre] @ d.x[d.centre].T
    q_r, d_r = np.array(q.radius), np.array(d.radius)
    upper = between + q_norm[:, None] * d_r + d_norm * q_r[:, None] + q_r[:, None] * d_r
    upper += 1e-9 * np.abs(upper) + 1e-3

    def leaf(a: int, b: int) -> None:
        qi, di = q.order[q.low[a] : q.high[a]], d.order[d.low[b] : d.high[b]]
        s = queries[qi] @ data[di].T
        ids = np.broadcast_to(data_ids[di], s.shape)
        s = np.where(ids == query_ids[qi][:, None], -np.inf, s)
        hit = np.flatnonzero((s >= np.maximum(score[qi, -1], least[qi])[:, None]).any(axis=1))
        if not len(hit):
            return
        s, ids = np.hstack([score[qi[hit]], s[hit]]), np.hstack([ident[qi[hit]], ids[hit]])
        best = np.lexsort((ids, -s), axis=1)[:, :k]
        score[qi[hit]], ident[qi[hit]] = np.take_along_axis(s, best, 1), np.take_along_axis(ids, best, 1)

    def walk(a: int, b: int) -> None:
        own = q.order[q.low[a] : q.high[a]]
        if upper[a, b] < np.maximum(score[own, -1], least[own]).min():
            return
        if q.children[a] and (not d.children[b] or q.radius[a] > d.radius[b]):
            for c in q.children[a]:
                walk(c, b)
        elif d.children[b]:
            kids = d.children[b]
            for c in np.argsort(-upper[a, kids]):
                walk(a, kids[c])
        else:
            leaf(a, b)

    walk(0, 0)
    ident[np.isinf(score)] = np.iinfo(np.int64).max
    return score, ident


def _reach(c1: np.ndarray, r1: np.ndarray, c2: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """The greatest inner product that the balls of c1 and those of c2 can have, rounded up."""
    n1, n2 = np.sqrt((c1**2).sum(axis=1)), np.sqrt((c2**2).sum(axis=1))
    upper = c1 @ c2.T + n1[:, None] * r2 + n2 * r1[:, None] + r1[:, None] * r2
    return upper + 1e-9 * np.abs(upper) + 1e-3


def _in_cells(centres: dict[int, np.ndarray]):
    """Adds the cell (the nearest centre of the vector's length; 0 stands for the origin) and the distance to its centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for dim, part in rows.groupby("dim"):
                x, c = np.stack(part["x"].to_list()), np.vstack([np.zeros((1, dim)), centres.get(dim, np.empty((0, dim)))])
                to = (c**2).sum(axis=1) - 2 * x @ c.T
                cell = to[:, 1:].argmin(axis=1) + 1 if len(c) > 1 else np.zeros(len(x), int)
                yield part.assign(cell=cell, far=np.sqrt(((x - c[cell]) ** 2).sum(axis=1)))

    return run


def _meet(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q_ids, d_ids = left["vec_id"].to_numpy(np.int64), right["vec_id"].to_numpy(np.int64)
        score, ident = dual_top_k(np.stack(left["x"].to_list()), q_ids, np.stack(right["x"].to_list()), d_ids, k, left["least"].to_numpy(float))
        keep = ~np.isinf(score)
        return pd.DataFrame({"query_id": np.repeat(q_ids, k).reshape(score.shape)[keep], "vec_id": ident[keep], "score": score[keep].astype(np.int64)})

    return run


def exact_top_k(vectors: DataFrame, *, k: int = 5, query_every: int = 50, scale: int = 256, block_rows: int = 8192, query_block_rows: int = 8192) -> DataFrame:
    """The k best candidates of each query row of vectors(vec_id, embedding).

    Components become floor(scale * x). Rows with a null id, a null vector or null or non-finite components
    take no part; vectors of different length don't meet; a query is no candidate for its own vec_id, so
    repeated rows of one id don't meet either, and each repeated candidate row counts by itself. Of rows
    that share a query's id the one with the shortest, then the least vector is the query. Inner products
    must stay below 2**53. Other columns are ignored; an empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double")).alias("x")).withColumn("dim", F.size("x")).filter("dim > 0")
    rows = materialize(rows, "vectors")
    wanted = min(MAX_CELLS, math.ceil(rows.count() / block_rows))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect() if wanted > 1 else []  # the centres: MAX_CELLS rows at most
    centres = {dim: np.unique([r["x"] for r in sample if r["dim"] == dim], axis=0) for dim in {r["dim"] for r in sample}}
    placed = materialize(rows.mapInPandas(_in_cells(centres), "vec_id long, x array<double>, dim int, cell int, far double"), "cells")
    asked = placed.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "x", "cell", "far")).alias("q")).select("vec_id", "q.*")
    asked = materialize(asked, "queries")
    facts = lambda df: df.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("r"))
    sizes = facts(placed).join(facts(asked).withColumnsRenamed({"n": "nq", "r": "rq"}), ["dim", "cell"], "left").fillna(0).toPandas()  # a row for each cell and length
    sizes["parts"] = np.ceil(sizes["n"] / block_rows).astype(int)
    part = lambda parts: F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col(parts))
    keys = ["dim", "other", "q_part", "part"]

    def search(pairs: pd.DataFrame, least: DataFrame | None) -> DataFrame:
        """What the query cells `cell` find in the cells `other`. Queries of all cells that visit a block of data meet it together."""
        visits = pairs.groupby(["dim", "other"])["nq"].transform("sum")
        pairs = pairs.assign(q_parts=np.ceil(visits / query_block_rows).astype(int))
        visited = pairs[["dim", "other", "q_parts", "parts"]].drop_duplicates()
        pairs = F.broadcast(spark.createDataFrame(pairs[["dim", "cell", "other", "q_parts", "parts"]], "dim int, cell int, other int, q_parts int, parts int"))
        visited = F.broadcast(spark.createDataFrame(visited, "dim int, other int, q_parts int, parts int"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        queries = asked.withColumn("least", F.lit(float("-inf"))) if least is None else asked.join(least, "vec_id")
        queries = queries.join(pairs, ["dim", "cell"]).withColumn("q_part", part("q_parts").cast("int")).withColumn("part", each("parts"))
        data = placed.withColumnRenamed("cell", "other").join(visited, ["dim", "other"]).withColumn("part", part("parts").cast("int")).withColumn("q_part", each("q_parts"))
        left, right = queries.select(*keys, "vec_id", "x", "least"), data.select(*keys, "vec_id", "x")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_meet(k), "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    own = sizes[sizes["nq"] > 0].assign(other=lambda t: t["cell"])
    found = best(search(own, None))
    if len(sizes) <= 1 or not len(own):
        return found
    found = materialize(found, "found")
    kth = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.max(F.when(F.col("rank") == k, F.col("score"))).cast("double").alias("kth"))
    least = materialize(asked.select("vec_id", "dim", "cell").join(kth, "vec_id", "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf")))), "least")
    worst = {(r["dim"], r["cell"]): r["worst"] for r in least.groupBy("dim", "cell").agg(F.min("least").alias("worst")).collect()}  # a row for each query cell
    pairs = []
    for dim, cells in sizes.groupby("dim"):
        c = np.vstack([np.zeros((1, dim)), centres.get(dim, np.empty((0, dim)))])
        asking = cells[cells["nq"] > 0]
        reach = _reach(c[asking["cell"]], asking["rq"].to_numpy(float), c[cells["cell"]], cells["r"].to_numpy(float))
        a, b = np.nonzero((reach >= np.array([worst[dim, cell] for cell in asking["cell"]])[:, None]) & (asking["cell"].to_numpy()[:, None] != cells["cell"].to_numpy()))
        pairs.append(pd.DataFrame({"dim": dim, "cell": asking["cell"].to_numpy()[a], "other": cells["cell"].to_numpy()[b], "nq": asking["nq"].to_numpy()[a], "parts": cells["parts"].to_numpy()[b]}))
    every = pd.concat(pairs)
    return best(found.drop("rank").unionByName(search(every, least.select("vec_id", "least")))) if len(every) else found
