"""Exact top-k inner products: a ball tree per shard, branch and bound over all shards.

Vectors are routed to shards by a tree built on a bounded sample, so that shards are compact and whole shards can be left out.

A block of queries first searches its own shard, then the others in the order of their roots' bounds,
and keeps its current kth scores throughout, so what one shard found prunes the next. Within a tree, nodes
are taken in the order of the largest inner product that any query of the block can have in them, q.c + |q| r;
a node is searched only for the queries whose bound reaches their kth score.

A node is split halfway between its two poles' projections, so clusters stay whole; where that would leave nearly all on one side,
or a branch is already deep, it is split into halves.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .common import Scratch
from .rpforest import ROUTING_SAMPLE, SEED
from .rpforest import build_tree as routing_tree
from .vectors import QUERY_EVERY, UNIT, TopK, build_shards, clean_vectors, matrix, search_blocks, with_shards

K = 10
SHARD_ROWS = 16_384
LEAF = 128


def build_tree(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """Arrays of a ball tree: rows in tree order, and each node's center, radius, rows and children (-1: leaf)."""
    order = np.arange(len(x))
    center, radius, lo_, hi_, left, right = [], [], [], [], [], []
    deepest = 2 * int(np.ceil(np.log2(max(2, len(x) / leaf))))

    def node(lo: int, hi: int, depth: int = 0) -> int:
        me, part = len(center), x[order[lo:hi]]
        c = part.mean(axis=0)
        d = np.sqrt(((part - c) ** 2).sum(axis=1))
        center.append(c)
        radius.append(d.max() * (1 + 1e-12) + 1e-12)
        for a, v in ((lo_, lo), (hi_, hi), (left, -1), (right, -1)):
            a.append(v)
        if hi - lo > leaf and d.max() > 0:
            a = part[d.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            p = part @ (a - b)
            by = np.argsort(p, kind="stable")
            half = int(np.searchsorted(p[by], (a + b) @ (a - b) / 2))
            if depth >= deepest or half in (0, hi - lo):
                half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][by]
            left[me] = node(lo, lo + half, depth + 1)
            right[me] = node(lo + half, hi, depth + 1)
        return me

    if len(x):
        node(0, len(x))
    tree = np.array([lo_, hi_, left, right], dtype=np.int64).T.reshape(-1, 4)
    dim = x.shape[1] if x.ndim == 2 else 0
    return {"ids": ids[order], "x": x[order], "center": np.array(center).reshape(-1, dim), "radius": np.array(radius), "tree": tree}


def search_tree(q: np.ndarray, norm: np.ndarray, top: TopK, ids: np.ndarray, x: np.ndarray, center: np.ndarray, radius: np.ndarray, tree: np.ndarray) -> int:
    """Offer top all that could be among its k best; the number of inner products computed."""
    done = 0
    rows = np.arange(len(q))
    slack = 2 * UNIT
    bound = q @ center[0] + norm * radius[0]
    heap = [(-bound.max(), 0, rows, bound)]
    while heap:
        _, at, rows, bound = heapq.heappop(heap)
        alive = bound >= top.kth[rows] - slack
        if not alive.any():
            continue
        rows = rows[alive]
        lo, hi, left, right = tree[at]
        if left < 0:
            top.offer(rows, q[rows] @ x[lo:hi].T, ids[lo:hi])
            done += len(rows) * int(hi - lo)
            continue
        for child in (int(left), int(right)):
            b = q[rows] @ center[child] + norm[rows] * radius[child]
            alive = b >= top.kth[rows] - slack
            if alive.any():
                heapq.heappush(heap, (-b[alive].max(), child, rows[alive], b[alive]))
    return done


_KEYS = ("ids", "x", "center", "radius", "tree")


def exact_top_k(df: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, neighbor_id, rank, score: each query's k largest inner products with other rows.

    Queries are the rows for which the condition `queries` on the column id holds, by default all; all rows are searched.
    Scores have 9 decimals, and ties go to the lesser id. Rows of the
    same id aren't each other's neighbours; repeated rows are one. Fewer than k others give fewer
    rows. Ids of any type are kept (those that aren't integral as STRING). Which rows take part: see clean_vectors. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "balltree")
    ask = F.coalesce(queries, F.lit(False)) if queries is not None else F.lit(True)
    rows = scratch.save(clean_vectors(df, id_col, vector_col).distinct().withColumn("ask", ask))
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    sample = matrix(rows.orderBy(F.xxhash64("id", "v")).limit(ROUTING_SAMPLE if shards > 1 else 1).select("v").toArrow().column("v")) if n else np.zeros((0, 1))
    routing, _ = routing_tree(sample, 1, np.random.default_rng(SEED), leaves=min(shards, max(1, len(sample))))
    root = scratch.path
    built = build_shards(with_shards(rows, lambda x: routing.margins(x).argmax(axis=0), routing.leaves, shard_rows), root, build_tree)

    def search(place: int, lo: int, hi: int) -> tuple:
        shard = built[place][0]
        asks, *own = arrays.get(root, f"shard-{shard}", "asks", *_KEYS)
        at = np.asarray(asks[lo:hi])
        q, ids = np.asarray(own[1][at]), np.asarray(own[0][at])
        norm = np.sqrt((q * q).sum(axis=1))
        top = TopK(ids, k)
        search_tree(q, norm, top, *own)
        top.flush()
        others = sorted((-(q @ center + norm * radius).max(), o) for o, _, _, center, radius in built if o != shard)
        for bound, o in others:
            if -bound < top.kth.min() - 2 * UNIT:
                break  # no query's bound in this shard, nor in those after it, reaches any kth score
            search_tree(q, norm, top, *arrays.get(root, f"shard-{o}", *_KEYS))
            top.flush()
        row, near, rank, score = top.result()
        return ids[row], near, rank, score

    found = search_blocks(spark, built, search, rows.schema["id"].dataType.simpleString())
    return found.select(F.col("id").alias("vec_id"), F.col("neighbor").alias("neighbor_id"), "rank", "score")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("id") % QUERY_EVERY == 0)


OP10_SQL = f"""
SELECT vec_id, neighbor_id, rank::INTEGER AS rank, score FROM (
  SELECT vec_id, neighbor_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(ip * 1e9) DESC, neighbor_id) AS rank, round(ip * 1e9) / 1e9 AS score FROM (
    SELECT a.vec_id, b.vec_id AS neighbor_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS ip
    FROM embeddings a JOIN embeddings b ON a.vec_id % {QUERY_EVERY} = 0 AND a.vec_id <> b.vec_id))
WHERE rank <= {K}
"""
