"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue for all trees.

Vectors are routed to shards by a tree built on a bounded sample, and each shard holds a forest. A
split is the hyperplane halfway the projections on the line through two random rows. A query first goes down to its own
leaf in every tree. Then one heap holds the branches of all trees that were not taken, ordered by how far they lie beyond
the hyperplanes on their path: that is a lower bound on the distance of everything below. The nearest branch is popped,
margins are computed at that node only, and a leaf's rows are ranked by exact distance. A branch is followed
only if it lies within `reach` times the current kth distance. reach = 1 would lose nothing; smaller ones save
visits, and each shard's is fitted: on a bounded sample of its rows, the number of trees and the reach that find the wanted share of
their true neighbours with fewest visits. So clustered vectors, whose neighbours share leaves, cost few leaves, and vectors without
structure as many as they need, of fewer trees. A block of queries goes through the heap together.
Shards are taken in the same way, by the margins of the routing tree.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .common import Scratch
from .vectors import QUERY_EVERY, TopK, build_shards, clean_vectors, matrix, search_blocks, with_shards

K = 10
TREES = 8
LEAF = 64
#: Share of the sampled rows' true neighbours that the fitted reach has to find.
RECALL = 0.95
#: Rows of a shard that its reach is fitted on.
FIT_ROWS = 256
SHARD_ROWS = 32_768
#: Rows that the routing tree and its reach are fitted on; every row is routed and indexed.
ROUTING_SAMPLE = 20_000
SEED = 3


class Tree:
    """Nodes of a random-projection tree: unit normal, offset and children; child ~i is leaf i."""

    def __init__(self, normal: np.ndarray, offset: np.ndarray, child: np.ndarray, leaves: int):
        self.normal, self.offset, self.child, self.leaves = normal, offset, child, leaves

    def margins(self, q: np.ndarray) -> np.ndarray:
        """The least signed margin on the path to each leaf (rows) for each query; used on bounded samples and for routing."""
        m = self.normal @ q.T - self.offset[:, None] if len(self.normal) else np.zeros((0, len(q)))
        out = np.full((self.leaves, len(q)), np.inf)
        reach: dict[int, np.ndarray] = {0: np.full(len(q), np.inf)}
        for i in range(len(self.normal)):  # parents come first
            p = reach.pop(i)
            for side, c in ((-m[i], self.child[i, 0]), (m[i], self.child[i, 1])):
                low = np.minimum(p, side)
                if c < 0:
                    out[~c] = low
                else:
                    reach[int(c)] = low
        return out


def build_tree(x: np.ndarray, leaf: int, rng: np.random.Generator, leaves: int | None = None) -> tuple[Tree, list[np.ndarray]]:
    """A tree over the rows of x down to `leaf` rows, or to `leaves` leaves; and the rows of each leaf."""
    normal, offset, child, rows = [], [], [], []

    def grow(idx: np.ndarray, want: int | None) -> int:
        if want == 1 or (want is None and len(idx) <= leaf) or len(idx) < 2:
            rows.append(idx)
            return ~(len(rows) - 1)
        a, b = x[rng.choice(idx, 2, replace=False)]
        n = a - b
        size = np.sqrt(n @ n)
        if size == 0:
            n = rng.standard_normal(x.shape[1])
            size = np.sqrt(n @ n)
        n = n / size
        p = x[idx] @ n
        order = np.argsort(p, kind="stable")
        half = len(idx) // 2 if want is None else max(1, len(idx) * (want // 2) // want)
        me = len(normal)
        normal.append(n)
        offset.append((p[order[half - 1]] + p[order[half]]) / 2)
        child.append([0, 0])
        child[me][0] = grow(idx[order[:half]], want and want // 2)
        child[me][1] = grow(idx[order[half:]], want and want - want // 2)
        return me

    grow(np.arange(len(x)), leaves)
    dim = x.shape[1]
    return Tree(np.array(normal).reshape(-1, dim), np.array(offset), np.array(child, dtype=np.int64).reshape(-1, 2), len(rows)), rows


def brute_neighbours(q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest rows of x to each query, whose own places are left out."""
    d = (x * x).sum(axis=1)[None, :] + (q * q).sum(axis=1)[:, None] - 2 * q @ x.T
    d[np.arange(len(q)), own] = np.inf
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    near = np.sqrt(np.maximum(np.take_along_axis(d, at, axis=1), 0))
    return at, near


def fit_reach(trees: list[tuple[Tree, list[np.ndarray]]], x: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> tuple[int, float]:
    """How many of the trees to search, and the reach with them: the share of the kth distance within which branches are followed.

    For each number of trees (1, 2, 4, ...) the least reach is taken at which sampled rows find the share
    `recall` of their neighbours; of these the one that visits fewest rows.
    """
    k = min(k, len(x) - 1)
    if k < 1:
        return 1, 1.0
    own = rng.choice(len(x), min(FIT_ROWS, len(x)), replace=False)
    q = x[own]
    at, near = brute_neighbours(q, own, x, k)
    kth = np.maximum(near.max(axis=1), 1e-300)
    beyond = np.full(at.shape, np.inf)
    best = (np.inf, 1, 1.0)
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    for n, (tree, rows) in enumerate(trees, start=1):
        leaf = np.empty(len(x), dtype=np.int64)
        for i, r in enumerate(rows):
            leaf[r] = i
        far = np.maximum(0, -tree.margins(q))
        seen.append((far / kth, np.array([len(r) for r in rows], dtype=np.float64)))
        beyond = np.minimum(beyond, far[leaf[at], np.arange(len(q))[:, None]])
        if n & (n - 1) and n != len(trees):
            continue
        reach = float(min(1.0, np.quantile(np.where(beyond > 0, beyond / kth[:, None], 0.0), recall, method="higher")))
        cost = sum(float((size[:, None] * (f <= reach)).sum()) for f, size in seen)
        if cost < best[0]:
            best = (cost, n, reach)
    return best[1:]


def build_forest(trees: int, leaf: int, k: int, recall: float):
    def build(ids: np.ndarray, x: np.ndarray) -> dict:
        rng = np.random.default_rng(SEED)
        parts: dict[str, list] = {n: [] for n in ("normal", "offset", "child", "nodes", "member", "ends")}
        grown = [build_tree(x, leaf, rng) for _ in range(trees)]
        use, reach = fit_reach(grown, x, k, recall, rng)
        for t, rows in grown[:use]:
            parts["normal"].append(t.normal)
            parts["offset"].append(t.offset)
            parts["child"].append(t.child)
            parts["nodes"].append([[len(t.normal), t.leaves]])
            parts["member"].append(np.concatenate(rows))
            parts["ends"].append([len(r) for r in rows])
        out = {n: np.concatenate(v) for n, v in parts.items()}
        return out | {"ids": ids, "x": x, "ends": np.cumsum(out["ends"]), "reach": np.array([reach])}

    return build


_KEYS = ("normal", "offset", "child", "nodes", "member", "ends", "reach", "ids", "x")


def search_forest(q: np.ndarray, rows: np.ndarray, top: TopK, normal, offset, child, nodes, member, ends, reach, ids, x) -> int:
    """Offer top the leaf candidates of the queries in rows; the number of distances computed."""
    normal, offset, child, x, ids, member = map(np.asarray, (normal, offset, child, x, ids, member))
    reach, begin = float(reach[0]), np.append(0, ends[:-1])
    size, qsize = (x * x).sum(axis=1), (q * q).sum(axis=1)
    done = 0

    def leaf(at: int, who: np.ndarray) -> None:
        nonlocal done
        m = member[begin[at] : ends[at]]
        top.offer(who, 2 * (q[who] @ x[m].T) - size[m] - qsize[who][:, None], ids[m])
        done += len(who) * len(m)

    # each query's own leaf in every tree; what lies beyond a hyperplane waits: node, queries and how far beyond
    left: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    first_node = first_leaf = 0
    for n, leaves in np.asarray(nodes).tolist():
        down: list[tuple[int, np.ndarray]] = [(0 if n else ~0, rows)]
        while down:
            at, who = down.pop()
            if at < 0:
                leaf(first_leaf + ~at, who)
                continue
            m = q[who] @ normal[first_node + at] - offset[first_node + at]
            for side, c in ((m <= 0, int(child[first_node + at, 0])), (m > 0, int(child[first_node + at, 1]))):
                if side.any():
                    down.append((c, who[side]))
                if not side.all():
                    left.append((first_node, first_leaf, c, who[~side], np.abs(m[~side])))
        first_node, first_leaf = first_node + n, first_leaf + leaves
    top.flush()

    def within(who: np.ndarray, far: np.ndarray) -> np.ndarray:
        return far <= reach * np.sqrt(np.maximum(-top.kth[who], 0.0)) + 1e-9

    heap: list[tuple] = []
    # what waits for a node is taken together when the nearest of it is popped
    waiting: dict[tuple[int, int, int], list] = {}

    def push(node: tuple[int, int, int], who: np.ndarray, far: np.ndarray) -> None:
        ok = within(who, far)
        if ok.any():
            waiting.setdefault(node, []).append((who[ok], far[ok]))
            heapq.heappush(heap, (float(far[ok].min()), node))

    for fn, fl, c, who, far in left:
        push((fn, fl, c), who, far)
    while heap:
        _, node = heapq.heappop(heap)
        parts = waiting.pop(node, None)
        if parts is None:
            continue
        who, far = (np.concatenate(x) for x in zip(*parts, strict=True))
        ok = within(who, far)
        who, far = who[ok], far[ok]
        if not len(who):
            continue
        fn, fl, at = node
        if at < 0:
            leaf(fl + ~at, who)
            continue
        m = q[who] @ normal[fn + at] - offset[fn + at]
        push((fn, fl, int(child[fn + at, 0])), who, np.maximum(far, m))
        push((fn, fl, int(child[fn + at, 1])), who, np.maximum(far, -m))
    top.flush()
    return done


def nearest_neighbours(df: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, neighbor_id, rank, distance: about the k nearest other rows of each query, by Euclidean distance.

    Queries are the rows for which the condition `queries` on the column id holds, by default all; neighbours are sought among all rows.
    Ranks and distances (6 decimals) are exact among the candidates; ties go to the lesser id. Rows of the same id
    aren't each other's neighbours; repeated rows are one. Fewer than k others give fewer rows.
    Ids of any type are kept (those that aren't integral as STRING). Which rows take part: see clean_vectors. An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "rpforest")
    ask = F.coalesce(queries, F.lit(False)) if queries is not None else F.lit(True)
    rows = scratch.save(clean_vectors(df, id_col, vector_col).distinct().withColumn("ask", ask))
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    sample = matrix(rows.orderBy(F.xxhash64("id", "v")).limit(ROUTING_SAMPLE if shards > 1 else 1).select("v").toArrow().column("v")) if n else np.zeros((0, 1))
    rng = np.random.default_rng(SEED)
    routing, members = build_tree(sample, 1, rng, leaves=min(shards, max(1, len(sample))))
    _, enter = fit_reach([(routing, members)], sample, k, (1 + recall) / 2, rng)
    root = scratch.path
    built = build_shards(with_shards(rows, lambda x: routing.margins(x).argmax(axis=0), routing.leaves, shard_rows), root, build_forest(trees, leaf, k, recall))

    def search(place: int, lo: int, hi: int) -> tuple:
        shard, home, _, _, _ = built[place]
        asks, *own = arrays.get(root, f"shard-{shard}", "asks", *_KEYS)
        at = np.asarray(asks[lo:hi])
        q, ids = np.asarray(own[-1][at]), np.asarray(own[-2][at])
        top = TopK(ids, k)
        search_forest(q, np.arange(len(q)), top, *own)
        far = np.maximum(0, -routing.margins(q))
        for o, leaf_, _, _, _ in sorted((b for b in built if b[0] != shard), key=lambda b: (far[b[1]].min(), b[0])):
            near = np.flatnonzero(far[leaf_] <= enter * np.sqrt(np.maximum(-top.kth, 0.0)) + 1e-9)
            if len(near):
                search_forest(q, near, top, *arrays.get(root, f"shard-{o}", *_KEYS))
        row, found, rank, score = top.result()
        return ids[row], found, rank, score

    found = search_blocks(spark, built, search, rows.schema["id"].dataType.simpleString())
    return found.select(F.col("id").alias("vec_id"), F.col("neighbor").alias("neighbor_id"), "rank", F.round(F.sqrt(F.greatest(-F.col("score"), F.lit(0.0))), 6).alias("distance"))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("id") % QUERY_EVERY == 0)
