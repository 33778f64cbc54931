"""What both vector searches share: clean vectors, shards on disk, blocks of queries, and exact top-k lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import is_integral, pick

BLOCK = 512
#: Scores are compared with 9 decimals, so that equal vectors tie and ties go by id.
SCALE = 1e9
UNIT = 1e-9
#: Every row whose id is divisible by this is a query of the registered searches.
QUERY_EVERY = 20


def _finite(v: Column) -> Column:
    inf = float("inf")
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))


def _parts(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    d = pick(df, id=id_col, v=vector_col)
    kind = "bigint" if is_integral(d, "id") else "string"
    d = d.select(F.col("id").cast(kind).alias("id"), F.col("v").cast("array<double>").alias("v"))
    reason = F.when(F.col("id").isNull(), "no id").when(F.col("v").isNull() | (F.size("v") == 0), "no vector").when(~_finite(F.col("v")), "not finite")
    return d.withColumn("reason", reason)


def vector_length(df: DataFrame) -> int:
    """The most frequent length of the vectors that are whole (of equally frequent ones the largest); 0 if there are none."""
    sizes = df.where("reason IS NULL").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return sizes[0] if sizes else 0


def clean_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v ARRAY<DOUBLE>) of the rows that take part; ids are BIGINT or, if they aren't integral, STRING.

    Left out: rows without an id or vector, those whose vector holds NULL, NaN or infinity, and those
    whose length isn't the most frequent one (of equally frequent ones the largest). left_out counts them.
    """
    d = _parts(df, id_col, vector_col)
    return d.where(F.col("reason").isNull() & (F.size("v") == vector_length(d))).select("id", "v")


def left_out(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(reason, rows): how many rows clean_vectors leaves out, and why."""
    d = _parts(df, id_col, vector_col)
    return d.select(F.coalesce("reason", F.when(F.size("v") != vector_length(d), "another length")).alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("rows"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as rows of a matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(c.flatten(), dtype=np.float64)
    return flat.reshape(len(c), -1)


def id_array(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as an array that sorts and compares: 64-bit integers or strings of one width."""
    kind = column.type
    return np.array(column.to_pylist(), dtype=str) if pa.types.is_string(kind) or pa.types.is_large_string(kind) else np.asarray(column)


class TopK:
    """The k best (score, then least id) of each of n queries; kth is the current kth score of each."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k, n = own, k, len(own)
        self.kth = np.full(n, -np.inf)
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), own[:0]
        self.wait: list[tuple] = []
        self.waiting = 0

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (rows x ids) of some queries; a query's own id is left out."""
        s = np.rint(scores * SCALE) / SCALE
        r, c = np.nonzero(s >= self.kth[rows][:, None])
        keep = ids[c] != self.own[rows[r]]
        r, c = r[keep], c[keep]
        self.wait.append((rows[r], s[r, c], ids[c]))
        self.waiting += len(r)
        if self.waiting > 4 * len(self.own) * self.k:
            self.flush()

    def flush(self) -> None:
        if not self.wait:
            return
        row, score, i = (np.concatenate([x, *(w[j] for w in self.wait)]) for j, x in enumerate((self.row, self.score, self.id)))
        order = np.lexsort((i, -score, row))
        row, score, i = row[order], score[order], i[order]
        # the same vector reached twice has the same score, so it lies next to itself
        new = np.append(True, (row[1:] != row[:-1]) | (i[1:] != i[:-1]) | (score[1:] != score[:-1])) if len(row) else np.zeros(0, bool)
        row, score, i = row[new], score[new], i[new]
        first = np.searchsorted(row, row)
        rank = np.arange(len(row)) - first
        keep = rank < self.k
        self.row, self.score, self.id = row[keep], score[keep], i[keep]
        last = rank == self.k - 1
        self.kth[row[last]] = score[last]
        self.wait, self.waiting = [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query number, neighbour, rank from 1, score."""
        self.flush()
        return self.row, self.id, np.arange(len(self.row)) - np.searchsorted(self.row, self.row) + 1, self.score


def with_shards(rows: DataFrame, leaf_of: Callable[[np.ndarray], np.ndarray], leaves: int, shard_rows: int) -> DataFrame:
    """Rows (id, v, ask) with the leaf of a routing tree, and shard: leaves of more than shard_rows rows are cut by hash.

    So neither a bounded routing sample nor equal vectors, which no tree can part, make a shard outgrow a task.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaf_of(matrix(batch.column("v"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), *(batch.column(c) for c in ("id", "v", "ask"))], names=["leaf", "id", "v", "ask"])

    routed = rows.mapInArrow(run, f"leaf bigint, id {kind}, v array<double>, ask boolean")
    counts = {r.leaf: r.n for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf
    pieces = [max(1, -(-counts.get(i, 0) // shard_rows)) for i in range(leaves)]
    before = np.cumsum([0, *pieces[:-1]]).tolist()
    if max(pieces) == 1:
        return routed.withColumn("shard", F.col("leaf"))
    at = (F.col("leaf") + 1).cast("int")
    cut = F.pmod(F.xxhash64("id", "v"), F.element_at(F.lit(pieces), at).cast("bigint"))
    return routed.withColumn("shard", F.element_at(F.lit(before), at).cast("bigint") + cut)


def build_shards(rows: DataFrame, root: str, build: Callable[[np.ndarray, np.ndarray], dict]) -> list[tuple[int, int, int, np.ndarray, float]]:
    """Write build(ids, matrix) of each shard of (shard, leaf, id, v, ask) to the shared folder.

    Adds `asks`, the places of the rows that are queries, in the order of the arrays, and gives of each shard its
    number, leaf, number of queries, and a ball that holds its vectors.
    """

    def one(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        ids, x = id_array(t.column("id")), matrix(t.column("v"))
        order = np.lexsort((*x.T[:3][::-1], ids))
        made = build(ids[order], x[order])
        asking = np.isin(made["ids"], ids[np.asarray(t.column("ask"))])
        asks = np.flatnonzero(asking)
        arrays.put(root, f"shard-{shard}", **made, asks=asks)
        center = x.mean(axis=0)
        radius = float(np.sqrt(((x - center) ** 2).sum(axis=1)).max() * (1 + 1e-12) + 1e-12)
        return pa.table({"shard": [shard], "leaf": [t.column("leaf")[0].as_py()], "n": pa.array([len(asks)], pa.int64()), "center": pa.array([center.tolist()], pa.list_(pa.float64())), "radius": [radius]})

    made = rows.groupBy("shard").applyInArrow(one, "shard bigint, leaf bigint, n bigint, center array<double>, radius double").collect()  # one row a shard
    return sorted(((r.shard, r.leaf, r.n, np.array(r.center), r.radius) for r in made), key=lambda r: r[0])


def search_blocks(spark, built: list[tuple], search: Callable[[int, int, int], tuple], id_type: str, block: int = BLOCK) -> DataFrame:
    """Rows (id, neighbor, rank, score) of search(place in built, lo, hi) for each block of each shard's queries."""
    blocks = [(p, lo, min(lo + block, b[2])) for p, b in enumerate(built) for lo in range(0, b[2], block)]
    schema = f"id {id_type}, neighbor {id_type}, rank int, score double"
    if not blocks:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                ids, near, rank, score = search(*shared.value[b])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near), pa.array(rank.astype(np.int32)), pa.array(score)], names=["id", "neighbor", "rank", "score"])

    return spark.range(0, len(blocks), 1, min(len(blocks), 8192)).mapInArrow(run, schema)
