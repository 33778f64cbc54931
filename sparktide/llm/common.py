"""What the operators share: safe column access, shared scratch tables, size-checked joins, components."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest estimated size of a table that is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Edges that one task joins by union-find; more are first contracted in rounds.
UNION_FIND_EDGES = 4_000_000

_INTEGRAL = ("tinyint", "smallint", "int", "bigint")
_local_scratch: list[str] = []


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names, found by exact spelling.

    Works where other columns differ from them by case only or are repeated; of repeated
    names the first counts. A missing column raises ValueError.
    """
    names = df.columns
    for c in columns.values():
        if c not in names:
            raise ValueError(f"column {c!r} is missing; there are {names}")
    by_place = df.toDF(*[f"__p{i}" for i in range(len(names))])
    return by_place.select(*[by_place[f"__p{names.index(c)}"].alias(n) for n, c in columns.items()])


def is_integral(df: DataFrame, column: str) -> bool:
    """Whether a column's type is one of the whole-number types."""
    return dict(df.dtypes)[column] in _INTEGRAL


def with_keys(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """All columns by place (__p0, ...), plus __id (BIGINT order of documents), __key (of the row) and __text.

    __id is the id, NULL ids last; an id that isn't integral is hashed. __key is a hash of id and
    text, so rows that agree in both are one document.
    """
    names = df.columns
    for c in (id_col, text_col):
        if c not in names:
            raise ValueError(f"column {c!r} is missing; there are {names}")
    d = df.toDF(*[f"__p{i}" for i in range(len(names))])
    i, t = F.col(f"__p{names.index(id_col)}"), F.col(f"__p{names.index(text_col)}")
    integral = df.dtypes[names.index(id_col)][1] in _INTEGRAL
    order = F.coalesce(i.cast("bigint") if integral else F.when(i.isNotNull(), F.xxhash64(i)), F.lit((1 << 63) - 1))
    text = t.cast("string")
    return d.select("*", order.alias("__id"), F.xxhash64(order, F.coalesce(text, F.lit("")), text.isNull()).alias("__key"), text.alias("__text")), names


def restore(df: DataFrame, names: list[str], added: list[str] = (), replaced: dict[str, str] | None = None) -> DataFrame:
    """Undo with_keys: the columns' names again, then `added`, which replace input columns of the same name in any case."""
    new = {a.lower() for a in added}
    replaced = replaced or {}
    kept = [F.col(replaced.get(n, f"__p{i}")).alias(n) for i, n in enumerate(names) if n.lower() not in new]
    return df.select(*kept, *[F.col(f"__o_{a}").alias(a) for a in added])


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, where it is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="sparktide-"))
        atexit.register(shutil.rmtree, _local_scratch[0], ignore_errors=True)
    return f"file://{_local_scratch[0]}"


class Scratch:
    """Tables of one run in the shared folder. save() cuts lineage; drop() deletes what was consumed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            self.delete(df.scratch_path)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """The saved table df with a broadcast hint if its measured size allows it, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component, for undirected edges a-b."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = len(a)
    for x, y in zip(inv[:n].tolist(), inv[n:].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[np.fromiter((find(x) for x in range(len(nodes))), dtype=np.int64, count=len(nodes))]


def _union_find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches if x.num_rows]
    if parts:
        nodes, roots = union_find(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        keep = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch, most: int = UNION_FIND_EDGES) -> DataFrame:
    """(u, v): each node but the least of its component, and that least node; edges has BIGINT u, v.

    Each task first replaces its edges by a spanning star with union-find. If that leaves more than
    `most` edges, rounds of large-star and small-star follow until nothing changes.
    """
    schema = "u bigint, v bigint"
    e = scratch.save(edges.select("u", "v").mapInArrow(_union_find_batches, schema))
    n = e.count()
    if n <= most:
        out = scratch.save(e.coalesce(1).mapInArrow(_union_find_batches, schema))
        scratch.drop(e)
        return out
    parts = max(2, math.ceil(n / most)) * 4

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        if large:
            both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        j = both.join(least, "u")
        if large:
            return j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    mark = None
    while True:
        new = scratch.save(star(star(e, True), False).repartition(parts, "u"))
        scratch.drop(e)
        e = new
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if now == mark:
            return e
        mark = now


def empty_like(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
