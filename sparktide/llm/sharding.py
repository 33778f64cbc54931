"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws -ln(u) / weight with u hashed from (key, child path), and the least draw
wins, so a child gets keys in proportion to its weight. A draw depends on that child alone: a changed
weight moves keys only to or from that child, and within other subtrees nothing moves. All draws
are built-in expressions of one row, so assignment needs no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import unit_hash

#: region -> rack -> shard -> weight; an inner node weighs as much as its shards.
Topology = dict[str, dict[str, dict[str, float]]]

TOPOLOGY: Topology = {
    "east": {"e1": {"s0": 4, "s1": 4, "s2": 4, "s3": 4}, "e2": {"s0": 4, "s1": 4, "s2": 8}, "e3": {"s0": 8, "s1": 8}},
    "west": {"w1": {"s0": 4, "s1": 4, "s2": 4}, "w2": {"s0": 6, "s1": 6}},
    "north": {"n1": {"s0": 2, "s1": 2, "s2": 2, "s3": 2}, "n2": {"s0": 8}},
}
LEVELS = ("region", "rack", "shard")
SEED = 5


def weight(node: dict | float) -> float:
    """The node's weight: its own, or the sum of its children's."""
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def check_topology(topology: Topology) -> None:
    """ValueError unless all weights are finite, none is negative and some is positive."""
    def leaves(n):
        return [x for c in n.values() for x in leaves(c)] if isinstance(n, dict) else [n]

    found = leaves(topology)
    if any(not math.isfinite(w) or w < 0 for w in found) or not any(w > 0 for w in found):
        raise ValueError("weights must be finite and not negative, and some positive")


def choose(key: Column, children: dict, path: str, seed: int) -> Column:
    """Name of the child that wins the weighted draw; of equal draws the first name."""
    draws = []
    for name in sorted(children):
        w = weight(children[name])
        if w > 0:
            u = unit_hash(F.lit(str(seed)), key, F.lit(f"{path}/{name}"))
            # half a step above zero, so that the logarithm is finite
            draws.append(F.struct((-F.log(u + F.lit(2.0**-54)) / F.lit(w)).alias("draw"), F.lit(name).alias("name")))
    return F.array_min(F.array(*draws))["name"]


def assign(key: Column, topology: Topology, seed: int = SEED) -> list[Column]:
    """Region, rack and shard of a key column (STRING, not NULL)."""
    region = choose(key, topology, "", seed)
    rack = F.lit(None).cast("string")
    for r in sorted(topology):
        if weight(topology[r]) > 0:
            rack = F.when(F.col("__region") == r, choose(key, topology[r], f"/{r}", seed)).otherwise(rack)
    shard = F.lit(None).cast("string")
    for r in sorted(topology):
        for k in sorted(topology[r]):
            if weight(topology[r][k]) > 0:
                hit = (F.col("__region") == r) & (F.col("__rack") == k)
                shard = F.when(hit, choose(key, topology[r][k], f"/{r}/{k}", seed)).otherwise(shard)
    return [region, rack, shard]


def assign_shards(docs: DataFrame, topology: Topology | None = None, id_col: str = "doc_id", text_col: str | None = "text", seed: int = SEED) -> DataFrame:
    """docs with STRING columns region, rack and shard, which replace columns of those names in any case.

    The key is the id. A NULL id is replaced by the text's MD5, so such rows spread too; NULL and empty
    texts without an id share one key. Rows that agree in id go to one shard. An empty table
    gives an empty one. Weights of 0 take a node out.
    """
    topology = topology or TOPOLOGY
    check_topology(topology)
    names = docs.columns
    if id_col not in names:
        raise ValueError(f"column {id_col!r} is missing; there are {names}")
    d = docs.toDF(*[f"__p{i}" for i in range(len(names))])
    key = F.col(f"__p{names.index(id_col)}").cast("string")
    if text_col in names:
        key = F.coalesce(key, F.md5(F.coalesce(F.col(f"__p{names.index(text_col)}").cast("string"), F.lit("")).cast("binary")))
    region, rack, shard = assign(F.coalesce(key, F.lit("")), topology, seed)
    d = d.withColumn("__region", region).withColumn("__rack", rack).withColumn("__shard", shard)
    keep = [F.col(f"__p{i}").alias(c) for i, c in enumerate(names) if c.lower() not in LEVELS]
    return d.select(*keep, *[F.col(f"__{x}").alias(x) for x in LEVELS])


def lay_out(sharded: DataFrame) -> DataFrame:
    """The rows moved so that each task's output belongs to one shard, or to few small ones.

    Adaptive execution cuts what is large by size (spark.sql.adaptive.advisoryPartitionSizeInBytes), so tasks stay the same
    at any table size, even where one id makes up most of a shard; small shards are put together.
    """
    return sharded.hint("rebalance", *LEVELS)


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lay_out(assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def oracle(topology: Topology, seed: int = SEED) -> str:
    """DuckDB SQL for assign_shards over documents."""
    rows = []
    for r, racks in topology.items():
        rows.append((1, "", r, weight(racks)))
        for k, shards in racks.items():
            rows.append((2, f"/{r}", k, weight(shards)))
            rows += [(3, f"/{r}/{k}", s, weight(w)) for s, w in shards.items()]
    values = ", ".join(f"({lv}, '{p}', '{n}', {w!r}::DOUBLE)" for lv, p, n, w in rows if w > 0)

    def level(lv: int, name: str, path: str, source: str) -> str:
        return f"""(SELECT * EXCLUDE (rn, draw, parent, lv, w, name), name AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY draw, name) AS rn FROM
        (SELECT d.*, t.*, -ln(('0x' || substr(md5('{seed}:' || doc_id || ':' || parent || '/' || name), 1, 13))::BIGINT::DOUBLE / {1 << 52} + pow(2::DOUBLE, -54)) / w AS draw
        FROM {source} d JOIN tree t ON t.lv = {lv} AND t.parent = {path})) WHERE rn = 1)"""

    return f"""WITH tree(lv, parent, name, w) AS (VALUES {values}),
    a AS {level(1, "region", "''", "documents")},
    b AS {level(2, "rack", "'/' || d.region", "a")}
    SELECT * FROM {level(3, "shard", "'/' || d.region || '/' || d.rack", "b")}"""


OP5_SQL = oracle(TOPOLOGY)
