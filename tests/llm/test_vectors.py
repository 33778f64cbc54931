import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparktide.llm import balltree, rpforest, vectors
from sparktide.llm.vectors import TopK

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(ids, x, k, score):
    out = {}
    for i in range(len(ids)):
        s = np.rint(score(x[i], x) * 1e9) / 1e9
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-s[j], ids[j]))[:k]
        out[ids[i]] = [(ids[j], s[j]) for j in order]
    return out


def rows(n=300, dim=12, seed=0, dup=True):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[: n // 3] *= 0.1
    x[: n // 3] += rng.standard_normal(dim).astype(np.float32) * 3
    if dup:
        x[5:25] = x[4]  # ties
    return x


def test_exact_top_k_equals_brute_force_over_shards(spark):
    x = rows()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    df = df.unionByName(df.limit(3))  # repeated rows
    want = brute(list(range(len(x))), x.astype(np.float64), 10, lambda q, m: m @ q)
    for shard_rows in (1000, 64):
        got = {}
        for r in balltree.exact_top_k(df, shard_rows=shard_rows).orderBy("vec_id", "rank").collect():
            got.setdefault(r.vec_id, []).append((r.neighbor_id, r.score))
        assert got == want


def test_bounds_prune_clustered_vectors():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((200, 8)) * 0.01 + c * 5 for c in np.eye(8)])
    tree = balltree.build_tree(np.arange(len(x)), x, 32)
    from sparktide.llm.vectors import TopK

    top = TopK(tree["ids"][:50], 5)
    q = tree["x"][:50]
    done = balltree.search_tree(q, np.sqrt((q * q).sum(axis=1)), top, *(tree[k] for k in balltree._KEYS))
    assert done < 0.3 * 50 * len(x)


@pytest.mark.parametrize("shard_rows", [5000, 90])
def test_forest_recall(spark, sf, shard_rows):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    t = df.toPandas()
    x = np.stack(t["embedding"]).astype(np.float64)
    ids = t["vec_id"].tolist()
    want = brute(ids, x, 10, lambda q, m: -((m - q) ** 2).sum(axis=1))
    got = {}
    for r in rpforest.nearest_neighbours(df, shard_rows=shard_rows).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbor_id, r.distance))
    assert set(got) == set(ids) and all(len(v) == 10 for v in got.values())
    hits = [len({n for _, n, _ in got[i]} & {n for n, _ in want[i]}) for i in ids]
    assert np.mean(hits) / 10 >= 0.9
    at = {i: n for n, i in enumerate(ids)}
    for i in ids[:20]:
        for _, n, d in got[i]:
            assert abs(d - np.linalg.norm(x[at[i]] - x[at[n]])) < 1e-5
        assert [d for *_, d in sorted(got[i])] == sorted(d for *_, d in got[i])


@pytest.mark.parametrize("fn", [balltree.exact_top_k, rpforest.nearest_neighbours])
def test_odd_rows_are_left_out(spark, fn):
    bad = [(50, None, 0), (51, [], 0), (52, [1.0, None, 2.0], 0), (53, [float("nan"), 1.0, 2.0], 0), (54, [1.0, 2.0], 0), (None, [1.0, 2.0, 3.0], 0)]
    good = [(i, [float(i), 1.0, 0.0], 0) for i in range(6)] + [(7, [0.0, 0.0, 0.0], 0), (8, [0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(bad + good, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS shard", "4 AS VEC_ID")
    got = fn(df, k=20).collect()
    assert {r.vec_id for r in got} == {g[0] for g in good}
    assert len(got) == 8 * 7
    assert fn(spark.createDataFrame([], SCHEMA)).collect() == []
    assert fn(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)).collect() == []


def recall_of(spark, ids, x, k=10, **params):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in rpforest.nearest_neighbours(df, k=k, queries=F.col("id") % 20 == 0, **params).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbor_id)
    asked = [i for i, v in enumerate(ids) if v % 20 == 0]
    assert set(got) == {int(ids[i]) for i in asked}
    near, _ = rpforest.brute_neighbours(x[asked], np.array(asked), x, k)
    return np.mean([len(got[int(ids[i])] & set(ids[n].tolist())) / k for i, n in zip(asked, near, strict=True)])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_forest_recall_of_the_query_set(spark, size):
    t = pq.read_table(f"/root/testdata/{size}/embeddings.parquet").to_pandas()
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"]).astype(np.float64)
    assert recall_of(spark, ids, x) >= 0.9
    if size == "sf0.1":
        assert recall_of(spark, ids, x, shard_rows=300) >= 0.9


def test_forest_visits_few_rows_of_clustered_vectors():
    rng = np.random.default_rng(0)
    c = rng.standard_normal((100, 32))
    x = c[rng.integers(0, 100, 8000)] + 0.2 * rng.standard_normal((8000, 32))
    d = rpforest.build_forest(8, 64, 10, rpforest.RECALL)(np.arange(len(x)), x)
    at = np.arange(0, len(x), 20)
    top = TopK(at, 10)
    done = rpforest.search_forest(x[at], np.arange(len(at)), top, *(d[k] for k in rpforest._KEYS))
    row, found, _, _ = top.result()
    near, _ = rpforest.brute_neighbours(x[at], at, x, 10)
    assert np.mean([len(set(found[row == j]) & set(near[j])) / 10 for j in range(len(at))]) >= 0.9
    assert done < 0.15 * len(at) * len(x)


def test_equal_vectors_do_not_fill_one_shard(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), -1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    clean = vectors.clean_vectors(df, "vec_id", "embedding").withColumn("ask", F.lit(True))
    tree, _ = rpforest.build_tree(np.array([r[1] for r in rows]), 1, np.random.default_rng(1), leaves=6)
    sizes = [r[1] for r in vectors.with_shards(clean, lambda x: tree.margins(x).argmax(axis=0), tree.leaves, 100).groupBy("shard").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 200
    got = rpforest.nearest_neighbours(df, k=3, shard_rows=100).where("vec_id < 300").collect()
    assert len(got) == 900 and all(r.distance == 0 and r.neighbor_id <= 3 for r in got)


def test_string_ids_and_left_out_rows(spark):
    rows = [("b", [0.0, 1.0]), ("a", [0.0, 1.0]), ("c", [0.1, 1.0]), (None, [1.0, 1.0]), ("d", None), ("e", [1.0, float("nan")]), ("f", [1.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    near = {(r.vec_id, r.rank): r.neighbor_id for r in rpforest.nearest_neighbours(df, k=1).collect()}
    assert near == {("a", 1): "b", ("b", 1): "a", ("c", 1): "a"}
    top = {(r.vec_id, r.rank): r.neighbor_id for r in balltree.exact_top_k(df, k=1).collect()}
    assert top == {("a", 1): "b", ("b", 1): "a", ("c", 1): "a"}
    assert {tuple(r) for r in vectors.left_out(df).collect()} == {("no id", 1), ("no vector", 1), ("not finite", 1), ("another length", 1)}
