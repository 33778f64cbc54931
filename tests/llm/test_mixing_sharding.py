import hashlib
import math
from collections import Counter
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from sparktide.llm import mixing, sharding

from .fixtures import SCHEMA, corpus


def unit(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def wanted_counts(rows, weights=None, budget=None):
    """Copies of each row by the definition."""
    tokens = Counter()
    for r in rows:
        tokens[r[3]] += len((r[1] or "").split())
    share = {s: (weights.get(s, 0) if weights else t**mixing.ALPHA) if t else 0 for s, t in tokens.items()}
    total = sum(share.values())
    rate = {s: (budget or sum(tokens.values())) * share[s] / total / t if t else 0 for s, t in tokens.items()}
    out = Counter()
    for r in rows:
        key = r[0] if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest()
        u, n, p, c = unit(mixing.SEED, key), 0, math.exp(-rate[r[3]]), 0.0
        while True:
            c += p
            if u < c or n > 200:
                break
            n += 1
            p *= rate[r[3]] / n
        out[r] += n
    return Counter({k: v for k, v in out.items() if v})


@pytest.mark.parametrize("weights", [None, {"src0": 3.0, "src1": 1.0, None: 1.0}])
def test_copies_equal_the_definition(spark, weights):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(docs, weights, alpha=mixing.ALPHA)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == wanted_counts(rows, weights)


def test_clashing_columns_and_copies(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).selectExpr("*", "9 AS COPY", "'a' AS rate_source", "8 AS cdf", "7 AS __x")
    got = mixing.mix_sources(docs, copy_col="copy")
    assert got.columns == [*[c for c in docs.columns if c != "COPY"], "copy"]
    rows = got.collect()
    assert min(r["copy"] for r in rows) == 1


def test_large_sample_reaches_the_target(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "repeat('x', 50) AS text", "'en' AS lang", "IF(id % 10 = 0, 'a', 'b') AS source", "50L AS n_chars")
    n = Counter(r.source for r in mixing.mix_sources(docs, {"a": 1, "b": 1}).select("source").collect())
    assert abs(n["a"] / sum(n.values()) - 0.5) < 0.02 and abs(sum(n.values()) / 30_000 - 1) < 0.03


def exact_quantile(rate, u):
    with localcontext() as c:
        c.prec = 60
        rate, u = Decimal(rate), Decimal(u)
        n, p = 0, (-rate).exp()
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        return n


@pytest.mark.parametrize("rate", [64.5, 1000.25, 20_000.0])
def test_quantiles_at_large_rates_are_exact(rate):
    first, cdf = mixing.poisson_table(rate)
    assert cdf[-1] == 1.0 and 0 < cdf[0] < 2**-52
    for u in (2**-40, 0.001, 0.25, 0.5, 0.9, 0.999, 1 - 2**-40):
        assert first + sum(c <= u for c in cdf) == exact_quantile(rate, u)


def test_small_sources_beside_a_very_large_one(spark):
    big = spark.range(200).selectExpr("id AS doc_id", "repeat('x ', 50000) AS text", "'hot' AS source")
    tiny = spark.createDataFrame([(1000, "ten words " * 5, "small"), (1001, "a b c d e", None), (1002, "", None)], "doc_id bigint, text string, source string")
    t = {"hot": 10_000_000, "small": 10, None: 5}
    rate = {s: sum(t.values()) * n**mixing.ALPHA / sum(v**mixing.ALPHA for v in t.values()) / n for s, n in t.items()}
    assert min(rate["small"], rate[None]) > 900
    got = Counter(r.doc_id for r in mixing.mix_sources(big.unionByName(tiny)).select("doc_id").collect())
    place = {1000: "small", 1001: None, 1002: None} | dict.fromkeys(range(200), "hot")
    want = {i: exact_quantile(rate[s], unit(mixing.SEED, i)) for i, s in place.items()}
    assert got == {i: n for i, n in want.items() if n}


def test_empty_tables_and_refusals(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_sources(docs).collect() == []
    assert sharding.assign_shards(docs).collect() == []
    full = spark.createDataFrame(corpus(), SCHEMA)
    with pytest.raises(ValueError):
        mixing.mix_sources(full.withColumn("source", F.lit(1)))
    with pytest.raises(ValueError):
        sharding.assign_shards(full, {"a": {"b": {"c": -1}}})


def wanted_place(key, topology=sharding.TOPOLOGY, seed=sharding.SEED):
    path, node, out = "", topology, []
    for _ in range(3):
        name = min((-math.log(unit(seed, key, f"{path}/{n}") + 2.0**-54) / sharding.weight(c), n) for n, c in node.items() if sharding.weight(c) > 0)[1]
        out.append(name)
        path, node = f"{path}/{name}", node[name]
    return tuple(out)


def test_places_equal_the_definition(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS RACK", "2 AS __region")
    got = sharding.assign_shards(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "__region", "region", "rack", "shard"]
    for r in got.collect():
        key = r.doc_id if r.doc_id is not None else hashlib.md5((r.text or "").encode()).hexdigest()
        assert (r.region, r.rack, r.shard) == wanted_place(key)
    assert got.count() == sharding.lay_out(got).count() == len(rows)


def test_movement_stays_in_the_subtree_and_follows_weights(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    before = {r[0]: tuple(r[2:]) for r in sharding.assign_shards(docs).collect()}
    total = sharding.weight(sharding.TOPOLOGY)
    n = Counter(p[0] for p in before.values())
    for region, racks in sharding.TOPOLOGY.items():
        assert abs(n[region] / 20_000 - sharding.weight(racks) / total) < 0.015
    # the same weight of the rack, other weights below: only keys of that rack move
    changed = {**sharding.TOPOLOGY, "west": {**sharding.TOPOLOGY["west"], "w2": {"s0": 3, "s1": 9}}}
    after = {r[0]: tuple(r[2:]) for r in sharding.assign_shards(docs, changed).collect()}
    moved = {k for k in before if before[k] != after[k]}
    assert moved and all(before[k][:2] == ("west", "w2") == after[k][:2] and after[k][2] == "s1" for k in moved)
    # a heavier shard takes keys; none moves between other places
    grown = {**sharding.TOPOLOGY, "west": {**sharding.TOPOLOGY["west"], "w2": {"s0": 6, "s1": 12}}}
    after = {r[0]: tuple(r[2:]) for r in sharding.assign_shards(docs, grown).collect()}
    for k in before:
        if before[k] != after[k]:
            same = next(i for i in range(3) if before[k][i] != after[k][i])
            assert after[k][: same + 1] == ("west", "w2", "s1")[: same + 1]
