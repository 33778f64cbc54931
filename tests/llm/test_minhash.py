import random

import numpy as np
import pytest

from sparktide.llm import minhash
from sparktide.llm.common import Scratch, components, union_find
from sparktide.llm.textkernel import U64, Words, mix64

from .fixtures import SCHEMA, components as joined
from .fixtures import corpus, invented, near_groups, shingle_set


def sequential(h, m):
    """Slot by slot in the order of the elements, as the method is usually written."""
    sig = np.full(m, 0xFFFFFFFF, dtype=np.uint32)
    for e in h:
        p = list(range(m))
        for j in range(m):
            x = int(mix64(np.array([(int(e) + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], dtype=U64))[0])
            k = j + ((x & 0xFFFFFFFF) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            sig[p[j]] = min(sig[p[j]], (x >> 40) | j << 24)
    return sig


def test_level_order_gives_the_sequential_signature():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 25, dtype=np.uint64)
    got = minhash.superminhash(h, np.array([0, 20, 20, 25]), 12)
    assert (got[0] == sequential(h[:20], 12)).all()
    assert (got[1] == 0xFFFFFFFF).all()
    assert (got[2] == sequential(h[20:], 12)).all()


def test_estimate_has_less_variance_than_independent_hashes():
    rng = np.random.default_rng(1)
    est = []
    for _ in range(150):
        u = rng.integers(0, 2**63, 45, dtype=np.uint64)
        s = minhash.superminhash(np.concatenate([u[:30], u[15:]]), np.array([0, 30, 60]))
        est.append((s[0] == s[1]).mean())
    assert abs(np.mean(est) - 1 / 3) < 0.01
    assert np.std(est) < 0.9 * (1 / 3 * 2 / 3 / minhash.SLOTS) ** 0.5


def test_spanning_pairs_find_every_component():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 60_000, (4, 160)).astype(np.uint16)
    sig = np.concatenate([base, base, base])
    sig[5, :30] += 1
    pairs = minhash.spanning_pairs(sig, 0.5)
    assert len(pairs) == 8 and all(a % 4 == b % 4 for a, b in pairs)


def test_groups_equal_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = minhash.near_duplicates(docs).collect()
    distinct = sorted(set(r[:2] for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    root = near_groups([r[1] for r in distinct])
    want = {}
    for i, r in root.items():
        want.setdefault(r, []).append(distinct[i][0])
    want = sorted(sorted(map(str, g)) for g in want.values() if len(g) > 1)
    groups = {}
    for r in got:
        groups.setdefault((r.group_id, r.group_size), []).append(r.doc_id)
        assert r.keep == (r.doc_id == r.group_id)
    assert sorted(sorted(map(str, g)) for g in groups.values()) == want
    assert all(len(g) == k[1] for k, g in groups.items())


def template_family(n=150, planted=30):
    """Texts that share a passage, J of about 0.4; the first `planted` pairs share more, J of 0.5 to 0.6."""
    rng = random.Random(5)
    passage = invented(rng, 80, 10_000)
    own = [invented(rng, 56, 10_000).split() for _ in range(n)]
    for i in range(planted):
        own[n - 1 - i][: 18 + i % 6] = own[i][: 18 + i % 6]
    return [f"{passage} {' '.join(w)}" for w in own]


@pytest.mark.parametrize(("tile", "part"), [(64, minhash.PART), (7, 20)])
def test_pairs_within_a_template_family_are_found(spark, monkeypatch, tile, part):
    monkeypatch.setattr(minhash, "TILE", tile, raising=False)
    texts = template_family()
    w = Words(texts)
    sig = (mix64(minhash.superminhash(*minhash.shingles(w)).astype(U64)) >> U64(48)).astype(np.uint16)
    sets = [shingle_set(t) for t in texts]
    edges = []
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            equal = sig[i] == sig[j]
            if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]) and equal.reshape(-1, minhash.ROWS_PER_BAND).all(axis=1).any() and equal.mean() >= minhash.THRESHOLD - minhash.MARGIN:
                edges.append((i, j))
    assert len(edges) >= 25
    want = joined(edges, range(len(texts)))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), part=part).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == want


def test_drop_keeps_one_of_each_group_and_all_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = docs.selectExpr("*", "1 AS `key`", "2 AS id", "3 AS __key", "'x' AS TEXT", "4 AS sig")
    got = minhash.drop_near_duplicates(clash)
    assert got.columns == clash.columns
    kept = [r[0] for r in got.collect()]
    gone = {r.doc_id for r in minhash.near_duplicates(docs).where("NOT keep").collect()}
    want = [r[0] for r in {(r[0], r[1]) for r in rows}]
    assert sorted(map(str, kept)) == sorted(str(i) for i in want if i not in gone or i is None) or len(kept) == len(want) - minhash.near_duplicates(docs).where("NOT keep").count()


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(docs).collect() == []
    assert minhash.drop_near_duplicates(docs).collect() == []


def test_components_in_rounds_equal_union_find(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    df = spark.createDataFrame(e, "u bigint, v bigint").repartition(5)
    for most in (10**6, 10):
        got = dict((r.u, r.v) for r in components(df, Scratch(spark, "t"), most).collect())
        nodes, roots = union_find(*np.array(e).T)
        assert got == {int(n): int(r) for n, r in zip(nodes, roots, strict=True) if n != r}


def test_words_follow_unicode():
    w = Words(["Été 12a_b", "", "x\nÉTÉ"])
    assert w.off.tolist() == [0, 3, 3, 5]
    assert w.hash[0] == w.hash[4]
    assert w.start.tolist() == [0, 4, 8, 0, 2] and w.end.tolist() == [3, 7, 9, 1, 5]


def test_a_bucket_of_many_near_copies_is_one_group(spark):
    rng = random.Random(3)
    base = invented(rng, 120, 10_000).split()
    rows = []
    for i in range(2000):
        w = base[:]
        w[rng.randrange(120)] = f"u{i}x"
        rows.append((f"id-{i:05d}", " ".join(w)))
    rows += [(None, invented(rng, 100, 10_000)), ("alone", invented(rng, 100, 10_000))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), part=150).collect()
    assert len(got) == 2000 and {r.group_size for r in got} == {2000} and sum(r.keep for r in got) == 1
    assert {r.doc_id for r in got} == {r[0] for r in rows[:2000]} and len({r.group_id for r in got}) == 1


def test_very_long_texts(spark):
    rng = random.Random(4)
    long = invented(rng, 300_000, 100_000)
    got = minhash.near_duplicates(spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text")], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.group_id) for r in got) == [(1, 1), (2, 1)]
