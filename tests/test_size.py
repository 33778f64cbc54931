import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparktide.functions import text as X
from sparktide.operators import coherence as C
from sparktide.operators import factorize as Z
from sparktide.operators import topics as P
from sparktide.operators import vocab as V


def test_texts_become_objects_a_slice_at_a_time(spark):
    texts = ["ab cd " * n for n in (1, 200_000, 3, 100_000, 100_000)] + [None, ""]
    assert list(X.slices(pa.array(texts))) == [(0, 1), (1, 2), (2, 4), (4, 7)]
    assert list(X.slices(pa.array([], pa.string()))) == []
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    assert {(r.doc_id, r.term): r.tf for r in V.count_english(docs).collect()} == {(i, w): t.count(w) for i, t in enumerate(texts) if t for w in ("ab", "cd")}
    got = {r.doc_id: r.n for r in docs.select("doc_id", X.clean_english(docs.text).alias("t")).selectExpr("doc_id", "size(t) AS n").collect()}
    assert got == {0: 2, 1: 400_000, 2: 6, 3: 200_000, 4: 200_000, 5: None, 6: 0}


def slow_merges(docs, rounds, score, least=2):
    docs, done = {k: list(v) for k, v in docs.items()}, []
    for rank in range(1, rounds + 1):
        pairs = Counter((a, b) for v in docs.values() for a, b in zip(v, v[1:], strict=False))
        f, n = Counter(w for v in docs.values() for w in v), sum(pairs.values())
        best = min(((-round(score(c, f[a], f[b], n, sum(f.values())), 9), a, b) for (a, b), c in pairs.items() if c >= least), default=None)
        if best is None:
            break
        a, b = best[1:]
        done.append((rank, a, b, pairs[a, b]))
        for k, v in docs.items():
            out, i = [], 0
            while i < len(v):
                two = v[i : i + 2] == [a, b]
                out.append(f"{a}_{b}" if two else v[i])
                i += 1 + two
            docs[k] = out
    return docs, done


@pytest.mark.parametrize("method, use_pmi", [("bpe", False), ("bpe", True), ("wordpiece", False)])
@pytest.mark.parametrize("rewrite", [16, 3])
def test_merges_count_changes_only(spark, monkeypatch, method, use_pmi, rewrite):
    monkeypatch.setattr(V, "REWRITE_AFTER", rewrite)
    r = random.Random(5)
    docs = {i: [r.choice("aaabbcde") for _ in range(r.randrange(30))] for i in range(25)} | {90: ["a", "b_c", "a_b", "c", "a_b", "c"], 91: []}
    scores = {"bpe": lambda c, *_: c, "wordpiece": lambda c, a, b, *_: round(c / ((a + 1e-10) * (b + 1e-10)), 12)}
    pmi = lambda c, a, b, n, t: math.log2((c / n) / ((a / t) * (b / t))) * math.log2(c + 1)
    calls = []
    real = V.row_pairs
    monkeypatch.setattr(V, "row_pairs", lambda d: calls.append(1) or real(d))
    got, done = V.fit_merges(spark.createDataFrame([*docs.items(), (92, None)], "doc_id bigint, tokens array<string>"), 8, method=method, use_pmi=use_pmi)
    want, wanted = slow_merges(docs, 8, pmi if use_pmi else scores[method])
    assert done == wanted
    assert {x.doc_id: x.tokens for x in got.collect()} == want | {92: None}
    assert len(calls) < len(done)


def test_windows_by_counting_them_all(spark, monkeypatch):
    monkeypatch.setattr(C, "WINDOWS", 16)
    r = random.Random(3)
    docs = {i: [r.choice("abcdefghij") for _ in range(n)] for i, n in enumerate([0, 1, 4, 5, 6, 40, 90])}
    words = spark.createDataFrame([(t, k, w) for t, ws in ((1, "abz"), (2, "bcd")) for k, w in enumerate(ws, 1)], "topic_id int, rank int, term string")
    pairs, total = C.window_pairs(spark.createDataFrame([*docs.items(), (9, None)], "doc_id int, tokens array<string>"), words, 5)
    wins = [set(v[i : i + 5]) for v in docs.values() if v for i in range(max(1, len(v) - 4))]
    n = lambda *ws: sum(set(ws) <= w for w in wins)
    assert total.first().n == len(wins)
    assert {(p.topic_id, p.w1, p.w2): (p.d1, p.d2, p.d12) for p in pairs.collect()} == {(t, a, b): (n(a), n(b), n(a, b)) for t, ws in ((1, "abz"), (2, "bcd")) for i, a in enumerate(ws) for b in ws[i + 1 :]}


def test_tasks_of_blocks_hold_their_own_terms_only(spark):
    v = spark.createDataFrame([(d, f"t{d}_{i}", 1.0 + i) for d in range(12) for i in range(4)], "doc_id bigint, term string, w double")
    x = Z._Blocks(v, 3)

    def size(b, m, load, save, shared):
        return (np.array([len(shared[0]), m.shape[1], m.shape[0]], dtype=float),)

    q = np.arange(x.n_terms * 2, dtype=float).reshape(-1, 2)
    blocks = x.each(size, (q,))
    assert x.n_terms == 48 and all(a == b == 4 * n for a, b, n in blocks) and sum(n for _, _, n in blocks) == 12
    total = x.run(lambda b, m, load, save, q: (Z._ByTerm(m.tmul(m.mul(q))),), q)[0].reshape(-1, 2)
    names = [r.term for r in x.vocab.orderBy("term_id").collect()]
    dense = np.zeros((12, 48))
    for r in v.collect():
        dense[r.doc_id, names.index(r.term)] = r.w
    assert np.allclose(total, dense.T @ (dense @ q))


def joined_rows(df):
    return sum(line.count("topic_id") > 0 for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


def test_documents_are_joined_once_for_all_topics(spark):
    v = spark.createDataFrame([(d, w, 2.0) for d in (1, 2) for w in ("a", "b", "z")], "doc_id bigint, term string, w double")
    h = spark.createDataFrame([(t, w, float(t + i)) for t in (1, 2, 3) for i, w in enumerate("ab")] + [(4, "c", 1.0)], "topic_id int, term string, weight double")
    w = spark.createDataFrame([(d, t, d / t) for d in (1, 2) for t in (1, 2, 3)], "doc_id bigint, topic_id int, weight double")
    scored = P.score_documents(v, h)
    got = {(r.doc_id, r.topic_id): (round(r.score, 9), round(r.share, 9)) for r in scored.collect()}
    assert got == {(d, t): (round((2 * t + 1) / 3**0.5, 9), round((2 * t + 1) / 15, 9)) for d in (1, 2) for t in (1, 2, 3)}
    error = P.reconstruction(v, w, h)
    wh = {(d, x): sum(d / t * (t + i) for t in (1, 2, 3)) for d in (1, 2) for i, x in enumerate("ab")}
    want = sum((2 - s) ** 2 for s in wh.values()) + 2 * 4
    assert round(error.first().sq_error, 6) == round(want, 6)
    assert joined_rows(scored) == 0


def test_tokens_of_slices_are_those_of_cleaning(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["The cat xx sat", "ab " * 500_000, None, "", "cd ef"])], "doc_id bigint, text string").coalesce(1)
    want = docs.select("doc_id", X.clean_english(docs.text).alias("tokens"))
    assert {r.doc_id: r.tokens for r in V.english_tokens(docs).collect()} == {r.doc_id: r.tokens for r in want.collect()}


@pytest.mark.parametrize("method", ["nmtf", "opnmf"])
def test_rounds_need_no_jobs_of_their_own(spark, monkeypatch, method):
    r = random.Random(2)
    v = spark.createDataFrame([(d, f"t{t:02d}", 1.0 + r.random()) for d in range(30) for t in r.sample(range(40), 8)], "doc_id bigint, term string, w double")
    want = Z.factorize(v, 2, method, threshold=0, most=9)
    jobs = []
    for most, barriers in ((2, True), (9, True), (9, False)):
        spark.sparkContext.setJobGroup(name := f"{method} {most} {barriers}", "")
        monkeypatch.setattr(Z, "_barriers", lambda _, b=barriers: b)
        got = Z.factorize_blocks(v, 2, method, threshold=0, most=most, block_docs=3)  # more blocks than tasks
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
        if most == 9:
            assert got.rounds == want.rounds == 9
            for a, b, key in ((got.w, want.w, "doc_id"), (got.h, want.h, "term")):
                a, b = ({(x[key], x.topic_id): x.weight for x in f.collect()} for f in (a, b))
                assert a.keys() == b.keys() and np.allclose([a[i] for i in sorted(a)], [b[i] for i in sorted(a)], atol=1e-6)
    assert jobs[0] == jobs[1] < jobs[2]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
