import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparktide.llm import lm, toxicity

from .fixtures import SCHEMA, corpus, invented


def toxic_corpus(n=400, seed=0):
    rng = random.Random(seed)
    rows, labels, where = [], [], {}
    for i in range(n):
        s = [invented(rng, rng.randrange(4, 12), 600) + "." for _ in range(rng.randrange(2, 9))]
        bad = i % 5 == 0
        if bad:
            where[i] = rng.randrange(len(s))
            s[where[i]] = f"you are a {rng.choice(['vilex', 'vilexes', 'grotz', 'smarg'])} {invented(rng, 3, 600)}!"
        rows.append((i, " ".join(s), "en", "s", 0))
        labels.append((i, 0, int(bad)))
    return rows, labels, where


def test_held_out_accuracy_and_location(spark):
    rows, labels, where = toxic_corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels[:240], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, marks)
    held = docs.where("doc_id >= 240")
    got = toxicity.toxic_sentences(held, model).collect()
    want = {i: s for i, s in where.items() if i >= 240}
    assert len({r.doc_id for r in got} & set(want)) >= 0.9 * len(want)
    assert len({r.doc_id for r in got} - set(want)) <= 2
    assert sum(want.get(r.doc_id) == r.sentence for r in got) >= 0.9 * len(got)
    text = {r[0]: r[1] for r in rows}
    assert all("you are" in text[r.doc_id][r.start_char : r.end_char] for r in got if want.get(r.doc_id) == r.sentence)
    kept = toxicity.drop_toxic(held.selectExpr("*", "1 AS Text"), model)
    assert kept.columns == [*held.columns, "Text"]
    assert {r[0] for r in kept.collect()} == {r[0] for r in rows if r[0] >= 240} - {r.doc_id for r in got}


def test_score_is_the_noisy_or_of_the_sentences():
    rows, labels, _ = toxic_corpus(120)
    m = toxicity.fit([r[1] for r in rows], np.array([x[2] for x in labels]))
    total, _, doc, _, p = m.score([rows[0][1], "", rows[1][1]])
    for i in range(3):
        assert math.isclose(total[i], 1 - np.prod(1 - p[doc == i]), abs_tol=1e-9)
    assert total[1] == 0


@pytest.mark.parametrize("labels", [[], [(1, 0, 1)], [(1, 0, 0), (None, 0, 1), (2, 0, None)]])
def test_odd_labels_and_rows_leave_all_documents(spark, labels):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert toxicity.drop_toxic(docs, model).count() == len(rows)
    assert toxicity.toxic_sentences(docs, model).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.drop_toxic(none, model).collect() == toxicity.toxic_sentences(none, model).collect() == []


def kneser_ney(texts, n=lm.ORDER):
    """Interpolated modified Kneser-Ney from dictionaries."""
    def grams(t, k=n):
        b = bytes([lm.START]) * (n - 1) + t.encode() + bytes([lm.END])
        return [b[i : i + k] for i in range(n - k, len(b) - k + 1)]

    counts = {n: Counter(g for t in texts for g in grams(t))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc = {k: lm.discounts(*[float(sum(v == i for v in c.values())) for i in range(1, 5)]) for k, c in counts.items()}
    ctx = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            ctx[k][g[:-1]].append(v)

    def p(g):
        k = len(g)
        if not k:
            return 1 / lm.SYMBOLS
        own = ctx[k].get(g[:-1])
        if not own:
            return p(g[1:])
        d, v = disc[k], counts[k].get(g, 0)
        back = sum(d[min(x, 3) - 1] for x in own) / sum(own)
        return (v - d[min(v, 3) - 1] if v else 0) / sum(own) + back * p(g[1:])

    return lambda t: [math.log(p(g)) for g in grams(t)]


def test_perplexity_equals_dictionaries(spark):
    rows = [r for r in corpus() if r[0] != 131]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS ID", "2 AS Text", "3 AS g", "4 AS c")
    for parts in (1, 3):
        model = lm.train(docs, parts=parts)
        other = spark.createDataFrame([*rows, (777, "unseen ñ text ☃ " * 3, "", "", 0)], SCHEMA)
        logs = kneser_ney([r[1] for r in rows if r[1] is not None])
        got = lm.perplexity(other, model).collect()
        assert len(got) == len(rows) + 1
        texts = defaultdict(list)
        for r in [*rows, (777, "unseen ñ text ☃ " * 3)]:
            texts[r[0]].append(r[1])
        for r in got:
            if texts[r.doc_id] == [None]:
                assert r.n_bytes is None and r.log_prob is None and r.perplexity is None
                continue
            want = [sum(logs(t)) for t in texts[r.doc_id]]
            assert min(abs(r.log_prob - x) for x in want) < 1e-3 * max(1, abs(want[0]))
            assert math.isclose(r.perplexity, math.exp(-r.log_prob / (r.n_bytes + 1)), rel_tol=1e-6)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "abracadabra", "", "", 0), (2, "abba", "", "", 0)], SCHEMA)
    m = lm.train(docs)
    g, _ = lm.grams(["abrac"])
    every = (g[-2] & ~np.uint64(0xFF)) | np.arange(256, dtype=np.uint64)
    assert math.isclose(np.exp(m.log_prob(every)).sum(), 1.0, abs_tol=1e-4)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert lm.perplexity(docs, lm.train(docs)).collect() == []
