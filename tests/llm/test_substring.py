import random

import numpy as np
import pytest

from sparktide.llm import substring
from sparktide.llm.textkernel import Words

from .fixtures import SCHEMA, corpus, invented, repeated_words


def covered(spark, rows, window, batches):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in substring.repeated_passages(docs, window=window, batches=batches).collect():
        out.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    return out


def words_in(text, spans):
    w = Words([text])
    return [any(a <= s and e <= b for a, b in spans) for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)]


@pytest.mark.parametrize("batches", [1, 3])
def test_equals_every_window_compared(spark, batches):
    rows = [r for r in corpus() if r[0] is not None]
    got = covered(spark, rows, 50, batches)
    uniq = sorted(set(rows), key=lambda r: r[0])
    want = repeated_words([r[1] for r in uniq], 50)
    for r, bad in zip(uniq, want, strict=True):
        assert words_in(r[1] or "", got.get(r[0], [])) == bad, r[0]
    assert {r[0] for r, bad in zip(uniq, want, strict=True) if any(bad)} == set(got)


def test_small_windows_and_many_overlaps(spark):
    rng = random.Random(5)
    rows = [(i, invented(rng, 80, 3), "en", "s", 0) for i in range(12)] + [(90, "a " * 300, "en", "s", 0)]
    got = covered(spark, rows, 6, 4)
    for r, bad in zip(rows, repeated_words([r[1] for r in rows], 6), strict=True):
        assert words_in(r[1], got.get(r[0], [])) == bad, r[0]


def test_compaction_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring, "FANOUT", 2)
    rows = [r for r in corpus(2) if r[0] is not None]
    got = covered(spark, rows, 50, 6)
    uniq = sorted(set(rows), key=lambda r: r[0])
    for r, bad in zip(uniq, repeated_words([r[1] for r in uniq], 50), strict=True):
        assert words_in(r[1] or "", got.get(r[0], [])) == bad, r[0]


def test_cut_takes_effect_and_keeps_the_rest(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 AS ws", "8 AS spans", "9 AS __text", "10 AS Doc_ID")
    got = substring.drop_repeated_passages(docs)
    assert got.columns == docs.columns
    out = [tuple(r) for r in got.collect()]
    uniq = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    bad_of = {r[:2]: b for r, b in zip(uniq, repeated_words([r[1] for r in uniq], 50), strict=True)}
    for r in rows:
        bad = bad_of[r[:2]]
        if not bad or not all(bad):
            want.append((r[0], [w for w, b in zip(Words([r[1] or ""]).hash.tolist(), bad, strict=True) if not b]))
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r[0], Words([r[1] or ""]).hash.tolist()) for r in out), key=key) == sorted(want, key=key)
    assert all(r[4] == (len(r[1]) if r[1] is not None else None) for r in out)


def test_empty_table_and_merge(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert substring.repeated_passages(docs).collect() == []
    assert substring.drop_repeated_passages(docs).collect() == []
    assert substring.merged(np.array([5, 1, 2, 30]), 4) == [(1, 9), (30, 34)]


def test_few_words(spark):
    rng = random.Random(0)
    for n in range(61):
        w = Words([invented(rng, n)])
        for k in (2, 25, 50):
            h, valid = w.ngrams(k)
            assert len(h) == n and valid.sum() == max(0, n - k + 1)
    for n in (0, 1, 20, 49, 60):
        df = spark.createDataFrame([(1, invented(rng, n), "en", "s", 0)], SCHEMA)
        assert substring.repeated_passages(df).count() == 0


def test_production_parameters_compact():
    assert substring.BATCHES > substring.FANOUT


def test_second_call_extends_the_index(spark, tmp_path):
    rows = [r for r in corpus(2) if r[0] is not None]
    uniq = sorted(set(rows), key=lambda r: r[0])
    want = {r[0]: bad for r, bad in zip(uniq, repeated_words([r[1] for r in uniq], 50), strict=True)}
    path, half = str(tmp_path / "index"), 60
    got = {}
    for part, history in ((rows[:half], None), (rows[half:], rows[:half])):
        docs = spark.createDataFrame(part, SCHEMA)
        old = spark.createDataFrame(history, SCHEMA) if history else None
        for r in substring.repeated_passages(docs, batches=2, index_path=path, history=old).collect():
            got.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    # the halves go by place, not by id, so that only what is repeated is compared
    order = sorted(set(rows[:half]), key=lambda r: r[0]) + sorted(set(rows[half:]) - set(rows[:half]), key=lambda r: r[0])
    want = {r[0]: bad for r, bad in zip(order, repeated_words([r[1] for r in order], 50), strict=True)}
    for r in order:
        assert words_in(r[1] or "", got.get(r[0], [])) == want[r[0]], r[0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sparktide_run")]


def test_string_ids_and_a_very_long_text(spark):
    rng = random.Random(9)
    long = invented(rng, 250_000, 100_000)
    passage = invented(rng, 60, 10_000)
    docs = spark.createDataFrame([("x", f"{long} {passage}"), ("y", f"{passage} end"), (None, passage)], "doc_id string, text string")
    got = {(r.doc_id, r.n_words) for r in substring.repeated_passages(docs).collect()}
    assert len(got) == 2 and {n for _, n in got} == {60} and {i for i, _ in got} <= {"x", "y", None}
