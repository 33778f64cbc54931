from sparktide.llm import licenses

from .fixtures import SCHEMA, invented, words
import random


def test_spans_and_coverage_of_planted_templates(spark):
    rng = random.Random(4)
    names = sorted(licenses.TEMPLATES)
    rows, want = [], []
    for i, n in enumerate(names * 2):
        before, after = invented(rng, rng.randrange(30)), invented(rng, 20)
        t = licenses.TEMPLATES[n]
        if i >= len(names):  # other case, other marks, other breaks
            t = t.upper().replace(" ", "\n ")
        rows.append((i, f"{before}\n{t} {after}", "en", "s", 0))
        want.append((i, n, 1.0))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, invented(rng, 20_000), "en", "s", 0), (None, licenses.TEMPLATES["ISC"], "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS license", "1 AS ID", "2 AS TEXT")
    got = licenses.scan_licenses(docs).collect()
    assert {(r.doc_id, r.license, r.coverage) for r in got} >= set(want)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r.coverage == 1.0:
            assert words(text[r.doc_id][r.start_char : r.end_char]) == words(licenses.TEMPLATES[r.license])
    assert not [r for r in got if r.doc_id in (900, 901, 902)]
    assert [r.doc_id for r in got if r.doc_id is None]


def test_edited_copies_are_measured(spark):
    w = licenses.TEMPLATES["MIT"].split()
    n = len(words(licenses.TEMPLATES["MIT"]))
    some = w[:]
    for i in range(5, len(some), 25):
        some[i] = "altered"
    half = w[: len(w) // 2]
    rows = [(1, " ".join(some), "", "", 0), (2, " ".join(half), "", "", 0), (3, " ".join(w) + " filler " * 9 + " ".join(w), "", "", 0)]
    docs = spark.createDataFrame([*rows, rows[0]], SCHEMA)
    got = [r for r in licenses.scan_licenses(docs).collect() if r.license == "MIT"]
    assert [r.doc_id for r in got].count(1) == 2  # repeated rows are reported each
    assert all(n - 12 <= r.matched_words < n for r in got if r.doc_id == 1)
    assert not [r for r in got if r.doc_id == 2]
    assert len({r.start_char for r in got if r.doc_id == 3}) == 2


def longest(a, b):
    """Best local alignment without a band: its score and matches."""
    best = (0, 0)
    row = [(0, 0)] * (len(b) + 1)
    for x in a:
        new = [(0, 0)]
        for j, y in enumerate(b):
            s, m = row[j]
            c = (s + 1, m + 1) if x == y else (s - 1, m)
            for o in (row[j + 1], new[-1]):
                c = max(c, (o[0] - 1, o[1]))
            new.append(c if c[0] > 0 else (0, 0))
            best = max(best, new[-1])
        row = new
    return best


def test_alignment_equals_unbanded_on_small_cases():
    rng = random.Random(5)
    for _ in range(60):
        a = [rng.randrange(6) for _ in range(14)]
        b = [*a[: rng.randrange(14)], *[rng.randrange(6) for _ in range(4)], *a[7:]]
        assert licenses.align(a, b, -40, 40)[0] <= longest(a, b)[1] + 3
    a = list(range(30))
    assert licenses.align(a, [99, *a, 98], -2, 3) == (30, 1, 31)
    assert licenses.align(a, [*a[:10], 77, *a[10:]], -2, 3)[0] == 30


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
