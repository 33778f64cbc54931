import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparktide.llm import packing
from sparktide.llm.textkernel import word_counts

from .fixtures import SCHEMA, corpus


def fewest(lengths, capacity):
    """The fewest bins, by trying all assignments."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in sorted(set(range(len(bins))), key=lambda b: -bins[b]):
            if bins[b] + lengths[i] <= capacity:
                bins[b] += lengths[i]
                place(i + 1, bins)
                bins[b] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_search_keeps_items_fits_and_never_lowers_the_squares():
    rng = random.Random(0)
    saved = 0
    for _ in range(40):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))]
        first = packing.best_fit(lengths, 100)
        last = packing.local_search(lengths, first, 100)
        for bins in (first, last):
            assert sorted(itertools.chain(*bins)) == list(range(len(lengths)))
            assert all(0 < sum(lengths[i] for i in b) <= 100 for b in bins)
        square = [sum(sum(lengths[i] for i in b) ** 2 for b in bins) for bins in (first, last)]
        assert square[1] >= square[0] and len(last) <= len(first)
        saved += len(first) - len(last)
    assert saved > 0


def test_swaps_empty_a_bin_that_best_fit_leaves():
    lengths = [30, 30, 60, 60]
    first = packing.best_fit(lengths, 100)
    search = packing.Search(lengths, first, 100)
    before = search.squares()
    last = search.run()
    assert len(first) == 3 and len(last) == 2 == fewest(lengths, 100)
    assert search.steps > 0 and search.emptied == 1 and search.squares() > before


def test_search_works_on_the_lengths_of_real_documents(spark):
    # at this size best fit leaves bins that exchanges can empty; on a thousand documents it needs none
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy(F.xxhash64("doc_id")).limit(packing.DOCS_PER_SHARD)
    n = [r[0] % packing.CAPACITY for r in docs.select(F.size(F.split(F.trim("text"), r"\s+"))).collect()]
    n = [x for x in n if x]
    first = packing.best_fit(n, packing.CAPACITY)
    search = packing.Search(n, first, packing.CAPACITY)
    before = search.squares()
    last = search.run()
    assert search.steps > 0 and search.squares() > before and len(last) < len(first)
    assert len(last) == -(-sum(n) // packing.CAPACITY)


def test_word_counts():
    texts = ["", " ", "a", "a b", "  a\tb\nc ", None, "ünï cödé", "x\u00a0y z", "word " * 1000, "\x0b\x0cq\rz"]
    for column in (pa.array(texts), pa.array(["pad", *texts, "pad"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        for limit in (1, 10, 1 << 22):
            assert word_counts(column, limit).tolist() == [len(re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "")) for t in texts]
    assert word_counts(pa.array([], pa.string())).tolist() == []


@pytest.mark.parametrize("times", [1, 3])
def test_search_goes_on_after_a_bin_was_emptied(times):
    # best fit decreasing takes 11 bins where 9 do
    lengths = [51] * 6 * times + [27] * 6 * times + [26] * 6 * times + [23] * 12 * times
    first = packing.best_fit(lengths, 100, decreasing=True)
    last = packing.local_search(lengths, first, 100)
    assert len(first) == 11 * times and len(last) <= len(first) - 2
    assert sorted(itertools.chain(*last)) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 100 for b in last)


def test_near_the_optimum_on_small_instances():
    rng = random.Random(3)
    for _ in range(12):
        lengths = [rng.randrange(10, 60) for _ in range(9)]
        assert len(packing.local_search(lengths, packing.best_fit(lengths, 100), 100)) <= fewest(lengths, 100) + 1


@pytest.mark.parametrize("per_shard", [8192, 10])
def test_every_token_of_every_row_is_packed_once(spark, per_shard):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS shard", "2 AS N", "3 AS bin_id", "'z' AS TEXT")
    out = packing.pack_documents(docs, capacity=100, docs_per_shard=per_shard).collect()
    assert out[0].__fields__ == ["bin_id", "doc_id", "piece", "start_token", "n_tokens"]
    size = {}
    for r in rows:
        size.setdefault(r[0], []).append(len((r[1] or "").split()))
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        assert r.start_token == r.piece * 100
    assert got == {k: sum(v) for k, v in size.items()}
    fill = {}
    for r in out:
        if r.bin_id is None:
            assert r.n_tokens == 0
        else:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
    assert all(0 < v <= 100 for v in fill.values())
    assert sum(r.bin_id is None for r in out) == sum(n == 0 for v in size.values() for n in v)
    if per_shard == 8192:
        assert len(fill) <= sum(fill.values()) / 100 * 1.03 + 1


def test_string_ids_and_a_very_long_text(spark):
    docs = spark.createDataFrame([("a", "w " * 1_000_000), ("b", "x y"), (None, "z"), ("b", "x y")], "doc_id string, text string")
    got = {}
    for r in packing.pack_documents(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == {"a": 1_000_000, "b": 4, None: 1}


def test_empty_table_and_bad_parameters(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(docs).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(docs, capacity=0)
    with pytest.raises(ValueError):
        packing.pack_documents(docs.drop("text"))
