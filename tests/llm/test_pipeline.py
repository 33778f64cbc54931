import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sparktide.llm import packing

from .. import compare
from .fixtures import SCHEMA, corpus, near_groups, repeated_words, words

OPS = sorted((n for n in entry.queries() if n.startswith("op") and n[2].isdigit()), key=lambda n: int(n[2:].split("_")[0]))


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    assert [int(n[2:].split("_")[0]) for n in OPS] == list(range(1, 11))


@pytest.mark.parametrize("name", [n for n in OPS if n in entry.oracle_sql()])
def test_query_equals_its_sql(spark, sf, name):
    assert compare.differences(entry.queries()[name](spark, sf), compare.connect(sf), entry.oracle_sql()[name]) == ""


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None]
    rows = list(dict.fromkeys(rows))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # no labels: nothing is toxic
    rows.sort(key=lambda r: r[0])
    root = near_groups([r[1] for r in rows])
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    cut = repeated_words([r[1] for r in rows], 50)
    kept = {r[0]: sum(not b for b in bad) for r, bad in zip(rows, cut, strict=True) if not words(r[1]) or not all(bad)}
    whole = {r[0] for r, bad in zip(rows, cut, strict=True) if not any(bad)}
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append(r)
    assert set(seen) <= set(kept)
    text = {r[0]: r[1] for r in rows}
    for i, parts in seen.items():
        n = sum(p.n_tokens for p in parts)
        if i in whole:
            size = len((text[i] or "").split())
            assert n % size == 0 if size else n == 0
    fill = {}
    for r in got:
        if r.bin_id is not None:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
    assert all(v <= packing.CAPACITY for v in fill.values())


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_columns_also_on_nothing(spark, sf, stage):
    empty = spark.createDataFrame([], SCHEMA)
    out = stage[1](spark, empty, sf)
    assert out.columns == empty.columns and out.count() == 0
    wide = spark.createDataFrame(corpus(), SCHEMA).withColumn("ID", F.lit(1)).withColumn("Source_", F.lit(2))
    assert stage[1](spark, wide, sf).columns == wide.columns


def test_rest_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n[:2] == 'op' and n[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
