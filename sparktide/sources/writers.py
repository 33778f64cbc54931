"""Results as files: JSON for people, CSV for sheets, Parquet for what is read again."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _named(topic_id: int) -> str:
    return f"Topic {topic_id:02d}"


def _write(path: str, value) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    return path


def word_scores(words: DataFrame) -> dict[str, dict[str, float]]:
    """{topic: {term: score}} of a table of top words; bounded by topics times words."""
    out: dict[str, dict[str, float]] = {}
    for r in words.orderBy("topic_id", "rank").select("topic_id", "term", "score").collect():
        out.setdefault(_named(r.topic_id), {})[r.term] = r.score
    return out


def document_scores(top: DataFrame) -> dict[str, dict[str, float]]:
    """{topic: {document text: score}} of a table of top documents."""
    out: dict[str, dict[str, float]] = {}
    for r in top.orderBy("topic_id", "rank").select("topic_id", "text", "score").collect():
        out.setdefault(_named(r.topic_id), {})[r.text] = r.score
    return out


def save_word_scores(words: DataFrame, folder: str, name: str) -> str:
    """{name}_word_scores.json."""
    return _write(f"{folder}/{name}_word_scores.json", word_scores(words))


def save_document_scores(top: DataFrame, folder: str, name: str) -> str:
    """{name}_top_docs.json."""
    return _write(f"{folder}/{name}_top_docs.json", document_scores(top))


def save_links(s: DataFrame, normalized: DataFrame, folder: str, name: str) -> str:
    """{name}_s_matrix.json: the matrix of topic links and its column-normalized form, as lists of rows."""
    def rows(df: DataFrame) -> list[list[float]]:
        cells = {(r.i, r.j): r.value for r in df.collect()}
        n, m = max((i for i, _ in cells), default=0), max((j for _, j in cells), default=0)
        return [[cells.get((i, j), 0.0) for j in range(1, m + 1)] for i in range(1, n + 1)]

    a, b = rows(s), rows(normalized)
    return _write(f"{folder}/{name}_s_matrix.json", {"s_matrix": a, "s_matrix_normalized": b, "shape": [len(a), len(a[0]) if a else 0]})


def topic_sheet(words: DataFrame) -> tuple[list[str], list[list]]:
    """A table of ranks by topics: header and rows, cells "term" and its weight; blank where a topic has fewer words."""
    scores = word_scores(words)
    depth = max(map(len, scores.values()), default=0)
    lines = [[str(r + 1), *[x for t in scores.values() for x in (list(t.items())[r] if r < len(t) else ("", ""))]] for r in range(depth)]
    return ["rank", *[x for t in scores for x in (t, f"{t} score")]], lines


def save_sheet(words: DataFrame, folder: str, name: str) -> str:
    """{name}_topics.csv: the sheet of topic_sheet."""
    os.makedirs(folder, exist_ok=True)
    header, lines = topic_sheet(words)
    with open(f"{folder}/{name}_topics.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(lines)
    return f"{folder}/{name}_topics.csv"


def save_merges(merges: list[tuple[int, str, str, int]], folder: str, name: str) -> str:
    """{name}_ngrams.json: each merge's rank, parts and frequency."""
    return _write(f"{folder}/{name}_ngrams.json", [{"rank": r, "first": a, "second": b, "ngram": f"{a}_{b}", "frequency": n} for r, a, b, n in merges])


def save_sweep(curve: list[tuple[int, float]], folder: str, name: str) -> str:
    """{name}_optimization.csv: topics, coherence, and whether it is the best."""
    os.makedirs(folder, exist_ok=True)
    best = max(curve, key=lambda x: (x[1], -x[0]))[0] if curve else None
    with open(f"{folder}/{name}_optimization.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["topics", "coherence", "is_optimal"])
        out.writerows([k, c, k == best] for k, c in curve)
    return f"{folder}/{name}_optimization.csv"


def save_table(df: DataFrame, path: str, order: list[str] | None = None) -> str:
    """A small table, such as periods by topics or a forecast, as one ordered CSV."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def save_model(h: DataFrame, path: str) -> None:
    """H as Parquet, partitioned by topic, to be read by load_model."""
    h.select("topic_id", "term", "weight").where("weight > 0").write.mode("overwrite").partitionBy("topic_id").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """H (topic_id, term, weight) that save_model wrote."""
    return spark.read.parquet(path).select(F.col("topic_id").cast("int").alias("topic_id"), "term", "weight")


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at path, or else build()'s rows, which are written there first."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

