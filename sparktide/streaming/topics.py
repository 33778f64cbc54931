"""Topics of streams: scoring, shares by time window, and factors that take in each micro-batch."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_english
from ..operators import factorize, kernels

#: Non-zeros of a micro-batch that are gathered on the driver; larger ones are refused, so the trigger must be set accordingly.
MOST_NNZ = 5_000_000


def score_stream(docs: DataFrame, h: DataFrame, text: str = "text") -> DataFrame:
    """docs with topic_id of the highest score and that score; stateless, so it runs on streams and tables alike.

    h must be small enough for a map column: words of topics, as top_words gives them. Documents
    without a known word have topic_id -1 and score 0; of equal scores the least topic counts.
    """
    by = h.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("topic_id", "weight"))).alias("m"))
    terms = {r.term: r.m for r in by.collect()}
    k = max((t for m in terms.values() for t in m), default=0)
    words = F.array_distinct(clean_english(F.col(text)))
    scores = []
    for t in range(1, k + 1):
        own = {w: m[t] for w, m in terms.items() if m.get(t)}
        s = _summed("__words", F.from_json(F.lit(json.dumps(own, ensure_ascii=False)), "map<string,double>"))
        scores.append(F.struct((s / F.sqrt(F.greatest(F.size("__words"), F.lit(1)))).alias("score"), F.lit(-t).alias("t")))
    if not scores:
        return docs.withColumn("topic_id", F.lit(-1)).withColumn("score", F.lit(0.0))
    best = F.array_max(F.array(*scores))
    out = docs.withColumn("__words", words).withColumn("__best", best)
    return out.withColumn("topic_id", F.when(F.col("__best.score") > 0, -F.col("__best.t")).otherwise(-1)).withColumn("score", F.col("__best.score")).drop("__words", "__best")


def _summed(words: str, table: Column) -> Column:
    """Sum of the table's values of an array of words; 0 for a NULL array."""
    return F.coalesce(F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(table[w], F.lit(0.0))), F.lit(0.0))


def windowed_shares(scored: DataFrame, ts: str, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, topic_id, n, score): documents and summed scores of each topic in tumbling or, with slide, sliding windows.

    Rows later than `late` are left out; state is kept for open windows only.
    """
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    g = scored.withWatermark(ts, late).groupBy(w.alias("w"), "topic_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    return g.select(F.col("w.start").alias("start"), "topic_id", "n", "score")


class OnlineTopics:
    """foreachBatch target: each batch of (doc_id, term, w) updates H, which is saved by batch number, so a repeated batch starts from the same H.

    terms fixes the columns; unseen terms of a batch are left out.
    """

    def __init__(self, spark: SparkSession, path: str, terms: list[str], k: int):
        self.spark, self.path, self.k = spark, path, k
        self.terms = sorted(set(terms))
        self.at = {t: i for i, t in enumerate(self.terms)}
        self.states: dict[int, tuple] = {-1: (None, None, None)}

    def __call__(self, batch: DataFrame, number: int) -> None:
        known = batch.where(F.col("term").isin(self.terms)) if len(self.terms) <= 1000 else batch
        nnz = known.count()
        if nnz > MOST_NNZ:
            raise ValueError(f"{nnz} non-zeros in a batch; lower the trigger's size")
        if nnz == 0:
            return
        t = known.select("doc_id", "term", "w").toPandas()
        t = t[t["term"].isin(self.at)]
        if t.empty:
            return
        docs, row = np.unique(t["doc_id"].to_numpy(), return_inverse=True)
        model = kernels.OnlineNMF(self.k)
        before = max(n for n in self.states if n < number)
        model.h, model.wtw, model.wtv = self.states[before]
        w = model.update(kernels.Sparse(row, t["term"].map(self.at).to_numpy(), t["w"].to_numpy(), (len(docs), len(self.terms))))
        self.states = {before: self.states[before], number: (model.h, model.wtw, model.wtv)}
        factorize._long(self.spark, docs, w, "doc_id", False).write.mode("overwrite").parquet(f"{self.path}/w/batch={number}")
        factorize._long(self.spark, self.terms, model.h.T, "term", True).write.mode("overwrite").parquet(f"{self.path}/h/batch={number}")
