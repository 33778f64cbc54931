"""Topic coherence from document and window counts of the topics' own words.

Only those words are looked at: the corpus is filtered to them first, so what is joined with itself
is small however long the documents are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed


def _hits(tok: DataFrame, words: DataFrame) -> DataFrame:
    return tok.join(F.broadcast(words.select("term").distinct()), "term")  # topic words: topics x words per topic


def document_pairs(tok: DataFrame, words: DataFrame) -> DataFrame:
    """(topic_id, r1, r2, w1, w2, d1, d2, d12): documents with each two words of a topic, r1 < r2; words is (topic_id, rank, term)."""
    hit = _hits(tok, words).select("doc_id", "term").distinct()
    single = hit.groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    a, b = hit.withColumnRenamed("term", "w1"), hit.withColumnRenamed("term", "w2")
    return _pairs(words, single, a.join(b, "doc_id").where("w1 < w2").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("d12")))


def _pairs(words: DataFrame, single: DataFrame, both: DataFrame) -> DataFrame:
    x = words.select("topic_id", F.col("rank").alias("r1"), F.col("term").alias("w1"))
    y = words.select("topic_id", F.col("rank").alias("r2"), F.col("term").alias("w2"))
    p = x.join(y, "topic_id").where("r1 < r2").withColumn("lo", F.least("w1", "w2")).withColumn("hi", F.greatest("w1", "w2"))
    p = p.join(both.select(F.col("w1").alias("lo"), F.col("w2").alias("hi"), "d12"), ["lo", "hi"], "left")
    p = p.join(single.select(F.col("term").alias("w1"), F.col("d").alias("d1")), "w1", "left").join(single.select(F.col("term").alias("w2"), F.col("d").alias("d2")), "w2", "left")
    return p.select("topic_id", "r1", "r2", "w1", "w2", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("d1", "d2", "d12")])


def u_mass(pairs: DataFrame, n_docs: DataFrame, variant: str = "counts") -> DataFrame:
    """(topic_id, u_mass): mean over word pairs, the later word given the earlier.

    counts: ln((d12 + 1e-12) / d1) where all counts are positive; one: ln((d12 + 1) / d1) where d1 is;
    shares: ln((d12 / N + 1e-12) / (d1 / N)) where d1 is. n_docs is one row (n).
    """
    x = pairs.crossJoin(F.broadcast(n_docs))
    score = {
        "counts": F.when((F.col("d1") > 0) & (F.col("d2") > 0) & (F.col("d12") > 0), F.log((F.col("d12") + 1e-12) / F.col("d1"))),
        "one": F.when(F.col("d1") > 0, F.log((F.col("d12") + 1.0) / F.col("d1"))),
        "shares": F.when(F.col("d1") > 0, F.log((F.col("d12") / F.col("n") + 1e-12) / (F.col("d1") / F.col("n")))),
    }[variant]
    return x.groupBy("topic_id").agg(F.avg(score).alias("u_mass"))


def c_uci(pairs: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(topic_id, c_uci): mean ln((p12 + 1e-9) / (p1 p2)) over pairs whose probabilities are positive."""
    x = pairs.crossJoin(F.broadcast(n_docs)).where("d1 > 0 AND d2 > 0 AND d12 > 0")
    return x.groupBy("topic_id").agg(F.avg(F.log((F.col("d12") / F.col("n") + 1e-9) / (F.col("d1") / F.col("n") * F.col("d2") / F.col("n")))).alias("c_uci"))


#: Windows of a document that are looked at together.
WINDOWS = 1 << 16


def window_pairs(docs: DataFrame, words: DataFrame, window: int = 110) -> tuple[DataFrame, DataFrame]:
    """document_pairs over sliding windows of documents (doc_id, tokens) instead of documents, and their number as one row (n).

    A document of n tokens has max(1, n - window + 1) windows, none without tokens. They are counted within its row: which windows hold
    a topic word is a row of zeros and ones, and the products of these rows are the counts. Tasks give sums only, at most one per two words.
    """
    terms = sorted(r[0] for r in words.select("term").distinct().collect())  # topics x words per topic

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, total = np.zeros((len(terms), len(terms)), np.int64), 0
        for batch in batches:
            tokens = batch.column(0)
            code = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=pa.array(terms, pa.string())), -1))
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), dtype=np.int64))
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if lo == hi:
                    continue
                n = max(1, hi - lo - window + 1)
                total += n
                pos = np.flatnonzero(code[lo:hi] >= 0)
                if not len(pos):
                    continue
                own, which = np.unique(code[lo:hi][pos], return_inverse=True)
                first, last = np.maximum(0, pos - window + 1), np.minimum(pos, n - 1)
                for at in range(0, n, WINDOWS):
                    m = min(WINDOWS, n - at)
                    use = (first < at + m) & (last >= at)
                    step = np.zeros((len(own), m + 1), np.int32)
                    np.add.at(step, (which[use], np.maximum(first[use] - at, 0)), 1)
                    np.add.at(step, (which[use], np.minimum(last[use] - at, m - 1) + 1), -1)
                    held = (np.cumsum(step, axis=1)[:, :m] > 0).astype(np.float32)  # counts up to 2^16 are exact
                    both[np.ix_(own, own)] += (held @ held.T).astype(np.int64)
        a, b = np.nonzero(np.triu(both))
        yield pa.RecordBatch.from_arrays([pa.array([*a.tolist(), -1], pa.int32()), pa.array([*b.tolist(), -1], pa.int32()), pa.array([*both[a, b].tolist(), total], pa.int64())], names=["a", "b", "n"])

    counts = checkpointed(docs.select("tokens").mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")))
    name = F.lit(terms) if terms else F.array(F.lit(None).cast("string"))
    single = counts.where("a >= 0 AND a = b").select(F.get(name, F.col("a")).alias("term"), F.col("n").alias("d"))
    pairs = counts.where("a < b").select(F.get(name, F.col("a")).alias("w1"), F.get(name, F.col("b")).alias("w2"), F.col("n").alias("d12"))
    return _pairs(words, single, pairs), counts.where("a < 0").select("n")


def c_v(docs: DataFrame, words: DataFrame, window: int = 110, eps: float = 1e-12) -> DataFrame:
    """(topic_id, c_v) of documents (doc_id, tokens): mean cosine of each word's NPMI vector with the sum of its topic's vectors.

    NPMI = ln((p12 + eps) / (p1 p2)) / -ln(p12 + eps); 0 where a word never occurs; a word with itself has p12 = p1.
    """
    pairs, total = window_pairs(docs, words, window)
    half = pairs.select("topic_id", F.col("r1").alias("a"), F.col("r2").alias("b"), "d1", "d2", "d12")
    other = pairs.select("topic_id", F.col("r2").alias("a"), F.col("r1").alias("b"), F.col("d2").alias("d1"), F.col("d1").alias("d2"), "d12")
    own = half.select("topic_id", "a", "d1").unionByName(other.select("topic_id", "a", "d1")).distinct().select("topic_id", "a", F.col("a").alias("b"), "d1", F.col("d1").alias("d2"), F.col("d1").alias("d12"))
    n = F.col("n")
    p12 = F.col("d12") / n + eps
    npmi = F.when((F.col("d1") > 0) & (F.col("d2") > 0), F.log(p12 / (F.col("d1") / n * F.col("d2") / n)) / -F.log(p12)).otherwise(0.0)
    v = half.unionByName(other).unionByName(own).crossJoin(F.broadcast(total)).select("topic_id", "a", "b", npmi.alias("v"))
    v = v.withColumn("t", F.sum("v").over(Window.partitionBy("topic_id", "b")))
    cos = v.groupBy("topic_id", "a").agg((F.sum(F.col("v") * F.col("t")) / F.nullif(F.sqrt(F.sum(F.col("v") * F.col("v")) * F.sum(F.col("t") * F.col("t"))), F.lit(0.0))).alias("cos"))
    return cos.groupBy("topic_id").agg(F.avg(F.coalesce("cos", F.lit(0.0))).alias("c_v"))
