"""Term weights: term frequencies, inverse document frequencies, TF-IDF, BM25, length normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vocab import document_frequency

TF = ("augmented", "binary", "double_log", "log", "log_ratio")


def tf_weight(tf: DataFrame, scheme: str) -> DataFrame:
    """(doc_id, term, w) by a term frequency scheme.

    augmented 0.5 + 0.5 tf / max; binary 1; double_log 1 + log2(1 + log2 tf); log 1 + log2 tf;
    log_ratio log over 1 + log2((1 + sum tf) / (1 + distinct)) of the document.
    """
    doc = Window.partitionBy("doc_id")
    x = F.col("tf")
    w = {
        "augmented": 0.5 + 0.5 * x / F.max("tf").over(doc),
        "binary": F.lit(1.0),
        "double_log": 1 + F.log2(1 + F.log2(x)),
        "log": 1 + F.log2(x),
        "log_ratio": (1 + F.log2(x)) / (1 + F.log2((1 + F.sum("tf").over(doc)) / (1 + F.count("tf").over(doc)))),
    }[scheme]
    return tf.select("doc_id", "term", w.alias("w"))


def idf(df: Column, n: Column, scheme: str) -> Column:
    """none 1; plain log2(N/df) + 1; smooth log2((1+N)/df); prob log2((N-df+1)/(df+1)); bm25 log2((N-df+.5)/(df+.5))."""
    return {
        "none": F.lit(1.0),
        "plain": F.log2(n / df) + 1,
        "smooth": F.log2((1 + n) / df),
        "prob": F.log2((n - df + 1) / (df + 1)),
        "bm25": F.log2((n - df + 0.5) / (df + 0.5)),
    }[scheme]


def document_lengths(docs: DataFrame, tf: DataFrame) -> DataFrame:
    """(doc_id, len, avg_len, n): tokens of every document, 0 for those without, which count in the mean."""
    lens = docs.select("doc_id").join(tf.groupBy("doc_id").agg(F.sum("tf").alias("len")), "doc_id", "left").withColumn("len", F.coalesce("len", F.lit(0)))
    return lens.crossJoin(F.broadcast(lens.agg(F.avg("len").alias("avg_len"), F.count(F.lit(1)).alias("n"))))


def pivot_norm(length: Column, mean: Column, slope: float = 0.2) -> Column:
    """1 - slope + slope length / mean; slope -1 switches it off."""
    return F.lit(1.0) if slope == -1 else (1 - slope) + slope * length / mean


def tfidf(docs: DataFrame, tf: DataFrame, idf_scheme: str = "smooth", tf_scheme: str = "binary", slope: float = 0.2, weights: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, w): tf times idf over the pivoted length; zeros are left out.

    The faithful default has tf 1, as counts are made binary before weighting; other schemes are options.
    weights (doc_id, weight) scales the rows. The document frequencies stay partitioned as joined, by term.
    """
    x = tf_weight(tf, tf_scheme).join(document_frequency(tf), "term").join(document_lengths(docs, tf), "doc_id")
    w = F.col("w") * idf(F.col("df"), F.col("n"), idf_scheme) / pivot_norm(F.col("len"), F.col("avg_len"), slope)
    if weights is not None:
        x = x.join(weights, "doc_id")
        w = w * F.col("weight")
    return x.select("doc_id", "term", w.alias("w")).where("w <> 0")


def bm25(docs: DataFrame, tf: DataFrame, k1: float = 1.2, b: float = 0.75, binary: bool = True) -> DataFrame:
    """(doc_id, term, w): Okapi weights; binary counts (and lengths in distinct terms) unless told otherwise."""
    counts = tf.withColumn("tf", F.lit(1)) if binary else tf
    x = counts.join(document_frequency(tf), "term").join(document_lengths(docs, counts), "doc_id")
    w = idf(F.col("df"), F.col("n"), "bm25") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return x.select("doc_id", "term", w.alias("w"))


def matrix_stats(docs: DataFrame, tf: DataFrame) -> DataFrame:
    """One row: documents, terms, non-zeros, density, and the rank bound floor(nnz / (docs + terms))."""
    a = docs.agg(F.countDistinct("doc_id").alias("n_docs"))
    b = tf.agg(F.countDistinct("term").alias("n_terms"), F.count(F.lit(1)).alias("nnz"))
    return a.crossJoin(b).select("n_docs", "n_terms", "nnz", (F.col("nnz") / (F.col("n_docs") * F.col("n_terms"))).alias("density"), F.floor(F.col("nnz") / (F.col("n_docs") + F.col("n_terms"))).alias("max_rank"))


def normalize(df: DataFrame, group: list[str], value: str = "w", norm: str = "l2") -> DataFrame:
    """value over the L1 or L2 norm of its group; a group of zeros gives NULL."""
    g = Window.partitionBy(*group)
    size = F.sqrt(F.sum(F.col(value) * F.col(value)).over(g)) if norm == "l2" else F.sum(F.abs(value)).over(g)
    return df.withColumn(value, F.col(value) / F.nullif(size, F.lit(0.0)))
