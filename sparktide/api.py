"""One call from a table of texts to topics: run_topic_analysis, and the sweep over topic numbers."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import strings
from .functions import text as X
from .operators import coherence, factorize, rows, temporal, topics, vocab, weights
from .operators.shared import checkpointed
from .sources import readers, writers


@dataclass(frozen=True)
class TopicOptions:
    """What an analysis does. topics -1 chooses their number by the size of the matrix."""

    language: str = "EN"
    topics: int = 5
    words_per_topic: int = 15
    method: str = "nmf"
    lemmatize: bool = False
    keep_numbers: bool = False
    ngrams: str | None = None  # "bpe" or "wordpiece"
    merges: int = 0  # 0: chosen by the size of the vocabulary
    id_col: str | None = None
    datetime_col: str | None = None
    weight_col: str | None = None
    grain: str = "year"
    top_documents: int = 10
    merge_threshold: float | None = None
    threshold: float = 0.005
    rounds: int | None = None


class TopicResult:
    """Documents (doc_id, tokens), weights, factors and what is drawn from them, as DataFrames; coherence and diversity as numbers."""

    def __init__(self, **parts):
        self.__dict__.update(parts)

    def save(self, folder: str, name: str) -> dict[str, str]:
        """Word scores, top documents, the sheet and, if there are any, links and periods; the paths written."""
        out = {"words": writers.save_word_scores(self.words, folder, name), "documents": writers.save_document_scores(self.top_documents, folder, name), "sheet": writers.save_sheet(self.words, folder, name)}
        if self.factors.s is not None:
            out["links"] = writers.save_links(self.factors.s, topics.column_normalized(self.factors.s), folder, name)
        if self.periods is not None:
            out["periods"] = writers.save_table(self.periods, f"{folder}/{name}_periods.csv", ["period"])
        return out


def tokens_of(text: Column, o: TopicOptions) -> Column:
    """Words of a text in the options' language; lemmas or, in Turkish, the words as they are."""
    if o.language.upper() == "TR":
        return X.words(X.clean_turkish(text))
    words = X.clean_english(text, keep_numbers=o.keep_numbers)
    return strings.lemmatize_words(words) if o.lemmatize else words


def prepare(df: DataFrame, column: str, o: TopicOptions) -> DataFrame:
    """(doc_id, text, tokens and, if given, ts and weight) of the rows with a text, repeated texts once.

    Without id_col, ids are 64-bit hashes of the text: the same in every run, without a global numbering.
    """
    d = rows.drop_repeated_rows(df.where(F.col(column).isNotNull()), [column], o.id_col)
    ident = F.col(o.id_col).cast("bigint") if o.id_col else F.xxhash64(column)
    cols = [ident.alias("doc_id"), F.col(column).cast("string").alias("text"), tokens_of(F.col(column).cast("string"), o).alias("tokens")]
    if o.datetime_col:
        cols.append(F.col(o.datetime_col).cast("timestamp").alias("ts"))
    if o.weight_col:
        cols.append(F.col(o.weight_col).cast("double").alias("raw_weight"))
    d = d.select(*cols)
    return rows.rank_weight(d, "raw_weight") if o.weight_col else d


def run_topic_analysis(spark: SparkSession, filepath: str | None = None, dataframe: DataFrame | None = None, column: str | None = None, separator: str = ",", options: TopicOptions | None = None, **changes) -> TopicResult:
    """Topics of the texts in `column` of a file or DataFrame; `changes` are fields of TopicOptions."""
    o = replace(options or TopicOptions(), **changes)
    readers.check_inputs(filepath, dataframe, column, o.language, o.topics, o.method)
    df = dataframe if dataframe is not None else readers.read_table(spark, filepath, separator)
    readers.check_inputs(None, df, column, o.language, o.topics, o.method)
    docs = checkpointed(prepare(df, column, o))
    warning = rows.check_rows(df.count(), docs.where(F.size("tokens") > 0).count())
    texts, merges = docs.select("doc_id", "text"), []
    words = docs.select("doc_id", "tokens")
    if o.ngrams:
        n = o.merges or vocab.token_frequency(vocab.explode_tokens(words)).agg(F.count("*").alias("v")).select(vocab.auto_ngram_count(F.col("v"))).first()[0]
        words, merges = vocab.fit_merges(words, n, method=o.ngrams)
        words = checkpointed(words)
    tok = vocab.explode_tokens(words)
    matrix = weights.tfidf(words, checkpointed(vocab.count_terms(words)), "prob" if o.language.upper() == "TR" else "smooth", weights=docs.select("doc_id", "weight") if o.weight_col else None)
    matrix = checkpointed(matrix)
    found = factorize.factorize(matrix, o.topics, o.method, o.threshold, o.rounds)
    top = topics.merged_top_words(found.h, o.words_per_topic, o.merge_threshold) if o.merge_threshold else topics.top_words(found.h, o.words_per_topic)
    best = topics.dominant_topic(found.w)
    k = found.h.agg(F.max("topic_id")).first()[0]
    pairs = coherence.document_pairs(tok, top)
    umass = coherence.u_mass(pairs, docs.agg(F.count("*").alias("n")))
    cv = coherence.c_v(words, top)
    return TopicResult(
        options=o, warning=warning, texts=texts, documents=words, merges=merges, matrix=matrix, factors=found, words=top, dominant=best,
        top_documents=topics.top_documents(found.w, texts, o.top_documents), relevance=topics.relevance(found.h, found.w), coherence=umass, c_v=cv,
        diversity=topics.overall_diversity(top), periods=temporal.count_distribution(best, docs.select("doc_id", "ts"), k, o.grain) if o.datetime_col else None,
    )


def run_optimization(spark: SparkSession, dataframe: DataFrame, column: str, least: int = 2, most: int = 20, step: int = 1, options: TopicOptions | None = None) -> tuple[int, list[tuple[int, float]]]:
    """The number of topics of the highest mean C_V, and (topics, C_V) of each number tried; the matrix is built once."""
    o = options or TopicOptions()
    readers.check_inputs(None, dataframe, column, o.language, least, o.method)
    docs = checkpointed(prepare(dataframe, column, o).select("doc_id", "tokens"))
    tok = vocab.explode_tokens(docs)
    matrix = checkpointed(weights.tfidf(docs, checkpointed(vocab.count_terms(docs))))
    curve = []
    for k in range(least, most + 1, step):
        found = factorize.factorize(matrix, k, o.method, o.threshold, o.rounds)
        c = coherence.c_v(docs, topics.top_words(found.h, o.words_per_topic)).agg(F.avg("c_v")).first()[0]
        curve.append((k, float(c if c is not None else 0.0)))
    return max(curve, key=lambda x: (x[1], -x[0]))[0], curve
