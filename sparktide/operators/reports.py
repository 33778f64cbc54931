"""Smaller results drawn from factors, similarities, merges and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from ..functions.text import slices
from .shared import checkpointed, top_n

#: Month names, abbreviations, some foreign ones, and seasons by their approximate month.
MONTHS = {
    **{m[:3]: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)},
    **{m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)},
    "sept": 9, "januar": 1, "janurary": 1, "abr": 4, "mai": 5, "avril": 4, "winter": 1, "spring": 4, "summer": 7, "autumn": 10, "fall": 10,
}


def month_number(month: Column) -> Column:
    """1 to 12 of a month's or season's name; of a range its first month; NULL if unknown."""
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.try_element_at(table, F.trim(F.element_at(F.split(F.lower(F.trim(month)), "-"), 1)))


def rank_range(m: Column, n: Column, inner: Column) -> tuple[Column, Column]:
    """Bounds of the number of topics from (m + n)^2 + 4 inner, inner being m n or the number of non-zeros."""
    root = F.sqrt((m + n) * (m + n) + 4 * inner)
    a, b = F.ceil((root - (m + n)) / 2), F.ceil((-root - (m + n)) / 2)
    return F.greatest(F.least(a, b), F.lit(0)), F.greatest(F.greatest(a, b), F.lit(2))


def recommendation(curve: DataFrame) -> DataFrame:
    """One row of (k, score, is_optimal, is_elbow): the best k and its score, and the elbow with its score where it is another k."""
    best = curve.where("is_optimal").select(F.col("k").alias("topics"), F.col("score").alias("coherence"))
    bend = curve.where("is_elbow").select(F.col("k").alias("other"), F.col("score").alias("other_score"))
    j = best.join(F.broadcast(bend), F.lit(True), "left")  # one row each
    differs = F.col("other") != F.col("topics")
    return j.select("topics", "coherence", F.when(differs, F.col("other")).alias("alternative"), F.when(differs, F.col("other_score")).alias("alternative_coherence"))


def column_peaks(s: DataFrame) -> DataFrame:
    """(rank, j, i, value): each column's largest value and its row (the first of equals), highest values first, then the later column."""
    w = Window.partitionBy("j").orderBy(F.desc("value"), "i")
    best = s.withColumn("n", F.row_number().over(w)).where("n = 1").select("j", "i", "value")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), F.desc("j"))))  # one row a topic


def link_statistics(s: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row: size, sum of all values, links above the threshold off the diagonal, their density in percent, their mean, and the largest value."""
    link = (F.col("i") != F.col("j")) & (F.col("value") > threshold)
    n = F.countDistinct("i")
    return s.agg(n.alias("topics"), F.sum("value").alias("total"), F.count_if(link).alias("links"), F.max("value").alias("strongest"), F.avg(F.when(link, F.col("value"))).alias("mean_link")).withColumn(
        "density", 100 * F.col("links") / (F.col("topics") * (F.col("topics") - 1))
    )


def strongest_links(s: DataFrame, threshold: float = 0.0, n: int = 5) -> DataFrame:
    """(rank, source, target, value, percent): the n largest links off the diagonal, column to row, and their percentage of the sum of all values."""
    whole = s.withColumn("total", F.sum("value").over(Window.partitionBy()))  # k x k values
    links = whole.where((F.col("i") != F.col("j")) & (F.col("value") > threshold)).orderBy(F.desc("value"), "i", "j").limit(n)
    return links.select(F.row_number().over(Window.orderBy(F.desc("value"), "i", "j")).alias("rank"), F.col("j").alias("source"), F.col("i").alias("target"), "value", F.when(F.col("total") > 0, 100 * F.col("value") / F.col("total")).otherwise(0.0).alias("percent"))


def topic_summary(dominant: DataFrame, certainty: DataFrame) -> DataFrame:
    """(topic_id, n_docs, percent, mean_certainty, sure, unsure): documents by dominant topic; sure above 0.8, unsure below 0.3."""
    d = dominant.join(certainty, "doc_id", "left").groupBy("topic_id").agg(F.count("*").alias("n_docs"), F.avg("certainty").alias("mean_certainty"), F.count_if(F.col("certainty") > 0.8).alias("sure"), F.count_if(F.col("certainty") < 0.3).alias("unsure"))
    return d.withColumn("percent", 100 * F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy()))  # one row a topic


def time_points(times: DataFrame, periods: int = 6) -> DataFrame:
    """(n, point): evenly spaced points from the first to the last time; years if they span more than two, else dates."""
    span = times.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).where("a IS NOT NULL")
    at = span.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("n"))
    lo, hi = F.unix_micros(F.col("a").cast("timestamp")), F.unix_micros(F.col("b").cast("timestamp"))
    t = F.timestamp_micros((lo + (hi - lo) * (F.col("n") - 1) / max(1, periods - 1)).cast("bigint"))
    days = F.floor((hi - lo) / F.lit(86_400_000_000))
    return at.select("n", F.when(days / 365.25 > 2, F.year(t).cast("string")).otherwise(F.date_format(t, "yyyy-MM-dd")).alias("point"))


def until(rows: DataFrame, time: Column, point: Column, cumulative: bool = True) -> DataFrame:
    """Rows up to a point in time, or of it alone."""
    return rows.where(time <= point if cumulative else time == point)


def merge_info(merges: DataFrame, vocabulary_size: int) -> DataFrame:
    """One row of merges (rank, w1, w2, freq): vocabulary sizes before and after, and the first ten merges by rank."""
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", F.concat_ws("_", "w1", "w2").alias("name"))))), 1, 10), lambda x: x["name"])
    return merges.agg(F.lit(vocabulary_size).cast("bigint").alias("original_size"), (F.lit(vocabulary_size) + F.count("*")).alias("final_size"), F.count("*").alias("merges"), first.alias("first_merges"))


def displayed(tok: DataFrame) -> DataFrame:
    """Tokens as they are shown: without continuations of word pieces (##...)."""
    return tok.where(~F.col("term").startswith("##"))


def escape_js(text: Column) -> Column:
    """Text that can stand in a JavaScript string literal: backslashes, both quotes, line feeds and returns escaped."""
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def topic_names(markdown: Column, label: str = "Konu") -> Column:
    """Map of 'Topic n' to the name that follows '- **<label> n:**' in a markdown text."""
    item = rf"-\s*\*\*{label}\s+(\d+):\*\*\s*((?s:.+?))(?=\n\s*\n|-\s*\*\*{label}|\z)"
    number, name = F.regexp_extract_all(markdown, F.lit(item), 1), F.regexp_extract_all(markdown, F.lit(item), 2)
    return F.map_from_arrays(F.transform(number, lambda n: F.concat(F.lit("Topic "), n)), F.transform(F.arrays_zip(number.alias("n"), name.alias("d")), lambda x: F.concat(F.lit(f"{label} "), x["n"], F.lit(": "), F.btrim(x["d"], F.lit(" \n\r\t")))))


def js_distance(sim: DataFrame) -> DataFrame:
    """(i, j, distance): the Jensen-Shannon distance to base 2 of topic_similarity's pairs, in 0 to 1."""
    return sim.select("i", "j", F.sqrt(F.greatest(1 - F.col("js"), F.lit(0.0)) / F.log(F.lit(2.0))).alias("distance"))


def dot_products(vectors: DataFrame) -> DataFrame:
    """(i, j, dot) of topic vectors (topic_id, term, w), i < j; pairs without a common term are left out."""
    a, b = vectors.select(F.col("topic_id").alias("i"), "term", F.col("w").alias("a")), vectors.select(F.col("topic_id").alias("j"), "term", F.col("w").alias("b"))
    return a.join(b, "term").where("i < j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, n): how many values lie in each of `bins` equal parts of 0 to 1; 1 belongs to the last."""
    return df.groupBy(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def extreme_pairs(sim: DataFrame, score: str, n: int = 3) -> DataFrame:
    """(kind, rank, i, j, score): the n most similar and the n most diverse pairs."""
    out = None
    for kind, order in (("similar", F.desc(score)), ("diverse", F.asc(score))):
        x = sim.withColumn("rank", F.row_number().over(Window.orderBy(order, "i", "j"))).where(F.col("rank") <= n)  # pairs of topics
        x = x.select(F.lit(kind).alias("kind"), "rank", "i", "j", F.col(score).alias("score"))
        out = x if out is None else out.unionByName(x)
    return out


def token_table(h: DataFrame, w: DataFrame) -> DataFrame:
    """(term, topic_id, share): how a term's expected frequency is spread over the topics."""
    p = h.withColumn("p", F.col("weight") / (F.sum("weight").over(Window.partitionBy("topic_id")) + 1e-10))
    sizes = w.groupBy("topic_id").agg(F.sum("weight").alias("size"))
    f = p.join(F.broadcast(sizes), "topic_id").withColumn("f", F.col("p") * F.col("size"))  # one row a topic
    return f.withColumn("share", F.col("f") / F.nullif(F.sum("f").over(Window.partitionBy("term")), F.lit(0.0))).where("f > 0").select("term", "topic_id", "share")


def by_size(w: DataFrame) -> DataFrame:
    """(topic_id, place, share): topics by falling total weight."""
    s = w.groupBy("topic_id").agg(F.sum("weight").alias("size"))
    return s.select("topic_id", F.row_number().over(Window.orderBy(F.desc("size"), "topic_id")).alias("place"), (F.col("size") / F.sum("size").over(Window.partitionBy())).alias("share"))


def words_from_relevance(relevance: DataFrame, n: int = 10) -> DataFrame:
    """(topic_id, rank, term, score): the n most relevant words of each topic; scores have 4 decimals."""
    r = relevance.withColumn("score", F.round("relevance", 4))
    return top_n(r, ["topic_id"], [F.desc("score"), "term"], n).select("topic_id", "rank", "term", "score")


def word_topic_matrix(words: DataFrame, topics: int) -> DataFrame:
    """(term, topic_1, ..., topic_k): each word's score in the topics that list it, NULL elsewhere."""
    return words.groupBy("term").agg(*[F.max(F.when(F.col("topic_id") == t, F.col("score"))).alias(f"topic_{t}") for t in range(1, topics + 1)])


def error_and_sparsity(v: DataFrame, w: DataFrame, h: DataFrame, squared_error: Column | float) -> DataFrame:
    """One row: mean squared error over all cells, and the shares of zeros in W and H."""
    a = w.agg(F.countDistinct("doc_id").alias("n_docs"), F.avg((F.col("weight") == 0).cast("double")).alias("w_sparsity"))
    b = h.agg(F.countDistinct("term").alias("n_terms"), F.avg((F.col("weight") == 0).cast("double")).alias("h_sparsity"))
    error = squared_error if isinstance(squared_error, Column) else F.lit(squared_error)
    return a.join(F.broadcast(b)).select((error / (F.col("n_docs") * F.col("n_terms"))).alias("mse"), "w_sparsity", "h_sparsity")


def polar_positions(w: DataFrame, k: int, best: int = 3) -> DataFrame:
    """(doc_id, x, y): the mean of the directions of a document's `best` topics, weighted by their shares, at max(2.5, 0.3 k) times the root of its length."""
    share = w.withColumn("p", F.col("weight") / F.nullif(F.sum("weight").over(Window.partitionBy("doc_id")), F.lit(0.0)))
    few = top_n(share.where("p > 0"), ["doc_id"], [F.desc("p"), "topic_id"], best)
    angle = 2 * F.pi() * (F.col("topic_id") - 1) / k
    m = few.groupBy("doc_id").agg(F.sum(F.col("p") * F.cos(angle)).alias("cx"), F.sum(F.col("p") * F.sin(angle)).alias("cy"))
    length = F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"))
    r = F.lit(max(2.5, 0.3 * k)) * F.sqrt(length)
    return m.select("doc_id", (r * F.col("cx") / F.nullif(length, F.lit(0.0))).alias("x"), (r * F.col("cy") / F.nullif(length, F.lit(0.0))).alias("y"))


def circular_layout(k: int, spark) -> DataFrame:
    """(topic_id, x, y): topics evenly on the unit circle."""
    t = spark.range(1, k + 1).select(F.col("id").cast("int").alias("topic_id"))
    angle = 2 * F.pi() * (F.col("topic_id") - 1) / k
    return t.select("topic_id", F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def word_similarity(pairs: DataFrame) -> DataFrame:
    """(a, b) with jaro_winkler, indel ratio and weighted edit distance (insert and delete 2, substitute 1); for the few words of topics."""

    def run(parts):
        for p in parts:
            z = list(zip(p["a"], p["b"], strict=True))
            yield p.assign(jaro_winkler=[strings.jaro_winkler(*x) for x in z], ratio=[strings.indel_ratio(*x) for x in z], distance=[strings.weighted_distance(*x) for x in z])

    return pairs.select("a", "b").mapInPandas(run, "a string, b string, jaro_winkler double, ratio double, distance int")


def pca(vectors: DataFrame, dims: int = 2) -> DataFrame:
    """(id, x1, ..., xd) of (id, v ARRAY<DOUBLE>): principal components by the distributed solver; each component's first loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("id", array_to_vector("v").alias("v"))
    model = PCA(k=dims, inputCol="v", outputCol="x").fit(v)
    load = model.pc.toArray()
    sign = [1.0 if load[:, i][abs(load[:, i]) > 1e-12][0] > 0 else -1.0 for i in range(dims)]
    x = model.transform(v).select("id", vector_to_array("x").alias("x"))
    return x.select("id", *[(F.col("x")[i] * sign[i]).alias(f"x{i + 1}") for i in range(dims)])


def representatives(points: DataFrame, per_topic: int = 20, seed: int = 42) -> DataFrame:
    """points (doc_id, topic_id, x, y) nearest to the centers of k-means by topic: at most per_topic of each topic; k-means runs distributed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    out = None
    for t in sorted(r[0] for r in points.select("topic_id").distinct().collect()):  # topics are few
        p = VectorAssembler(inputCols=["x", "y"], outputCol="v").transform(points.where(F.col("topic_id") == t))
        model = KMeans(k=per_topic, seed=seed, featuresCol="v", predictionCol="c").fit(p)
        centers = points.sparkSession.createDataFrame([(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())], "c int, cx double, cy double")
        near = model.transform(p).join(F.broadcast(centers), "c").withColumn("d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
        own = top_n(near, ["c"], ["d", "doc_id"], 1).select("doc_id", "topic_id", "x", "y")
        out = own if out is None else out.unionByName(own)
    return out


def lda_topics(counts: DataFrame, k: int = 5, rounds: int = 20, n: int = 15, seed: int = 42) -> DataFrame:
    """(topic_id, rank, term, score): the baseline of latent Dirichlet allocation (online, offset 50) on counts (doc_id, term, tf)."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    # each round of the optimizer reads the vectors again, so words are gathered once and vectors made once
    bags = checkpointed(counts.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))).alias("tokens")))
    terms = counts.select("term").distinct().count()
    vec = CountVectorizer(inputCol="tokens", outputCol="v", vocabSize=terms).fit(bags)
    model = LDA(k=k, maxIter=rounds, optimizer="online", learningOffset=50.0, seed=seed, featuresCol="v").fit(checkpointed(vec.transform(bags).select("doc_id", "v")))
    rows = [(t.topic + 1, r, vec.vocabulary[i], float(x)) for t in model.describeTopics(n).collect() for r, (i, x) in enumerate(zip(t.termIndices, t.termWeights, strict=True), 1)]
    return counts.sparkSession.createDataFrame(rows, "topic_id int, rank int, term string, score double")


def subword_ids(docs: DataFrame, tokenizer_file: str, text: str = "text") -> DataFrame:
    """(doc_id, ids) by the tokenizer of a file (.json of the tokenizers library, or .model of sentencepiece); files are never trained here.

    NULL texts give NULL, empty ones no ids; texts are encoded whole, a slice of a batch at a time, as each subword is an object of some hundred bytes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        if tokenizer_file.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file)
            encode = lambda ts: model.encode(ts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(tokenizer_file)
            model.encode_special_tokens = True
            encode = lambda ts: [e.ids for e in model.encode_batch(ts, add_special_tokens=False)]
        for b in batches:
            for lo, hi in slices(b.column(1)):
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                ids = iter(encode([t for t in texts if t is not None]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([None if t is None else list(next(ids)) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def subword_names(ids: DataFrame) -> DataFrame:
    """(doc_id, pos, term): a name for each subword id, [SUBWORD_i], so that what works on words works on them."""
    return ids.select("doc_id", F.posexplode("ids").alias("p", "i")).select("doc_id", (F.col("p") + 1).alias("pos"), F.concat(F.lit("[SUBWORD_"), F.col("i"), F.lit("]")).alias("term"))


def topic_prompt(words: DataFrame, n: int = 15) -> DataFrame:
    """(topic_id, prompt): a request to name a topic, with its first words and their scores."""
    line = F.concat(F.col("rank"), F.lit(". "), F.col("term"), F.lit(" ("), F.format_number("score", 4), F.lit(")"))
    lists = words.where(F.col("rank") <= n).groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return lists.select("topic_id", F.concat(F.lit("Name topic "), F.col("topic_id"), F.lit(" by its most important words:\n"), F.col("lines")).alias("prompt"))
