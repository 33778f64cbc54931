"""Inputs that the queries share, as DataFrames and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stopwords import ENGLISH, sql_list
from ..operators import vocab
from ..operators.shared import checkpointed, ranked

_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_BASES = "aaaaaaceeeeiiiinooooouuuuyy"

TOK = f"""
cleaned AS (SELECT doc_id, regexp_replace(translate(regexp_replace(lower(text), '([{_MARKED}])', '\\1 ', 'g'), '{_MARKED}', '{_BASES}'), '[^\\p{{Ll}}]+', ' ', 'g') AS t FROM documents),
split AS (SELECT doc_id, unnest(string_split(t, ' ')) AS term, generate_subscripts(string_split(t, ' '), 1) AS p FROM cleaned),
tok AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS pos, term FROM split
  WHERE term <> '' AND NOT regexp_matches(term, '^x{{2,}}$') AND term NOT IN ({sql_list(ENGLISH)}))"""
TF = TOK + ", tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
LEN = TF + """, lens AS (SELECT d.doc_id, coalesce(l.len, 0) AS len FROM documents d LEFT JOIN (SELECT doc_id, sum(tf)::BIGINT AS len FROM tf GROUP BY doc_id) l USING (doc_id)),
stats AS (SELECT avg(len) AS avg_len, count(*) AS n FROM lens)"""
FREQ = TOK + ", freq AS (SELECT term, count(*) AS f FROM tok GROUP BY term)"
PAIRS = FREQ + """, pairs AS MATERIALIZED (SELECT w1, w2, count(*) AS freq FROM (SELECT term AS w1, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM tok) WHERE w2 IS NOT NULL GROUP BY w1, w2)"""
TOPICS = 5
W_SQL = f"w AS (SELECT doc_id, t::INTEGER AS topic_id, CASE WHEN doc_id % 50 = 0 THEN 0.0::DOUBLE ELSE ((doc_id * 7 + t * 13) % 11) / 10.0::DOUBLE END AS weight FROM documents, range(1, {TOPICS + 1}) r(t))"
#: Pseudo-factor of all terms: weights fall with the rank of their frequency, so topics share some of their first words.
H_SQL = FREQ + f""", ranked AS (SELECT term, row_number() OVER (ORDER BY f DESC, term) AS r FROM freq),
h AS (SELECT t::INTEGER AS topic_id, term, ((r * 5 + t * 3) % 23)::DOUBLE / (10 + r)::DOUBLE AS weight FROM ranked, range(1, {TOPICS + 1}) x(t))"""
S_SQL = "s AS (SELECT i::INTEGER AS i, j::INTEGER AS j, CASE WHEN j = 4 THEN 0.0::DOUBLE ELSE ((i * 3 + j * 7) % 10) / 10.0::DOUBLE END AS value FROM range(1, 6) a(i), range(1, 6) b(j))"
TIMES_SQL = "times AS (SELECT doc_id, TIMESTAMP '2015-01-01' + to_days((doc_id * 37 % 3650)::INTEGER) AS ts FROM documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens)."""
    return vocab.english_tokens(documents(spark, sf_dir))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, term, tf), cleaned and counted once and read from the shared folder however often it is used."""
    return checkpointed(vocab.count_english(documents(spark, sf_dir)))


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.explode_tokens(tokenized(spark, sf_dir))


def pseudo_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.lit(t) for t in range(1, TOPICS + 1)])).alias("topic_id"))
    return d.withColumn("weight", F.when(F.col("doc_id") % 50 == 0, 0.0).otherwise((F.col("doc_id") * 7 + F.col("topic_id") * 13) % 11 / 10.0))


def pseudo_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = vocab.count_english(documents(spark, sf_dir)).groupBy("term").agg(F.sum("tf").alias("freq"))
    h = ranked(freq, [F.desc("freq"), F.col("term")], "r").withColumn("topic_id", F.explode(F.array(*[F.lit(t) for t in range(1, TOPICS + 1)])))
    return h.select("topic_id", "term", ((F.col("r") * 5 + F.col("topic_id") * 3) % 23 / (10 + F.col("r"))).alias("weight"))


def pseudo_s(spark: SparkSession) -> DataFrame:
    s = spark.range(1, 6).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(1, 6).select(F.col("id").cast("int").alias("j")))
    return s.withColumn("value", F.when(F.col("j") == 4, 0.0).otherwise((F.col("i") * 3 + F.col("j") * 7) % 10 / 10.0))


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.timestamp_seconds(F.lit(1420070400) + F.col("doc_id") * 37 % 3650 * 86400).alias("ts"))


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as BIGINT and doubles rounded, as the SQL gives them."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.IntegerType):
            c = c.cast("array<bigint>")
        cols.append(c.alias(f.name))
    return df.select(*cols)
