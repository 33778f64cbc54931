"""Queries: input rows, cleaning, vocabulary, n-grams, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rows as R
from ..operators import vocab as V
from ..operators import weights as G
from .base import counted, FREQ, LEN, PAIRS, TF, TOK, documents, out, table, tok, tokenized
from .registry import query

# input rows


@query("doc_dedup", "SELECT text, lang, min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def _(s, d):
    return R.drop_repeated_rows(documents(s, d).select("text", "lang", "doc_id"), ["text", "lang"], "doc_id")


@query("doc_distinct_rows", "SELECT DISTINCT text, lang FROM documents")
def _(s, d):
    return documents(s, d).select("text", "lang").distinct()


@query("doc_null_stats", """WITH j AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'doc_id' AS column_name, count(*) FILTER (WHERE doc_id IS NULL) AS nulls, count(*) AS total FROM j UNION ALL
SELECT 'quality', count(*) FILTER (WHERE quality IS NULL), count(*) FROM j UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL), count(*) FROM j""")
def _(s, d):
    return out(R.null_counts(documents(s, d).select("doc_id").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")))


@query("doc_dropna", "SELECT d.doc_id, l.quality::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def _(s, d):
    return out(documents(s, d).select("doc_id").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "quality").dropna("any"))


@query("filter_country_ci", "SELECT n_nationkey, n_name FROM nation WHERE upper(n_name) = upper('nation_7')")
def _(s, d):
    return R.filter_equal_ci(table(s, d, "nation"), "n_name", "nation_7").select("n_nationkey", "n_name")


@query("filter_exact", "SELECT doc_id, source FROM documents WHERE source = 'src3'")
def _(s, d):
    return R.filter_equal(documents(s, d), "source", "src3").select("doc_id", "source")


@query("filter_year", "SELECT o_orderkey, year(o_orderdate)::BIGINT AS year FROM orders WHERE year(o_orderdate) <= 1998")
def _(s, d):
    return out(R.filter_year(table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), "year", 1998))


@query("keep_columns", "SELECT text, n_chars FROM documents")
def _(s, d):
    return R.keep_columns(documents(s, d), "text", weight="n_chars")


_MONTH_CASES = " ".join(f"WHEN '{m}' THEN {i}" for m, i in R.MONTHS.items())


@query("year_month_to_ts", f"""WITH m AS (SELECT o_orderkey, year(o_orderdate) AS y, CASE o_orderkey % 5 WHEN 0 THEN 'Sept' WHEN 1 THEN '13' WHEN 2 THEN NULL WHEN 3 THEN 'march' ELSE (1 + o_orderkey % 12)::VARCHAR END AS m FROM orders)
SELECT o_orderkey, make_date(y, coalesce(CASE lower(m) {_MONTH_CASES} END, CASE WHEN try_cast(m AS INTEGER) BETWEEN 1 AND 12 THEN try_cast(m AS INTEGER) END, 1), 1)::TIMESTAMP AS ts FROM m""")
def _(s, d):
    k = F.col("o_orderkey")
    month = F.when(k % 5 == 0, "Sept").when(k % 5 == 1, "13").when(k % 5 == 2, None).when(k % 5 == 3, "march").otherwise((1 + k % 12).cast("string"))
    return table(s, d, "orders").select("o_orderkey", R.year_month_timestamp(F.year("o_orderdate"), month).cast("timestamp_ntz").alias("ts"))


@query("epoch_heuristic", """WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1900 + event_id % 200 WHEN 1 THEN epoch_us(ts) // 1000000 WHEN 2 THEN epoch_us(ts) // 1000 ELSE event_id END AS v FROM events)
SELECT event_id, CASE WHEN v BETWEEN 1900 AND 2100 THEN make_date(v::INTEGER, 1, 1)::TIMESTAMP WHEN v > 1000000000000 THEN make_timestamp(v * 1000) WHEN v > 1000000000 THEN make_timestamp(v * 1000000) END AS ts FROM v""")
def _(s, d):
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    v = F.when(i % 4 == 0, 1900 + i % 200).when(i % 4 == 1, F.unix_seconds(ts)).when(i % 4 == 2, F.unix_millis(ts)).otherwise(i)
    return table(s, d, "events").select("event_id", R.epoch_timestamp(v).cast("timestamp_ntz").alias("ts"))


@query("pagerank_weight", "SELECT o_orderkey, round(1 + (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS weight FROM orders")
def _(s, d):
    return out(R.rank_weight(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "weight"))


@query("pagerank_constant", "SELECT o_orderkey, 1.5::DOUBLE AS weight FROM orders")
def _(s, d):
    return R.rank_weight(table(s, d, "orders").select("o_orderkey", F.lit(3.0).alias("p")), "p").select("o_orderkey", "weight")


@query("outlier_points", """WITH p AS (SELECT o_orderkey AS id, o_totalprice AS x, (o_custkey % 997)::DOUBLE AS y FROM orders), m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM p),
d AS (SELECT id, sqrt(pow(x - mx, 2) + pow(y - my, 2)) AS d FROM p, m) SELECT id FROM d WHERE d <= (SELECT quantile_cont(d, 0.95) FROM d)""")
def _(s, d):
    return R.drop_far_points(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 997).cast("double").alias("y"))).select("id")


@query("join_exact_text", "SELECT DISTINCT b.doc_id AS item_id, d.doc_id FROM documents d JOIN documents b ON d.text = b.text AND b.source = 'src3'")
def _(s, d):
    wanted = documents(s, d).where("source = 'src3'").select(F.col("doc_id").alias("item_id"), "text")
    return documents(s, d).join(wanted, "text").select("item_id", "doc_id").distinct()


@query("anti_join_text", "SELECT b.item_id FROM benchmark b LEFT JOIN documents d ON d.text = b.text WHERE d.text IS NULL")
def _(s, d):
    return table(s, d, "benchmark").join(documents(s, d), "text", "left_anti").select("item_id")


# cleaning


@query("clean_tokens", f"WITH {TOK} SELECT doc_id, pos, term FROM tok")
def _(s, d):
    return out(tok(s, d))


@query("doc_statistics", f"WITH {LEN} SELECT count(*) AS n_docs, count(*) FILTER (WHERE len = 0) AS n_empty, sum(len)::BIGINT AS n_tokens, max(len) AS longest FROM lens")
def _(s, d):
    n = F.size("tokens")
    return out(tokenized(s, d).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(n == 0).alias("n_empty"), F.sum(n).alias("n_tokens"), F.max(n).alias("longest")))


@query("xx_removal", "SELECT doc_id, len(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: regexp_matches(w, '^x{2,}$'))) AS n_xx FROM documents")
def _(s, d):
    w = F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")
    return out(documents(s, d).select("doc_id", F.size(F.filter(w, lambda x: x.rlike("^x{2,}$"))).alias("n_xx")))


@query("has_emoji", "SELECT doc_id, regexp_matches(text, '[\\x{10000}-\\x{10FFFF}]') AS emoji FROM documents")
def _(s, d):
    return documents(s, d).select("doc_id", X.has_emoji(F.col("text")).alias("emoji"))


@query("turkish_lower", "SELECT doc_id, lower(translate(text, 'İĞŞÜÖÇ', 'iğşüöç')) AS t FROM documents")
def _(s, d):
    return documents(s, d).select("doc_id", X.turkish_lower(F.col("text")).alias("t"))


@query("clean_turkish")
def _(s, d):
    return documents(s, d).select("doc_id", X.clean_turkish(F.col("text")).alias("t"))


@query("join_suffix", "SELECT event_id, regexp_replace(event_type || ' ' || event_id || ' gb', '(\\d+)\\s+(gb)\\b', '\\1\\2', 'g') AS t FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", X.join_suffix(F.concat_ws(" ", "event_type", "event_id", F.lit("gb"))).alias("t"))


@query("sanitize_text", "SELECT doc_id, replace(replace(text, chr(10), ''), '\"', '') AS t FROM documents")
def _(s, d):
    return documents(s, d).select("doc_id", X.sanitize(F.col("text")).alias("t"))


@query("topic_labels", "SELECT n_nationkey, 'Topic ' || lpad(n_nationkey::VARCHAR, 2, '0') AS label FROM nation")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", X.topic_label(F.col("n_nationkey")).alias("label"))


@query("parse_scored", """WITH x AS (SELECT doc_id, text || ':' || round((doc_id % 97) / 8.0::DOUBLE, 3)::VARCHAR AS t FROM documents),
y AS (SELECT doc_id, regexp_replace(t, ':[^:]*$', '') AS b, regexp_extract(t, ':([^:]*)$', 1)::DOUBLE AS score FROM x)
SELECT doc_id, CASE WHEN length(b) > 200 THEN substr(b, 1, 200) || '...' ELSE b END AS text, score FROM y""")
def _(s, d):
    t, score = X.split_scored(F.concat("text", F.lit(":"), F.round(F.col("doc_id") % 97 / 8.0, 3).cast("string")))
    return documents(s, d).select("doc_id", t.alias("text"), score.alias("score"))


@query("stemmed_tokens")
def _(s, d):
    from ..functions.strings import stem_words

    return tokenized(s, d).select("doc_id", stem_words("tokens").alias("tokens"))


@query("lemmatized_tokens")
def _(s, d):
    from ..functions.strings import lemmatize_words

    return tokenized(s, d).select("doc_id", lemmatize_words("tokens").alias("tokens"))


# vocabulary


@query("vocab_ids", f"WITH {TOK} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (SELECT DISTINCT term FROM tok)")
def _(s, d):
    return out(V.vocabulary(tok(s, d)))


@query("encode_oov", f"WITH {TOK}, v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (SELECT DISTINCT term FROM tok WHERE doc_id % 2 = 0)) SELECT doc_id, pos, coalesce(term_id, 0) AS term_id FROM tok LEFT JOIN v USING (term)")
def _(s, d):
    t = tok(s, d)
    return out(V.encode(t, V.vocabulary(t.where("doc_id % 2 = 0"))))


@query("token_freq", f"WITH {FREQ} SELECT term, f AS freq FROM freq")
def _(s, d):
    return V.token_frequency(tok(s, d))


@query("doc_freq", f"WITH {TF} SELECT term, df FROM dfs")
def _(s, d):
    return V.document_frequency(counted(s, d))


@query("term_counts", f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def _(s, d):
    return counted(s, d)


@query("inverted_index", f"WITH {TOK} SELECT term, list_sort(list_distinct(list(doc_id))) AS docs FROM tok GROUP BY term")
def _(s, d):
    return V.inverted_index(tok(s, d))


_KEYS = "SELECT CASE o_orderkey % 4 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN 'covid_' || o_orderkey WHEN 2 THEN '12_' || o_orderkey ELSE o_orderpriority END AS term FROM orders"


@query("pure_number_filter", f"WITH k AS ({_KEYS}) SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (SELECT DISTINCT term FROM k WHERE NOT regexp_matches(term, '^[0-9]+(_[0-9]+)*$'))")
def _(s, d):
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit("covid_"), k)).when(k % 4 == 2, F.concat(F.lit("12_"), k)).otherwise(F.col("o_orderpriority"))
    return out(V.drop_pure_numbers(table(s, d, "orders").select(name.alias("term"))))


@query("pair_freq", f"WITH {PAIRS} SELECT w1, w2, freq FROM pairs")
def _(s, d):
    return V.pair_counts(tok(s, d))


_PMI = PAIRS + """, pmi AS (SELECT w1, w2, p.freq, log2((p.freq / (SELECT sum(freq) FROM pairs)::DOUBLE) / ((a.f / (SELECT sum(f) FROM freq)::DOUBLE) * (b.f / (SELECT sum(f) FROM freq)::DOUBLE))) AS pmi
FROM pairs p JOIN freq a ON a.term = w1 JOIN freq b ON b.term = w2)"""


@query("pair_pmi", f"WITH {_PMI} SELECT w1, w2, freq, round(pmi, 6) AS pmi FROM pmi")
def _(s, d):
    t = tok(s, d)
    return out(V.pair_pmi(V.pair_counts(t), V.token_frequency(t)))


@query("wp_likelihood", f"WITH {PAIRS} SELECT w1, w2, p.freq, round(p.freq / ((a.f + 1e-10) * (b.f + 1e-10)), 6) AS score FROM pairs p JOIN freq a ON a.term = w1 JOIN freq b ON b.term = w2")
def _(s, d):
    t = tok(s, d)
    return out(V.pair_likelihood(V.pair_counts(t), V.token_frequency(t)))


@query("best_pair", f"WITH {PAIRS} SELECT w1, w2, freq FROM pairs WHERE freq >= 2 ORDER BY freq DESC, w1, w2 LIMIT 1")
def _(s, d):
    return V.best_pair(V.pair_counts(tok(s, d)))


@query("best_pair_pmi", f"WITH {_PMI} SELECT w1, w2, freq FROM pmi WHERE freq >= 2 ORDER BY round(pmi * log2(freq + 1), 9) DESC, w1, w2 LIMIT 1")
def _(s, d):
    t = tok(s, d)
    return V.best_pair(V.pair_pmi(V.pair_counts(t), V.token_frequency(t)), F.round(F.col("pmi") * F.log2(F.col("freq") + 1), 9)).select("w1", "w2", "freq")


def _merge_sql(rounds: int) -> str:
    parts = [TOK, "t0 AS (SELECT doc_id, string_agg('<' || term || '>', '' ORDER BY pos) AS t FROM tok GROUP BY doc_id)"]
    for i in range(rounds):
        parts.append(f"x{i} AS (SELECT doc_id, unnest(string_split(substr(t, 2, length(t) - 2), '><')) AS term, generate_subscripts(string_split(substr(t, 2, length(t) - 2), '><'), 1) AS pos FROM t{i})")
        parts.append(f"b{i} AS MATERIALIZED (SELECT w1, w2 FROM (SELECT term AS w1, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM x{i}) WHERE w2 IS NOT NULL GROUP BY w1, w2 HAVING count(*) >= 2 ORDER BY count(*) DESC, w1, w2 LIMIT 1)")
        parts.append(f"t{i + 1} AS (SELECT doc_id, replace(t, '<' || w1 || '><' || w2 || '>', '<' || w1 || '_' || w2 || '>') AS t FROM t{i}, b{i})")
    return f"WITH {', '.join(parts)} SELECT doc_id, replace(substr(t, 2, length(t) - 2), '><', ' ') AS t FROM t{rounds}"


def _merged(s, d, rounds):
    docs, _ = V.fit_merges(tokenized(s, d), rounds)
    return docs.where(F.size("tokens") > 0).select("doc_id", F.array_join("tokens", " ").alias("t"))


@query("bpe_merge_1", _merge_sql(1))
def _(s, d):
    return _merged(s, d, 1)


@query("bpe_merge_3", _merge_sql(3))
def _(s, d):
    return _merged(s, d, 3)


@query("bpe_merge_pmi")
def _(s, d):
    _, done = V.fit_merges(tokenized(s, d), 3, use_pmi=True)
    return s.createDataFrame(done, "rank int, w1 string, w2 string, freq bigint")


@query("wordpiece_merge")
def _(s, d):
    _, done = V.fit_merges(tokenized(s, d), 3, method="wordpiece")
    return s.createDataFrame(done, "rank int, w1 string, w2 string, freq bigint")


@query("auto_ngram", f"WITH {FREQ} SELECT greatest(10, floor(sqrt(count(*)) * 0.5))::BIGINT AS n FROM freq")
def _(s, d):
    return out(V.token_frequency(tok(s, d)).agg(F.count(F.lit(1)).alias("v")).select(V.auto_ngram_count(F.col("v")).alias("n")))


@query("ngram_names_recursive", """WITH RECURSIVE v AS (SELECT n_nationkey AS id, n_name AS name FROM nation), m AS (SELECT 25 + n_nationkey AS new_id, CASE WHEN n_nationkey = 0 THEN 0 ELSE 24 + n_nationkey END AS a, n_nationkey AS b FROM nation WHERE n_nationkey < 10),
r AS (SELECT id, name FROM v UNION SELECT m.new_id, r.name || '_' || v.name FROM m JOIN r ON r.id = m.a JOIN v ON v.id = m.b) SELECT id, name FROM r""")
def _(s, d):
    n = table(s, d, "nation")
    key = F.col("n_nationkey")
    m = n.where(key < 10).select((25 + key).alias("new_id"), F.when(key == 0, F.lit(0)).otherwise(24 + key).alias("a"), key.alias("b"))
    return out(V.merge_names(m, n.select(key.alias("term_id"), F.col("n_name").alias("term"))))


# weights


def _weight_sql(w: str, cte: str = TF, source: str = "tf") -> str:
    return f"WITH {cte} SELECT doc_id, term, round({w}, 6) AS w FROM {source}"


for _scheme, _w in {
    "augmented": "0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY doc_id)",
    "binary": "1.0::DOUBLE",
    "double_log": "1 + log2(1 + log2(tf))",
    "log": "1 + log2(tf)",
    "log_ratio": "(1 + log2(tf)) / (1 + log2((1 + sum(tf) OVER (PARTITION BY doc_id))::DOUBLE / (1 + count(*) OVER (PARTITION BY doc_id))))",
}.items():
    query(f"tf_{_scheme}", _weight_sql(_w))(lambda s, d, k=_scheme: out(G.tf_weight(counted(s, d), k)))


@query("idf_all", f"""WITH {LEN} SELECT term, df, round(log2(n / df::DOUBLE) + 1, 6) AS plain, round(log2((1 + n) / df::DOUBLE), 6) AS smooth, round(log2((n - df + 1) / (df + 1)::DOUBLE), 6) AS prob,
round(log2((n - df + 0.5) / (df + 0.5)), 6) AS bm25 FROM dfs, stats""")
def _(s, d):
    t = V.document_frequency(counted(s, d)).crossJoin(F.broadcast(documents(s, d).agg(F.count(F.lit(1)).alias("n"))))
    return out(t.select("term", "df", *[G.idf(F.col("df"), F.col("n"), k).alias(k) for k in ("plain", "smooth", "prob", "bm25")]))


_PIVOT = "(0.8 + 0.2 * len / avg_len)"
_JOINED = "tf JOIN dfs USING (term) JOIN lens USING (doc_id), stats"


@query("pivot_norm", f"WITH {LEN} SELECT doc_id, len, round({_PIVOT}, 6) AS norm FROM lens, stats")
def _(s, d):
    docs = documents(s, d)
    x = G.document_lengths(docs, counted(s, d))
    return out(x.select("doc_id", "len", G.pivot_norm(F.col("len"), F.col("avg_len")).alias("norm")))


@query("tfidf_en", f"WITH {LEN} SELECT doc_id, term, round(log2((1 + n) / df::DOUBLE) / {_PIVOT}, 6) AS w FROM {_JOINED}")
def _(s, d):
    return out(G.tfidf(documents(s, d), counted(s, d)))


@query("tfidf_tr_formula", f"WITH {LEN}, x AS (SELECT doc_id, term, log2((n - df + 1) / (df + 1)::DOUBLE) / {_PIVOT} AS w FROM {_JOINED}) SELECT doc_id, term, round(w, 6) AS w FROM x WHERE w <> 0")
def _(s, d):
    return out(G.tfidf(documents(s, d), counted(s, d), idf_scheme="prob"))


@query("tfidf_log_tf", f"WITH {LEN} SELECT doc_id, term, round((1 + log2(tf)) * log2((1 + n) / df::DOUBLE), 6) AS w FROM {_JOINED}")
def _(s, d):
    return out(G.tfidf(documents(s, d), counted(s, d), tf_scheme="log", slope=-1))


@query("pagerank_tfidf", f"WITH {LEN} SELECT doc_id, term, round(log2((1 + n) / df::DOUBLE) / {_PIVOT} * (1 + doc_id % 17), 6) AS w FROM {_JOINED}")
def _(s, d):
    docs = documents(s, d)
    return out(G.tfidf(docs, counted(s, d), weights=docs.select("doc_id", (1 + F.col("doc_id") % 17).alias("weight"))))


_BM25 = "log2((n - df + 0.5) / (df + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len / avg_len))"


@query("bm25", f"""WITH {TF}, lens AS (SELECT d.doc_id, coalesce(l.len, 0) AS len FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS len FROM tf GROUP BY doc_id) l USING (doc_id)),
stats AS (SELECT avg(len) AS avg_len, count(*) AS n FROM lens) SELECT doc_id, term, round({_BM25.format(tf='1')}, 6) AS w FROM {_JOINED}""")
def _(s, d):
    return out(G.bm25(documents(s, d), counted(s, d)))


@query("bm25_counts", f"WITH {LEN} SELECT doc_id, term, round({_BM25.format(tf='tf')}, 6) AS w FROM {_JOINED}")
def _(s, d):
    return out(G.bm25(documents(s, d), counted(s, d), binary=False))


@query("matrix_stats", f"""WITH {TF}, a AS (SELECT count(DISTINCT doc_id) AS n_docs FROM documents), b AS (SELECT count(DISTINCT term) AS n_terms, count(*) AS nnz FROM tf)
SELECT n_docs, n_terms, nnz, round(nnz / (n_docs * n_terms)::DOUBLE, 6) AS density, floor(nnz / (n_docs + n_terms)::DOUBLE)::BIGINT AS max_rank FROM a, b""")
def _(s, d):
    return out(G.matrix_stats(documents(s, d), counted(s, d)))


@query("l2_rows", _weight_sql("tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id))"))
def _(s, d):
    return out(G.normalize(counted(s, d).withColumn("w", F.col("tf").cast("double")).drop("tf"), ["doc_id"]))
