"""Queries: the smaller results of operators.reports, each with the SQL that says the same where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import reports as R
from ..operators import rows, temporal
from ..operators import topics as P
from ..operators import vocab as V
from ..operators import weights as G
from .base import FREQ, H_SQL, S_SQL, TF, TIMES_SQL, TOPICS, W_SQL, counted, documents, out, pseudo_h, pseudo_s, pseudo_w, table, times, tok, tokenized
from .registry import query
from .topic_queries import _COUNTS, _DOM, _SIM, _TOP, _VEC, _dist, _sim

_MONTHS = ", ".join(f"('{k}', {v})" for k, v in R.MONTHS.items())
_NAMES = "['Jan-Feb', ' Sept ', 'winter', 'Mai', 'fall-2', 'June', 'x', '13', 'avril', 'Dec']"


@query("month_names", f"WITH m(k, v) AS (VALUES {_MONTHS}), o AS (SELECT o_orderkey, {_NAMES}[1 + o_orderkey % 10] AS name FROM orders) SELECT o_orderkey, v::BIGINT AS month FROM o LEFT JOIN m ON k = trim(string_split(lower(trim(name)), '-')[1])")
def _(s, d):
    names = F.array(*[F.lit(x.strip("'")) for x in _NAMES[1:-1].split(", ")])
    return out(table(s, d, "orders").select("o_orderkey", R.month_number(names[(F.col("o_orderkey") % 10).cast("int")]).alias("month")))


@query("first_datetime_column", "SELECT o_orderkey, 'timestamp' AS chosen, o_orderdate AS ts FROM orders")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("timestamp"), F.lit(1).alias("updated_at"))
    c = rows.first_datetime_column(o)
    return o.select("o_orderkey", F.lit(c).alias("chosen"), F.col(c).alias("ts"))


@query("rank_range", "WITH x AS (SELECT p_partkey, p_partkey::DOUBLE AS m, (p_size * 7 + 1)::DOUBLE AS n FROM part), r AS (SELECT p_partkey, m, n, sqrt((m + n) * (m + n) + 4 * m * n) AS root FROM x) SELECT p_partkey, greatest(least(ceil((root - (m + n)) / 2), ceil((-root - (m + n)) / 2)), 0)::BIGINT AS low, greatest(ceil((root - (m + n)) / 2), ceil((-root - (m + n)) / 2), 2)::BIGINT AS high FROM r")
def _(s, d):
    m, n = F.col("p_partkey").cast("double"), (F.col("p_size") * 7 + 1).cast("double")
    low, high = R.rank_range(m, n, m * n)
    return table(s, d, "part").select("p_partkey", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


_CURVE = "c AS (SELECT n_nationkey + 2 AS k, ((n_nationkey * 37) % 23) / 7.0::DOUBLE AS score FROM nation), x AS (SELECT k, score, abs(lead(score) OVER (ORDER BY k) - 2 * score + lag(score) OVER (ORDER BY k)) AS second FROM c)"


@query("recommendation", f"WITH {_CURVE}, b AS (SELECT * FROM x ORDER BY score DESC, k LIMIT 1), e AS (SELECT * FROM x ORDER BY second DESC NULLS LAST, k LIMIT 1) SELECT b.k AS topics, round(b.score, 6) AS coherence, CASE WHEN e.k <> b.k THEN e.k END AS alternative, CASE WHEN e.k <> b.k THEN round(e.score, 6) END AS alternative_coherence FROM b, e")
def _(s, d):
    return out(R.recommendation(P.elbow(table(s, d, "nation").select((F.col("n_nationkey") + 2).alias("k"), ((F.col("n_nationkey") * 37) % 23 / 7.0).alias("score")))))


@query("nmtf_column_peaks", f"WITH {S_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY value DESC, i) AS n FROM s) SELECT row_number() OVER (ORDER BY value DESC, j DESC) AS rank, i::BIGINT AS i, j::BIGINT AS j, value FROM b WHERE n = 1")
def _(s, d):
    return out(R.column_peaks(pseudo_s(s)))


@query("s_statistics", f"WITH {S_SQL}, a AS (SELECT count(DISTINCT i) AS topics, sum(value) AS total, count(*) FILTER (WHERE i <> j AND value > 0.2) AS links, max(value) AS strongest, avg(value) FILTER (WHERE i <> j AND value > 0.2) AS mean_link FROM s) SELECT topics, round(total, 6) AS total, links, strongest, round(mean_link, 6) AS mean_link, round(100 * links / (topics * (topics - 1))::DOUBLE, 6) AS density FROM a")
def _(s, d):
    return out(R.link_statistics(pseudo_s(s), 0.2))


@query("s_strongest", f"WITH {S_SQL} SELECT row_number() OVER (ORDER BY value DESC, i, j) AS rank, j::BIGINT AS source, i::BIGINT AS target, value, round(100 * value / (SELECT sum(value) FROM s), 6) AS percent FROM s WHERE i <> j AND value > 0.2 ORDER BY value DESC, i, j LIMIT 5")
def _(s, d):
    return out(R.strongest_links(pseudo_s(s), 0.2))


_CERT = "p AS (SELECT doc_id, weight / nullif(sum(weight) OVER (PARTITION BY doc_id), 0) AS p FROM w), cert AS (SELECT doc_id, 1 / (1 + sum(CASE WHEN p > 1e-10 THEN -p * ln(p) WHEN p IS NOT NULL THEN 0 END)) AS certainty FROM p GROUP BY doc_id)"


@query("topic_summary", f"WITH {_DOM}, {_CERT} SELECT topic_id, count(*) AS n_docs, round(avg(certainty), 6) AS mean_certainty, count(*) FILTER (WHERE certainty > 0.8) AS sure, count(*) FILTER (WHERE certainty < 0.3) AS unsure, round(100 * count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS percent FROM dom LEFT JOIN cert USING (doc_id) GROUP BY topic_id")
def _(s, d):
    w = pseudo_w(s, d)
    return out(R.topic_summary(P.dominant_topic(w), P.certainty(w)))


@query("time_points", "WITH a AS (SELECT epoch_us(min(o_orderdate)) AS lo, epoch_us(max(o_orderdate)) AS hi FROM orders) SELECT n, CASE WHEN ((hi - lo) // 86400000000) / 365.25 > 2 THEN year(make_timestamp((lo + (hi - lo) * (n - 1) / 5::DOUBLE)::BIGINT))::VARCHAR ELSE strftime(make_timestamp((lo + (hi - lo) * (n - 1) / 5::DOUBLE)::BIGINT), '%Y-%m-%d') END AS point FROM a, range(1, 7) r(n)")
def _(s, d):
    return out(R.time_points(table(s, d, "orders").select(F.col("o_orderdate").alias("ts"))))


@query("docs_until", f"WITH {_DOM}, {TIMES_SQL}, x AS (SELECT topic_id, year(ts) AS year FROM dom JOIN times USING (doc_id)), y AS (SELECT unnest([2016, 2018, 2020]) AS point) SELECT point::BIGINT AS point, topic_id, count(*) FILTER (WHERE year <= point) AS up_to, count(*) FILTER (WHERE year = point) AS within FROM x, y GROUP BY ALL")
def _(s, d):
    x = P.dominant_topic(pseudo_w(s, d)).join(times(s, d), "doc_id").select("topic_id", F.year("ts").alias("year"))
    x = x.withColumn("point", F.explode(F.array(*map(F.lit, (2016, 2018, 2020)))))
    a = R.until(x, F.col("year"), F.col("point")).select("point", "topic_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = R.until(x, F.col("year"), F.col("point"), cumulative=False).select("point", "topic_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    none = x.select("point", "topic_id", F.lit(0).alias("a"), F.lit(0).alias("b"))
    return out(a.unionByName(b).unionByName(none).groupBy("point", "topic_id").agg(F.sum("a").alias("up_to"), F.sum("b").alias("within")))


@query("ngram_info", f"WITH {TF}, m AS (SELECT n_nationkey + 1 AS rank, 'a' || n_nationkey AS w1, n_name AS w2 FROM nation), v AS (SELECT count(DISTINCT term) AS v FROM tf) SELECT v AS original_size, v + (SELECT count(*) FROM m) AS final_size, (SELECT count(*) FROM m) AS merges, (SELECT list(w1 || '_' || w2 ORDER BY rank) FROM m WHERE rank <= 10) AS first_merges FROM v")
def _(s, d):
    m = table(s, d, "nation").select((F.col("n_nationkey") + 1).alias("rank"), F.concat(F.lit("a"), F.col("n_nationkey")).alias("w1"), F.col("n_name").alias("w2"))
    return R.merge_info(m, counted(s, d).select("term").distinct().count())


@query("displayed_tokens", f"WITH {FREQ}, x AS (SELECT CASE WHEN length(term) % 3 = 0 THEN '##' || term ELSE term END AS term, f FROM freq) SELECT term, f FROM x WHERE NOT starts_with(term, '##')")
def _(s, d):
    f = V.token_frequency(tok(s, d))
    return R.displayed(f.select(F.when(F.length("term") % 3 == 0, F.concat(F.lit("##"), F.col("term"))).otherwise(F.col("term")).alias("term"), F.col("freq").alias("f")))


@query("escape_js", r"""SELECT doc_id, replace(replace(replace(replace(replace(text, '\', '\\'), '''', '\'''), '"', '\"'), chr(10), '\n'), chr(13), '\r') AS t FROM documents""")
def _(s, d):
    return documents(s, d).select("doc_id", R.escape_js(F.col("text")).alias("t"))


@query("names_from_markdown", "SELECT n_nationkey, 'Topic ' || (n_nationkey + 1) AS topic, 'Konu ' || (n_nationkey + 1) || ': ' || n_name AS name FROM nation UNION ALL SELECT n_nationkey, 'Topic 90', 'Konu 90: last of ' || n_name FROM nation")
def _(s, d):
    k = F.col("n_nationkey") + 1
    md = F.concat(F.lit("# Topics\n\n- **Konu "), k, F.lit(":** "), F.col("n_name"), F.lit("\n\n- **Konu 90:** last of "), F.col("n_name"), F.lit("\n"))
    return table(s, d, "nation").select("n_nationkey", F.explode(R.topic_names(md)).alias("topic", "name"))


@query("js_distance", f"WITH {_SIM} SELECT i::BIGINT AS i, j::BIGINT AS j, round(sqrt((1 - js) / ln(2)), 6) AS distance FROM sims")
def _(s, d):
    return out(R.js_distance(_sim(s, d)))


@query("topic_dot", f"WITH {_VEC} SELECT a.topic_id::BIGINT AS i, b.topic_id::BIGINT AS j, round(sum(a.w * b.w), 6) AS dot FROM vec a JOIN vec b ON a.term = b.term AND a.topic_id < b.topic_id GROUP BY 1, 2")
def _(s, d):
    return out(R.dot_products(P.topic_vectors(pseudo_h(s, d))))


@query("similarity_histogram", f"WITH {_SIM} SELECT least(floor(js * 10), 9)::BIGINT AS bin, count(*) AS n FROM sims GROUP BY 1")
def _(s, d):
    return out(R.histogram(_sim(s, d), "js"))


@query("extreme_pairs", f"WITH {_SIM}, r AS (SELECT 'similar' AS kind, row_number() OVER (ORDER BY js DESC, i, j) AS rank, i, j, js FROM sims UNION ALL SELECT 'diverse', row_number() OVER (ORDER BY js, i, j), i, j, js FROM sims) SELECT kind, rank, i::BIGINT AS i, j::BIGINT AS j, round(js, 6) AS score FROM r WHERE rank <= 3")
def _(s, d):
    return out(R.extreme_pairs(_sim(s, d), "js"))


@query("ldavis_tokens", f"WITH {H_SQL}, {W_SQL}, z AS (SELECT topic_id, sum(weight) AS size FROM w GROUP BY topic_id), f AS (SELECT topic_id, term, weight / (sum(weight) OVER (PARTITION BY topic_id) + 1e-10) * size AS f FROM h JOIN z USING (topic_id)) SELECT term, topic_id::BIGINT AS topic_id, round(share, 6) AS share FROM (SELECT *, f / sum(f) OVER (PARTITION BY term) AS share FROM f) WHERE f > 0")
def _(s, d):
    return out(R.token_table(pseudo_h(s, d), pseudo_w(s, d)))


@query("ldavis_topics", f"WITH {W_SQL}, z AS (SELECT topic_id, sum(weight) AS size FROM w GROUP BY topic_id) SELECT topic_id::BIGINT AS topic_id, row_number() OVER (ORDER BY round(size, 6) DESC, topic_id) AS place, round(size / sum(size) OVER (), 6) AS share FROM z")
def _(s, d):
    return out(R.by_size(pseudo_w(s, d).withColumn("weight", F.col("weight").cast("decimal(10,1)"))).withColumn("share", F.col("share").cast("double")))


@query("relevance_words", f"WITH {H_SQL}, r AS (SELECT topic_id, term, round(weight * 3, 4) AS score FROM h WHERE weight > 0), t AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, term) AS rank FROM r) SELECT topic_id::BIGINT AS topic_id, rank, term, score FROM t WHERE rank <= 10")
def _(s, d):
    r = pseudo_h(s, d).where("weight > 0").select("topic_id", "term", (F.col("weight") * 3).alias("relevance"))
    return out(R.words_from_relevance(r))


@query("word_topic_matrix", f"WITH {H_SQL}, t AS ({_TOP.format(cols='term, weight AS score', key='term', t='h', n=15)}) SELECT term, {', '.join(f'round(max(score) FILTER (WHERE topic_id = {i}), 6) AS topic_{i}' for i in range(1, TOPICS + 1))} FROM t GROUP BY term")
def _(s, d):
    return out(R.word_topic_matrix(P.top_words(pseudo_h(s, d)), TOPICS))


@query("factor_sparsity", f"WITH {H_SQL}, {W_SQL} SELECT round(1000.0::DOUBLE / ((SELECT count(DISTINCT doc_id) FROM w) * (SELECT count(DISTINCT term) FROM h)), 6) AS mse, round((SELECT avg((weight = 0)::INTEGER) FROM w), 6) AS w_sparsity, round((SELECT avg((weight = 0)::INTEGER) FROM h), 6) AS h_sparsity")
def _(s, d):
    return out(R.error_and_sparsity(None, pseudo_w(s, d), pseudo_h(s, d), 1000.0))


@query("polar_positions", f"""WITH {W_SQL}, p AS (SELECT doc_id, topic_id, weight / nullif(sum(weight) OVER (PARTITION BY doc_id), 0) AS p FROM w), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, topic_id) AS r FROM p WHERE p > 0),
m AS (SELECT doc_id, sum(p * cos(2 * pi() * (topic_id - 1) / 5)) AS cx, sum(p * sin(2 * pi() * (topic_id - 1) / 5)) AS cy FROM f WHERE r <= 3 GROUP BY doc_id), l AS (SELECT *, sqrt(cx * cx + cy * cy) AS len FROM m)
SELECT doc_id, round(2.5 * sqrt(len) * cx / nullif(len, 0), 5) + 0.0 AS x, round(2.5 * sqrt(len) * cy / nullif(len, 0), 5) + 0.0 AS y FROM l""")
def _(s, d):
    return out(R.polar_positions(pseudo_w(s, d), TOPICS), 5)


@query("circular_layout", "SELECT t AS topic_id, round(cos(2 * pi() * (t - 1) / 7), 6) + 0.0 AS x, round(sin(2 * pi() * (t - 1) / 7), 6) + 0.0 AS y FROM range(1, 8) r(t)")
def _(s, d):
    return out(R.circular_layout(7, s))


@query("jaro_winkler", "WITH w AS (SELECT DISTINCT p_name AS a FROM part ORDER BY 1 LIMIT 40) SELECT x.a, y.a AS b, round(jaro_winkler_similarity(x.a, y.a), 6) AS jaro_winkler FROM w x JOIN w y ON x.a < y.a")
def _(s, d):
    w = table(s, d, "part").select(F.col("p_name").alias("a")).distinct().orderBy("a").limit(40)  # a list of words, as topics have
    return out(R.word_similarity(w.join(w.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))).select("a", "b", "jaro_winkler"))


@query("turkish_upper", "SELECT doc_id, upper(translate(text, 'iğşüöç', 'İĞŞÜÖÇ')) AS t FROM documents WHERE NOT regexp_matches(text, 'ß|ŉ|ǰ|ΐ|ﬁ|ﬂ')")
def _(s, d):
    return documents(s, d).where(~F.col("text").rlike("ß|ŉ|ǰ|ΐ|ﬁ|ﬂ")).select("doc_id", X.turkish_upper(F.col("text")).alias("t"))


@query("l1_rows", f"WITH {TF} SELECT doc_id, term, round(tf / sum(tf) OVER (PARTITION BY doc_id)::DOUBLE, 6) AS w FROM tf")
def _(s, d):
    return out(G.normalize(counted(s, d).withColumn("w", F.col("tf").cast("double")).drop("tf"), ["doc_id"], norm="l1"))


@query("word_cloud", f"WITH {H_SQL} " + _TOP.format(cols="term, round(weight, 6) AS score", key="term", t="h", n=50))
def _(s, d):
    return out(P.top_words(pseudo_h(s, d), 50))


@query("first_spikes", f"""WITH {_COUNTS}, t AS (SELECT period, sum(value) AS total FROM dist GROUP BY period) SELECT period, total FROM t WHERE total > (SELECT avg(total) + 1.5 * stddev_samp(total) FROM t) ORDER BY period LIMIT 5""")
def _(s, d):
    return out(temporal.spikes(_dist(s, d)).select("period", "total").orderBy("period").limit(5))


@query("topic_prompts", f"WITH {H_SQL}, t AS ({_TOP.format(cols='term, weight', key='term', t='h', n=15)}) SELECT topic_id, 'Name topic ' || topic_id || ' by its most important words:' || chr(10) || string_agg(rank || '. ' || term || ' (' || format('{{:.4f}}', weight) || ')', chr(10) ORDER BY rank) AS prompt FROM t GROUP BY topic_id")
def _(s, d):
    return out(R.topic_prompt(P.top_words(pseudo_h(s, d))))


@query("document_components")
def _(s, d):
    v = pseudo_w(s, d).groupBy(F.col("doc_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_id", "weight"))), lambda x: x["weight"]).alias("v"))
    return R.pca(v)


@query("representative_documents")
def _(s, d):
    w = pseudo_w(s, d)
    return R.representatives(P.radial_positions(w, TOPICS).join(P.dominant_topic(w).where("topic_id > 0"), "doc_id").where("x IS NOT NULL"), 5)


@query("lda_topics")
def _(s, d):
    return R.lda_topics(counted(s, d))


@query("subword_counts")
def _(s, d):
    ids = R.subword_ids(documents(s, d), "/opt/tokenizers/word_bpe_49k.json")
    return V.token_frequency(R.subword_names(ids))


@query("trend_summary", f"WITH {_COUNTS}, x AS (SELECT topic_id, min_by(value, period) AS a, max_by(value, period) AS b FROM dist GROUP BY topic_id) SELECT topic_id, a AS before, b AS after, CASE WHEN (b - a) / nullif(a, 0) > 0.1 THEN 'increasing' WHEN (b - a) / nullif(a, 0) < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM x")
def _(s, d):
    x = _dist(s, d).groupBy("topic_id").agg(F.min_by("value", "period").alias("before"), F.max_by("value", "period").alias("after"))
    return out(x.withColumn("trend", temporal.trend_summary(F.col("before"), F.col("after"))))
