"""Queries: topics, relevance, coherence, diversity, similarity, co-occurrence, time, factorization.

The relational ones run on deterministic pseudo-factors over the whole tables (see base), so that SQL can follow.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coherence as C
from ..operators import cooccurrence as O
from ..operators import factorize as Z
from ..operators import temporal as M
from ..operators import topics as P
from ..operators import vocab as V
from ..operators import weights as G
from ..operators.shared import checkpointed
from .base import counted, FREQ, H_SQL, S_SQL, TIMES_SQL, W_SQL, documents, out, pseudo_h, pseudo_s, pseudo_w, table, times, tok, tokenized
from .registry import query

_TOP = "SELECT topic_id::BIGINT AS topic_id, rank, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, {key}) AS rank FROM {t} WHERE weight > 0) WHERE rank <= {n}"
_WORDS = H_SQL + ", words AS MATERIALIZED (" + _TOP.format(cols="term", key="term", t="h", n=10) + ")"


def _words(s, d, n=10):
    return P.top_words(pseudo_h(s, d), n).select("topic_id", "rank", "term")


# topics


@query("top_words", f"WITH {H_SQL} " + _TOP.format(cols="term, weight AS score", key="term", t="h", n=15))
def _(s, d):
    return out(P.top_words(pseudo_h(s, d)))


@query("top_docs", f"WITH {W_SQL}, t AS ({_TOP.format(cols='doc_id, weight AS score', key='doc_id', t='w', n=10)}) SELECT topic_id, rank, doc_id, replace(replace(text, chr(10), ''), '\"', '') AS text, score FROM t JOIN documents USING (doc_id)")
def _(s, d):
    return out(P.top_documents(pseudo_w(s, d), documents(s, d)))


@query("merged_top_words")
def _(s, d):
    return P.merged_top_words(pseudo_h(s, d))


@query("nmtf_row_argmax", f"WITH {S_SQL} SELECT i::BIGINT AS i, j::BIGINT AS j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY value DESC, j) AS r FROM s) WHERE r = 1")
def _(s, d):
    return out(P.row_argmax(pseudo_s(s)))


_DOM = W_SQL + ", dom AS (SELECT doc_id, CASE WHEN weight > 0 THEN topic_id ELSE -1 END::BIGINT AS topic_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic_id) AS r FROM w) WHERE r = 1)"


@query("dominant_topic", f"WITH {_DOM} SELECT * FROM dom")
def _(s, d):
    return out(P.dominant_topic(pseudo_w(s, d)))


@query("topic_dist", f"WITH {_DOM} SELECT topic_id, count(*) AS n_docs, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM dom WHERE topic_id >= 0 GROUP BY topic_id")
def _(s, d):
    return out(P.topic_sizes(pseudo_w(s, d)))


@query("word_best_topic", f"WITH {H_SQL}, t AS ({_TOP.format(cols='term, weight', key='term', t='h', n=50)}) SELECT term, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY weight DESC, topic_id) AS r FROM t) WHERE r = 1")
def _(s, d):
    t = P.top_words(pseudo_h(s, d), 50)
    return out(t.groupBy("term").agg(F.max_by("topic_id", F.struct("score", -F.col("topic_id"))).alias("topic_id")))


_REL = """, p AS (SELECT *, weight / (sum(weight) OVER (PARTITION BY topic_id) + 1e-10) AS p FROM h), q AS (SELECT topic_id, sum(weight) / sum(sum(weight)) OVER () AS q FROM w GROUP BY topic_id),
pw AS (SELECT term, sum(p * q) AS pw FROM p JOIN q USING (topic_id) GROUP BY term),
rel AS (SELECT topic_id, term, 0.6 * ln(p + 1e-10) + 0.4 * ln((p + 1e-10) / (pw + 1e-10)) AS relevance FROM p JOIN pw USING (term) WHERE weight > 1e-10)"""


@query("relevance", f"WITH {H_SQL}, {W_SQL}{_REL} SELECT topic_id::BIGINT AS topic_id, term, round(relevance, 4) AS relevance FROM rel")
def _(s, d):
    return out(P.relevance(pseudo_h(s, d), pseudo_w(s, d)), 4)


@query("relevance_overall", f"WITH {H_SQL}, w AS (SELECT topic_id, 1.0::DOUBLE AS weight FROM range(1, 6) r(topic_id)){_REL} SELECT topic_id::BIGINT AS topic_id, term, round(relevance, 4) AS relevance FROM rel")
def _(s, d):
    return out(P.relevance(pseudo_h(s, d)), 4)


@query("ldavis_terms", f"""WITH {H_SQL}, {W_SQL}, z AS (SELECT topic_id, sum(weight) AS size FROM w GROUP BY topic_id),
p AS (SELECT h.topic_id, term, weight, size, weight / (sum(weight) OVER (PARTITION BY h.topic_id) + 1e-10) AS p FROM h JOIN z USING (topic_id)),
f AS (SELECT *, p * size AS freq, sum(p * size) OVER (PARTITION BY term) AS total, sum(size) OVER (PARTITION BY term) AS a FROM p),
g AS (SELECT *, ln(p + 1e-10) AS logprob, ln((p + 1e-10) / (total / a + 1e-10)) AS loglift FROM f WHERE weight > 1e-10),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(0.6 * logprob + 0.4 * loglift, 9) DESC, term) AS rank FROM g)
SELECT topic_id::BIGINT AS topic_id, rank, term, round(freq, 6) AS freq, round(total, 6) AS total, round(logprob, 6) AS logprob, round(loglift, 6) AS loglift, round(0.6 * logprob + 0.4 * loglift, 6) AS relevance FROM r WHERE rank <= 30""")
def _(s, d):
    return out(P.term_table(pseudo_h(s, d), pseudo_w(s, d)))


# coherence

_PAIRS = """, hit AS (SELECT DISTINCT doc_id, term FROM tok WHERE term IN (SELECT term FROM words)), one AS (SELECT term, count(*) AS c FROM hit GROUP BY term),
two AS (SELECT a.term AS w1, b.term AS w2, count(*) AS c FROM hit a JOIN hit b USING (doc_id) GROUP BY ALL),
pairs AS MATERIALIZED (SELECT x.topic_id, x.rank AS r1, y.rank AS r2, x.term AS w1, y.term AS w2, coalesce(a.c, 0) AS d1, coalesce(b.c, 0) AS d2, coalesce(two.c, 0) AS d12
FROM words x JOIN words y ON x.topic_id = y.topic_id AND x.rank < y.rank LEFT JOIN one a ON a.term = x.term LEFT JOIN one b ON b.term = y.term LEFT JOIN two ON two.w1 = x.term AND two.w2 = y.term),
n AS (SELECT count(*)::DOUBLE AS n FROM documents)"""


def _doc_pairs(s, d):
    t = tok(s, d)
    return C.document_pairs(t, _words(s, d)), documents(s, d).agg(F.count(F.lit(1)).cast("double").alias("n"))


@query("topic_word_pairs", f"WITH {_WORDS}{_PAIRS} SELECT topic_id, r1, r2, w1, w2, d1, d2, d12 FROM pairs")
def _(s, d):
    return out(_doc_pairs(s, d)[0])


for _name, _expr in {
    "counts": "CASE WHEN d1 > 0 AND d2 > 0 AND d12 > 0 THEN ln((d12 + 1e-12) / d1) END",
    "one": "CASE WHEN d1 > 0 THEN ln((d12 + 1.0) / d1) END",
    "shares": "CASE WHEN d1 > 0 THEN ln((d12 / n + 1e-12) / (d1 / n)) END",
}.items():
    query(f"umass_{_name}", f"WITH {_WORDS}{_PAIRS} SELECT topic_id, round(avg({_expr}), 6) AS u_mass FROM pairs, n GROUP BY topic_id")(lambda s, d, k=_name: out(C.u_mass(*_doc_pairs(s, d), k)))


@query("uci", f"WITH {_WORDS}{_PAIRS} SELECT topic_id, round(avg(ln((d12 / n + 1e-9) / (d1 / n * d2 / n))), 6) AS c_uci FROM pairs, n WHERE d1 > 0 AND d2 > 0 AND d12 > 0 GROUP BY topic_id")
def _(s, d):
    return out(C.c_uci(*_doc_pairs(s, d)))


@query("cv", f"""WITH {_WORDS}, lens AS (SELECT doc_id, max(pos) AS len FROM tok GROUP BY doc_id), n AS (SELECT sum(greatest(1, len - 109))::DOUBLE AS n FROM lens),
hit AS MATERIALIZED (SELECT DISTINCT doc_id, term, unnest(range(greatest(1, pos - 109), least(pos, greatest(1, len - 109)) + 1)) AS win FROM tok JOIN lens USING (doc_id) WHERE term IN (SELECT term FROM words)),
one AS (SELECT term, count(*) AS c FROM hit GROUP BY term), two AS (SELECT a.term AS w1, b.term AS w2, count(*) AS c FROM hit a JOIN hit b USING (doc_id, win) GROUP BY ALL),
v AS (SELECT x.topic_id, x.term AS a, y.term AS b, CASE WHEN p.c > 0 AND q.c > 0 THEN ln((coalesce(two.c, 0) / n + 1e-12) / (p.c / n * q.c / n)) / -ln(coalesce(two.c, 0) / n + 1e-12) ELSE 0 END AS v
FROM words x JOIN words y USING (topic_id) LEFT JOIN one p ON p.term = x.term LEFT JOIN one q ON q.term = y.term LEFT JOIN two ON two.w1 = x.term AND two.w2 = y.term, n),
t AS (SELECT *, sum(v) OVER (PARTITION BY topic_id, b) AS t FROM v), c AS (SELECT topic_id, a, coalesce(sum(v * t) / nullif(sqrt(sum(v * v) * sum(t * t)), 0), 0) AS c FROM t GROUP BY topic_id, a)
SELECT topic_id, round(avg(c), 6) AS c_v FROM c GROUP BY topic_id""")
def _(s, d):
    return out(C.c_v(tokenized(s, d), _words(s, d)))


# diversity


@query("puw", f"WITH {_WORDS} SELECT round(count(DISTINCT term) / count(*)::DOUBLE, 6) AS puw FROM words")
def _(s, d):
    return out(P.unique_words(_words(s, d)))


_SETS = _WORDS + """, k AS (SELECT topic_id, count(*) AS k FROM words GROUP BY topic_id), sets AS (SELECT a.topic_id AS i, b.topic_id AS j, a.k AS ka, b.k AS kb,
(SELECT count(*) FROM words x JOIN words y USING (term) WHERE x.topic_id = a.topic_id AND y.topic_id = b.topic_id) AS c FROM k a JOIN k b ON a.topic_id < b.topic_id),
sim AS (SELECT i, j, c / (ka + kb - c)::DOUBLE AS jaccard, c / sqrt(ka * kb) AS cosine FROM sets)"""


@query("word_set_similarity", f"WITH {_SETS} SELECT i, j, round(jaccard, 6) AS jaccard, round(cosine, 6) AS cosine FROM sim")
def _(s, d):
    return out(P.word_set_similarity(_words(s, d)))


@query("diversity_overall", f"""WITH {_SETS}, x AS (SELECT (SELECT count(DISTINCT term) / count(*)::DOUBLE FROM words) AS p, avg(1 - jaccard) AS a, avg(1 - cosine) AS b FROM sim)
SELECT round(p, 6) AS puw, round(a, 6) AS jaccard_diversity, round(b, 6) AS cosine_diversity,
round((0.4 * greatest(p, 0) + 0.3 * greatest(a, 0) + 0.3 * greatest(b, 0)) / ((p > 0)::INTEGER * 0.4 + (a > 0)::INTEGER * 0.3 + (b > 0)::INTEGER * 0.3)::DOUBLE, 6) AS overall FROM x""")
def _(s, d):
    return out(P.overall_diversity(_words(s, d)))


# similarity

_VEC = H_SQL + """, idf AS (SELECT term, ln(5 / (count(*) FILTER (WHERE weight > 0) + 1)::DOUBLE) + 1 AS idf FROM h GROUP BY term),
x AS (SELECT topic_id, term, weight * idf AS w FROM h JOIN idf USING (term)), top AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY w DESC, term) AS r FROM x WHERE w > 0),
vec AS MATERIALIZED (SELECT topic_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY topic_id)) AS w FROM top WHERE r <= 50)"""
_SIM = _VEC + """, pr AS MATERIALIZED (SELECT topic_id, term, w, w / sum(w) OVER (PARTITION BY topic_id) AS p FROM vec), ids AS (SELECT DISTINCT topic_id FROM pr),
full_ AS (SELECT i.topic_id AS i, j.topic_id AS j, t.term, coalesce(a.w, 0) AS wa, coalesce(b.w, 0) AS wb, coalesce(a.p, 0) AS pa, coalesce(b.p, 0) AS pb FROM ids i JOIN ids j ON i.topic_id < j.topic_id, (SELECT DISTINCT term FROM pr) t
LEFT JOIN pr a ON a.topic_id = i.topic_id AND a.term = t.term LEFT JOIN pr b ON b.topic_id = j.topic_id AND b.term = t.term),
sims AS MATERIALIZED (SELECT i, j, sum(wa * wb) / sqrt(sum(wa * wa) * sum(wb * wb)) AS cosine,
1 - sum((CASE WHEN pa > 0 THEN pa * ln(2 * pa / (pa + pb)) ELSE 0 END + CASE WHEN pb > 0 THEN pb * ln(2 * pb / (pa + pb)) ELSE 0 END) / 2) AS js, 1 / (1 + sqrt(sum((wa - wb) * (wa - wb)))) AS euclid FROM full_ GROUP BY i, j)"""


def _sim(s, d):
    return P.topic_similarity(P.topic_vectors(pseudo_h(s, d)))


@query("topic_idf", f"WITH {_VEC} SELECT term, round(idf, 6) AS idf FROM idf")
def _(s, d):
    return out(P.topic_idf(pseudo_h(s, d)))


@query("topic_vectors", f"WITH {_VEC} SELECT topic_id::BIGINT AS topic_id, term, round(w, 6) AS w FROM vec")
def _(s, d):
    return out(P.topic_vectors(pseudo_h(s, d)))


@query("topic_similarity", f"WITH {_SIM} SELECT i::BIGINT AS i, j::BIGINT AS j, round(cosine, 6) AS cosine, round(js, 6) AS js, round(euclid, 6) AS euclid FROM sims")
def _(s, d):
    return out(_sim(s, d))


@query("redundant_topics", f"WITH {_SIM} SELECT i::BIGINT AS i, j::BIGINT AS j FROM sims WHERE js >= 0.8")
def _(s, d):
    return out(_sim(s, d).where("js >= 0.8").select("i", "j"))


@query("merge_components", f"""WITH RECURSIVE {_SIM}, e AS (SELECT i, j FROM sims WHERE js >= 0.84 UNION SELECT j, i FROM sims WHERE js >= 0.84),
reach AS (SELECT topic_id AS a, topic_id AS b FROM ids UNION SELECT reach.a, e.j FROM reach JOIN e ON e.i = reach.b) SELECT a::BIGINT AS topic_id, min(b)::BIGINT AS group_id FROM reach GROUP BY a""")
def _(s, d):
    h = pseudo_h(s, d)
    return out(P.merge_topics(_sim(s, d), h.select("topic_id").distinct(), 0.84, "js"))


@query("sim_summary", f"WITH {_SIM} SELECT round(avg(js), 6) AS mean, round(min(js), 6) AS min, round(max(js), 6) AS max, round(stddev_pop(js), 6) AS std, round(quantile_cont(js, 0.5), 6) AS median, round(1 - avg(js), 6) AS diversity FROM sims")
def _(s, d):
    return out(P.similarity_summary(_sim(s, d), "js"))


@query("laplacian", f"""WITH {_SIM}, a AS (SELECT i, j, js AS a FROM sims WHERE js >= 0.65 UNION ALL SELECT j, i, js FROM sims WHERE js >= 0.65)
SELECT i::BIGINT AS i, j::BIGINT AS j, round(-a, 6) AS value FROM a UNION ALL SELECT i::BIGINT, i::BIGINT, round(sum(a), 6) FROM a GROUP BY i""")
def _(s, d):
    return out(P.laplacian(_sim(s, d), 0.65, "js"))


# topic graph


@query("s_column_normalized", f"WITH {S_SQL} SELECT i::BIGINT AS i, j::BIGINT AS j, value, round(value / CASE WHEN sum(abs(value)) OVER (PARTITION BY j) = 0 THEN 1 ELSE sum(abs(value)) OVER (PARTITION BY j) END, 6) AS normalized FROM s")
def _(s, d):
    return out(P.column_normalized(pseudo_s(s)))


@query("s_links", f"WITH {S_SQL} SELECT i::BIGINT AS i, j::BIGINT AS j, value, round(value / sum(value) OVER (), 6) AS share FROM s WHERE i <> j AND value >= 0.1")
def _(s, d):
    return out(P.strong_links(pseudo_s(s)))


@query("s_influences", f"""WITH {S_SQL}, e AS (SELECT * FROM s WHERE i <> j AND value >= 0.1), o AS (SELECT i, count(*) AS c FROM e GROUP BY i), n AS (SELECT j, count(*) AS c FROM e GROUP BY j)
SELECT s.i::BIGINT AS topic_id, value >= 0.5 AS is_pure, coalesce(o.c, 0) AS out_links, coalesce(n.c, 0) AS in_links, coalesce(o.c, 0) >= 2 AS is_hub, coalesce(n.c, 0) >= 2 AS is_sink FROM s LEFT JOIN o ON o.i = s.i LEFT JOIN n ON n.j = s.i WHERE s.i = s.j""")
def _(s, d):
    return out(P.influences(pseudo_s(s)))


# documents in topic space


@query("certainty", f"""WITH {W_SQL}, p AS (SELECT doc_id, weight / nullif(sum(weight) OVER (PARTITION BY doc_id), 0) AS p FROM w)
SELECT doc_id, round(1 / (1 + sum(CASE WHEN p > 1e-10 THEN -p * ln(p) WHEN p IS NOT NULL THEN 0 END)), 6) AS certainty FROM p GROUP BY doc_id""")
def _(s, d):
    return out(P.certainty(pseudo_w(s, d)))


@query("radial_positions", f"WITH {W_SQL} SELECT doc_id, round(sum(weight * cos(2 * pi() * (topic_id - 1) / 5) * 2.5) / nullif(sum(weight), 0), 5) + 0.0 AS x, round(sum(weight * sin(2 * pi() * (topic_id - 1) / 5) * 2.5) / nullif(sum(weight), 0), 5) + 0.0 AS y FROM w GROUP BY doc_id")
def _(s, d):
    return out(P.radial_positions(pseudo_w(s, d), 5), 5)


@query("predict_scores", f"""WITH {H_SQL}, t AS (SELECT DISTINCT doc_id, term FROM tok), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
x AS (SELECT doc_id, topic_id, sum(weight) / sqrt(any_value(n)) AS score FROM t JOIN h USING (term) JOIN n USING (doc_id) GROUP BY doc_id, topic_id)
SELECT doc_id, topic_id::BIGINT AS topic_id, round(score + 1e-9, 6) AS score, round(score / nullif(sum(score) OVER (PARTITION BY doc_id), 0) + 1e-9, 6) AS share FROM x""")
def _(s, d):
    # shares such as 21/128 lie halfway between two roundings; a little more decides them alike
    scored = P.score_documents(V.count_english(documents(s, d)), pseudo_h(s, d))
    return out(scored.withColumn("score", F.col("score") + 1e-9).withColumn("share", F.col("share") + 1e-9))


@query("elbow", """WITH c AS (SELECT n_nationkey + 2 AS k, ((n_nationkey * 37) % 23) / 7.0::DOUBLE AS score FROM nation), x AS (SELECT k, score, lead(score) OVER (ORDER BY k) - 2 * score + lag(score) OVER (ORDER BY k) AS second FROM c)
SELECT k, round(score, 6) AS score, round(second, 6) + 0.0 AS second, k = (SELECT k FROM x ORDER BY score DESC, k LIMIT 1) AS is_optimal, k = (SELECT k FROM x ORDER BY abs(second) DESC NULLS LAST, k LIMIT 1) AS is_elbow FROM x""")
def _(s, d):
    return out(P.elbow(table(s, d, "nation").select((F.col("n_nationkey") + 2).alias("k"), ((F.col("n_nationkey") * 37) % 23 / 7.0).alias("score"))))


@query("reconstruction_error", f"""WITH {H_SQL}, {W_SQL}, v AS (SELECT doc_id, term, count(*)::DOUBLE AS v FROM tok GROUP BY doc_id, term),
vr AS (SELECT sum(v * w.weight * h.weight) AS vr FROM v JOIN w USING (doc_id) JOIN h ON h.term = v.term AND h.topic_id = w.topic_id),
gw AS (SELECT a.topic_id AS i, b.topic_id AS j, sum(a.weight * b.weight) AS g FROM w a JOIN w b USING (doc_id) GROUP BY ALL), gh AS (SELECT a.topic_id AS i, b.topic_id AS j, sum(a.weight * b.weight) AS g FROM h a JOIN h b USING (term) GROUP BY ALL),
e AS (SELECT (SELECT sum(v * v) FROM v) AS vv, (SELECT sum(v * v) FROM v) - 2 * (SELECT vr FROM vr) + (SELECT sum(gw.g * gh.g) FROM gw JOIN gh USING (i, j)) AS sq_error)
SELECT round(sq_error, 2) AS sq_error, round(sqrt(sq_error / vv), 2) AS relative, round(1 - sq_error / vv, 2) AS explained FROM e""")
def _(s, d):
    h = pseudo_h(s, d)
    v = counted(s, d).select("doc_id", "term", F.col("tf").cast("double").alias("w"))
    return out(P.reconstruction(v, pseudo_w(s, d), h), 2)


# co-occurrence

_COOC = FREQ + """, kept AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM tok WHERE term IN (SELECT term FROM freq WHERE f >= 5)),
cooc AS MATERIALIZED (SELECT least(a.term, b.term) AS w1, greatest(a.term, b.term) AS w2, 2 * count(*) AS n FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 5 WHERE a.term <> b.term GROUP BY ALL)"""


@query("cooc_window", f"WITH {_COOC} SELECT w1, w2, n FROM cooc")
def _(s, d):
    return out(O.window_cooccurrence(tok(s, d)))


@query("cooc_top", f"WITH {_COOC} SELECT w1, w2, n FROM cooc ORDER BY n DESC, w1, w2 LIMIT 100")
def _(s, d):
    return O.window_cooccurrence(tok(s, d)).orderBy(F.desc("n"), "w1", "w2").limit(100)


@query("cooc_words", f"WITH {_COOC}, b AS (SELECT w1 AS term, n FROM cooc UNION ALL SELECT w2, n FROM cooc) SELECT term, sum(n)::BIGINT AS total FROM b GROUP BY term ORDER BY total DESC, term LIMIT 20")
def _(s, d):
    return O.strongest_words(O.window_cooccurrence(tok(s, d)))


@query("cooc_factor", f"WITH {H_SQL}, best AS ({_TOP.format(cols='term, weight', key='term', t='h', n=50)}) SELECT a.term AS w1, b.term AS w2, round(sum(a.weight * b.weight), 6) AS score FROM best a JOIN best b ON a.topic_id = b.topic_id AND a.term < b.term GROUP BY 1, 2 HAVING sum(a.weight * b.weight) > 0")
def _(s, d):
    best = P.top_words(pseudo_h(s, d), 50).withColumnRenamed("score", "weight")  # the 50 first words of each topic
    return out(O.factor_cooccurrence(best))


# time

_GRAINS = {
    "year": "year(ts)::VARCHAR", "quarter": "year(ts) || 'Q' || quarter(ts)", "month": "strftime(ts, '%Y-%m')", "month_first": "strftime(ts, '%m-%Y')",
    "week": "strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d')",
}
for _g, _p in _GRAINS.items():
    query(f"temporal_weighted_{_g}", f"WITH {W_SQL}, {TIMES_SQL}, x AS (SELECT doc_id, topic_id, weight / nullif(sum(weight) OVER (PARTITION BY doc_id), 0) AS share FROM w) SELECT {_p} AS period, topic_id::BIGINT AS topic_id, round(sum(share), 6) AS value FROM x JOIN times USING (doc_id) GROUP BY 1, 2")(
        lambda s, d, g=_g: out(M.weighted_distribution(pseudo_w(s, d), times(s, d), g))
    )
_COUNTS = f"{_DOM}, {TIMES_SQL}, dist AS (SELECT {_GRAINS['quarter']} AS period, topic_id, count(*)::DOUBLE AS value FROM dom JOIN times USING (doc_id) WHERE topic_id > 0 GROUP BY 1, 2)"
_START = "make_date(substr(period, 1, 4)::INTEGER, (substr(period, 6, 1)::INTEGER - 1) * 3 + 1, 1)"


def _dist(s, d):
    x = P.dominant_topic(pseudo_w(s, d)).where("topic_id > 0").join(times(s, d), "doc_id")
    return x.groupBy(M.period(F.col("ts"), "quarter").alias("period"), "topic_id").agg(F.count(F.lit(1)).cast("double").alias("value"))


@query("temporal_count_pivot", f"WITH {_COUNTS} SELECT period, {', '.join(f'coalesce(max(value) FILTER (WHERE topic_id = {i}), 0)::BIGINT AS topic_{i}' for i in range(1, 6))} FROM dist GROUP BY period")
def _(s, d):
    return out(M.count_distribution(P.dominant_topic(pseudo_w(s, d)), times(s, d), 5))


@query("temporal_pct", f"WITH {_COUNTS} SELECT period, topic_id, round(100 * value / sum(value) OVER (PARTITION BY period), 6) AS value FROM dist")
def _(s, d):
    return out(M.percentages(_dist(s, d)))


@query("temporal_z", f"WITH {_COUNTS} SELECT period, topic_id, round(CASE WHEN stddev_samp(value) OVER t > 1e-10 THEN (value - avg(value) OVER t) / stddev_samp(value) OVER t ELSE 0 END, 6) AS value FROM dist WINDOW t AS (PARTITION BY topic_id)")
def _(s, d):
    return out(M.z_scores(_dist(s, d)))


@query("temporal_gapfill", """WITH x AS (SELECT year(o_orderdate) AS year, o_custkey % 50 AS topic_id, count(*) AS value FROM orders WHERE o_custkey % 7 = year(o_orderdate) % 7 GROUP BY ALL), g AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM x)
SELECT g.year, t.topic_id, coalesce(value, 0) AS value FROM g, (SELECT DISTINCT topic_id FROM x) t LEFT JOIN x ON x.year = g.year AND x.topic_id = t.topic_id""")
def _(s, d):
    x = table(s, d, "orders").select(F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 50).alias("topic_id"), "o_custkey").where("o_custkey % 7 = year % 7")
    return out(M.fill_years(x.groupBy("year", "topic_id").agg(F.count(F.lit(1)).alias("value"))))


@query("sparse_periods", f"WITH {_COUNTS} SELECT period, sum(value) AS total FROM dist GROUP BY period HAVING sum(value) < 24")
def _(s, d):
    return out(M.sparse_periods(_dist(s, d), 24))


@query("mm_yyyy_order", "WITH p AS (SELECT DISTINCT strftime(o_orderdate, '%m-%Y') AS period FROM orders) SELECT period, row_number() OVER (ORDER BY strptime(period, '%m-%Y')) AS n FROM p")
def _(s, d):
    from pyspark.sql import Window

    p = table(s, d, "orders").select(F.date_format("o_orderdate", "MM-yyyy").alias("period")).distinct()
    return out(p.withColumn("n", F.row_number().over(Window.orderBy(M.period_order(F.col("period"))))))  # one row a month


@query("year_topic_rows", f"WITH {_DOM}, {TIMES_SQL} SELECT doc_id, year(ts)::BIGINT AS year, topic_id FROM dom JOIN times USING (doc_id)")
def _(s, d):
    return out(P.dominant_topic(pseudo_w(s, d)).join(times(s, d), "doc_id").select("doc_id", F.year("ts").alias("year"), "topic_id"))


@query("violin_points", f"WITH {_COUNTS} SELECT topic_id, substr(period, 1, 4)::INTEGER + (substr(period, 6, 1)::INTEGER - 1) / 4::DOUBLE AS decimal_year FROM dist, range(1, 100000) r(i) WHERE i <= value")
def _(s, d):
    return out(M.repeated_points(_dist(s, d)))


@query("interpolated", f"""WITH {_COUNTS}, o AS (SELECT topic_id, value, row_number() OVER (PARTITION BY topic_id ORDER BY {_START}) - 1 AS i, lead(value) OVER (PARTITION BY topic_id ORDER BY {_START}) AS nx FROM dist)
SELECT topic_id, round(i + j / 10::DOUBLE, 6) AS x, round(value + coalesce(nx - value, 0) * j / 10::DOUBLE, 6) AS value FROM o, range(0, 10) r(j) WHERE j = 0 OR nx IS NOT NULL""")
def _(s, d):
    return out(M.interpolated(_dist(s, d)))


@query("trend_class", f"""WITH {_COUNTS}, o AS (SELECT *, {_START} AS ord, lag(value) OVER (PARTITION BY topic_id ORDER BY {_START}) AS l, row_number() OVER (PARTITION BY topic_id ORDER BY {_START} DESC) AS r FROM dist),
c AS (SELECT *, CASE WHEN l IS NULL THEN NULL WHEN l = 0 THEN CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END ELSE (value - l) / l END::DOUBLE AS c FROM o),
a AS (SELECT topic_id, sum(value) AS total, count(c) AS n, avg(c) FILTER (WHERE r <= 3) AS m, avg((c > 0.1)::INTEGER) FILTER (WHERE r <= 3) AS up, avg((c < -0.1)::INTEGER) FILTER (WHERE r <= 3) AS down FROM c GROUP BY topic_id),
k AS (SELECT topic_id, period FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY value DESC, ord) AS q FROM o) WHERE q = 1)
SELECT a.topic_id, total, k.period AS peak_period, round(m, 6) AS mean_change, CASE WHEN n < 2 THEN 'insufficient' WHEN up >= 0.6 AND m > 0.1 THEN 'emerging' WHEN down >= 0.6 AND m < -0.1 THEN 'declining' WHEN abs(m) < 0.15 THEN 'stable' ELSE 'volatile' END AS trend FROM a JOIN k USING (topic_id)""")
def _(s, d):
    return out(M.trends(_dist(s, d)))


@query("spike_events", f"""WITH {_COUNTS}, t AS (SELECT period, sum(value) AS total FROM dist GROUP BY period), hi AS (SELECT period, total FROM t WHERE total > (SELECT avg(total) + 1.5 * stddev_samp(total) FROM t)),
m AS (SELECT *, avg(value) OVER (PARTITION BY topic_id) AS m FROM dist) SELECT hi.period, hi.total, coalesce((SELECT list(topic_id ORDER BY topic_id) FROM m WHERE m.period = hi.period AND value > 1.5 * m), []) AS topics FROM hi""")
def _(s, d):
    return out(M.spikes(_dist(s, d)))


@query("missing_quarters", f"""WITH {_COUNTS}, q AS (SELECT DISTINCT {_START} AS q FROM dist WHERE substr(period, 6, 1) <> '2') SELECT g::DATE AS quarter_start FROM (SELECT unnest(generate_series(min(q), max(q), INTERVAL 3 MONTH)) AS g FROM q) WHERE g::DATE NOT IN (SELECT q FROM q)""")
def _(s, d):
    return M.missing_quarters(_dist(s, d).where("NOT endswith(period, 'Q2')"))


@query("forecast")
def _(s, d):
    return M.with_forecast(_dist(s, d), M.forecast(_dist(s, d)))


@query("forecast_metrics", """WITH x AS (SELECT o_totalprice AS a, o_totalprice * (0.9 + (o_orderkey % 20) / 100.0::DOUBLE) AS p FROM orders)
SELECT round(avg(abs(a - p)), 4) AS mae, round(sqrt(avg((a - p) * (a - p))), 4) AS rmse, round(100 * avg(abs((a - p) / (a + 1e-10))), 4) AS mape, round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 4) AS r2 FROM x""")
def _(s, d):
    x = table(s, d, "orders").select(F.col("o_totalprice").alias("actual"), (F.col("o_totalprice") * (0.9 + (F.col("o_orderkey") % 20) / 100.0)).alias("predicted"))
    return out(M.error_metrics(x), 4)


# factorization


def _weights(s, d):
    return checkpointed(G.tfidf(documents(s, d), counted(s, d)))


@query("flagship_topics")
def _(s, d):
    """Top words of 5 topics of the whole corpus, end to end: clean, weigh, factorize, rank."""
    return P.top_words(Z.factorize(_weights(s, d), 5).h)


for _m in ("pnmf", "opnmf", "nmtf"):
    query(f"topics_{_m}")(lambda s, d, m=_m: P.top_words(Z.factorize(_weights(s, d), 5, m).h))


@query("topics_in_blocks")
def _(s, d):
    return P.top_words(Z.factorize(_weights(s, d), 5, local_nnz=0).h)


@query("pipeline_tokens_top_terms", f"""WITH {FREQ}, x AS (SELECT d.source, t.term, count(*) AS n FROM tok t JOIN documents d USING (doc_id) GROUP BY ALL) SELECT source, rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM x) WHERE rank <= 10""")
def _(s, d):
    from ..operators.shared import top_n

    t = V.explode_tokens(tokenized(s, d)).join(documents(s, d).select("doc_id", "source"), "doc_id").groupBy("source", "term").agg(F.count(F.lit(1)).alias("n"))
    return out(top_n(t, ["source"], [F.desc("n"), "term"], 10).select("source", "rank", "term", "n"))


