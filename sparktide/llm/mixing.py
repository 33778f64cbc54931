"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the budget over the tokens it has. A document's
count is the quantile of the Poisson distribution with that mean at a uniform number hashed from its
id and a seed, so it depends on nothing else and is the same however the table is split. The document is
exploded by its count, and the copies are shuffled globally by a hash of (seed, id, copy).
All is built-in expressions; what is collected is one row per source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pick, small
from .textkernel import lean, word_counts

SEED = 17
#: Target share of a source without given weights: its tokens to this power, normalized.
ALPHA = 0.5
#: Up to this rate the distribution is summed from 0, beyond it outwards from its mode.
PLAIN_RATE = 64.0
#: Copies of a document that are numbered in one array; more are numbered in several.
COPY_BLOCK = 1 << 16
_UNIT = float(1 << 52)


def unit_hash(*parts: Column) -> Column:
    """Uniform in [0, 1) from the MD5 of the parts joined with colons: 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(_UNIT)


def poisson_cdf(rate: float) -> list[float]:
    """P(N <= k) for k = 0, 1, ... up to where it is 1 in double precision."""
    out, p, total, k = [], math.exp(-rate), 0.0, 0
    while k <= rate or p > 1e-18:
        total += p
        out.append(total)
        k += 1
        p *= rate / k
    return out


def poisson_table(rate: float) -> tuple[int, list[float]]:
    """First k and P(N <= k) from there on; what lies before it sums to less than the smallest step of unit_hash.

    Terms relative to the mode's, normalized by their sum, neither underflow nor lose digits at any rate.
    """
    if rate <= PLAIN_RATE:
        return 0, poisson_cdf(rate)
    mode = int(rate)
    down, up = [1.0], []
    k = mode
    while k > 0 and down[-1] > 1e-24:
        down.append(down[-1] * k / rate)
        k -= 1
    p, i = rate / (mode + 1), mode + 1
    while p > 1e-24:
        up.append(p)
        i += 1
        p *= rate / i
    total = np.cumsum(down[::-1] + up)
    return k, (total / total[-1]).tolist()


def _tokens_by_source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.table({"source": batch.column("source"), "tokens": word_counts(batch.column("text"))})
        yield from t.group_by("source").aggregate([("tokens", "sum")]).select(["source", "tokens_sum"]).rename_columns(["source", "tokens"]).to_batches()


def source_tokens(docs: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """(source, tokens): tokens of each source, runs of characters other than white space as in packing; NULL is a source of its own."""
    d = pick(docs, source=source_col, text=text_col).select("source", F.col("text").cast("string").alias("text"))
    # one row a source and batch comes out of the scan
    return d.mapInArrow(lean(_tokens_by_source), "source string, tokens bigint").groupBy("source").agg(F.sum("tokens").alias("tokens"))


def source_rates(sizes: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, tokens, rate): mean repetitions that bring each source to its share of budget.

    weights maps sources to relative shares, absent ones get none; without it, shares go with tokens ** alpha.
    budget is in tokens, by default as many as there are. A source without tokens has rate 0, as
    its documents add nothing.
    """
    share = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    if weights is not None:
        share = F.lit(0.0)
        for s, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))).otherwise(share)
    withshare = sizes.withColumn("share", F.when(F.col("tokens") > 0, share).otherwise(0.0))
    total = withshare.agg(F.sum("share").alias("all_shares"), F.sum("tokens").cast("double").alias("all_tokens"))
    want = F.lit(float(budget)) if budget is not None else F.col("all_tokens")
    rate = F.when((F.col("tokens") > 0) & (F.col("all_shares") > 0), want * F.col("share") / F.col("all_shares") / F.col("tokens")).otherwise(0.0)
    return withshare.crossJoin(F.broadcast(total)).select("source", "tokens", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shuffle: bool = True, copy_col: str | None = None) -> DataFrame:
    """docs with each row repeated by its Poisson count, in a global pseudo-random order.

    All columns stay. copy_col, if given, numbers the copies from 1 and replaces a column of that name.
    The count hashes the id, and the text's MD5 if the id is NULL; rows that agree in id are drawn alike. NULL sources are a
    source of their own. Documents of NULL or empty text take part at their source's rate; texts of any length are counted whole.
    Ids may have any type, the source is a STRING. No rate is too large. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    if dict(docs.dtypes).get(source_col) != "string":
        raise ValueError(f"{source_col!r} must be a string column")
    sizes = scratch.save(source_tokens(docs, source_col, text_col))
    # the quantile table of each source, built next to its rate
    table = scratch.save(source_rates(sizes, weights, budget, alpha).mapInPandas(_with_cdf, "rate_source string, skipped bigint, cdf array<double>"))
    table = small(table, 320 + 8 * math.ceil(table.agg(F.avg(F.size("cdf"))).first()[0] or 0.0))
    names = docs.columns
    d = docs.toDF(*[f"__p{i}" for i in range(len(names))])
    at = {n: F.col(f"__p{names.index(n)}") for n in (id_col, text_col, source_col)}
    key = F.coalesce(at[id_col].cast("string"), F.md5(F.coalesce(at[text_col], F.lit("")).cast("binary")))
    drawn = d.withColumn("__key", key).join(table, at[source_col].eqNullSafe(F.col("rate_source")))
    u = unit_hash(F.lit(str(seed)), F.col("__key"))
    copies = drawn.withColumn("__u", u).withColumn("__n", (F.when(F.col("__u") > 0, F.col("skipped")).otherwise(0) + F.size(F.filter("cdf", lambda c: c <= F.col("__u")))).cast("bigint")).where("__n > 0")
    first = F.explode(F.sequence(F.lit(1), F.col("__n"), F.lit(COPY_BLOCK))).alias("__first")
    copies = copies.select("*", first)
    out = copies.withColumn("__copy", F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + (COPY_BLOCK - 1), F.col("__n")))))
    if shuffle:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        place = F.xxhash64(F.lit(seed), F.col("__key"), F.col("__copy"))
        out = out.withColumn("__place", place).repartition(n, "__place").sortWithinPartitions("__place")
    keep = [F.col(f"__p{i}").alias(c) for i, c in enumerate(names) if copy_col is None or c.lower() != copy_col.lower()]
    return out.select(*keep, *([F.col("__copy").alias(copy_col)] if copy_col else []))


def _with_cdf(parts):
    for p in parts:
        tables = [poisson_table(float(r)) for r in p["rate"]]
        yield p.assign(rate_source=p["source"], skipped=[t[0] for t in tables], cdf=[t[1] for t in tables])[["rate_source", "skipped", "cdf"]]


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), copy_col="copy")


OP6_SQL = f"""
WITH sizes AS (SELECT source, sum(len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+'))) AS tokens FROM documents GROUP BY source),
shares AS (SELECT source, tokens, pow(tokens::DOUBLE, {ALPHA}) AS share FROM sizes),
rates AS (SELECT source, sum(tokens) OVER ()::DOUBLE * share / sum(share) OVER () / tokens AS rate FROM shares),
terms AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM (SELECT source, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 60)::BIGINT)) AS k FROM rates)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE / {1 << 52} AS u FROM documents),
counts AS (SELECT doc_id, count(*) FILTER (WHERE c <= u) AS n FROM drawn JOIN cdf USING (source) GROUP BY doc_id)
SELECT d.*, unnest(range(1, n + 1)) AS copy FROM documents d JOIN counts USING (doc_id)
"""
