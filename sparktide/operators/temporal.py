"""Topics over time: periods, distributions, normalization, gaps, trends, spikes, forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period(ts: Column, grain: str) -> Column:
    """2024, 2024Q1, 2024-01 (month), 01-2024 (month_first) or 2024-01-01/2024-01-07 (week, Monday to Sunday)."""
    monday = F.date_trunc("week", ts).cast("date")
    return {
        "year": F.year(ts).cast("string"),
        "quarter": F.concat(F.year(ts), F.lit("Q"), F.quarter(ts)),
        "month": F.date_format(ts, "yyyy-MM"),
        "month_first": F.date_format(ts, "MM-yyyy"),
        "week": F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string")),
    }[grain]


def period_order(p: Column) -> Column:
    """First day of a period string, for chronological order."""
    return (
        F.when(p.rlike("^\\d{4}$"), F.to_date(F.concat(p, F.lit("-01-01"))))
        .when(p.rlike("^\\d{4}Q\\d$"), F.make_date(F.substring(p, 1, 4).cast("int"), (F.substring(p, 6, 1).cast("int") - 1) * 3 + 1, F.lit(1)))
        .when(p.rlike("^\\d{2}-\\d{4}$"), F.make_date(F.substring(p, 4, 4).cast("int"), F.substring(p, 1, 2).cast("int"), F.lit(1)))
        .when(p.rlike("^\\d{4}-\\d{2}$"), F.to_date(F.concat(p, F.lit("-01"))))
        .otherwise(F.to_date(F.substring(p, 1, 10)))
    )


def weighted_distribution(w: DataFrame, times: DataFrame, grain: str = "quarter") -> DataFrame:
    """(period, topic_id, value): sums of the documents' weights scaled to 1; zero rows add nothing."""
    share = F.col("weight") / F.nullif(F.sum("weight").over(Window.partitionBy("doc_id")), F.lit(0.0))
    return w.withColumn("share", share).join(times, "doc_id").groupBy(period(F.col("ts"), grain).alias("period"), "topic_id").agg(F.sum("share").alias("value"))


def count_distribution(dominant: DataFrame, times: DataFrame, k: int, grain: str = "quarter") -> DataFrame:
    """(period, topic_1, ..., topic_k): documents by dominant topic, 0 where there are none."""
    d = dominant.where("topic_id > 0").join(times, "doc_id").withColumn("period", period(F.col("ts"), grain))
    wide = d.groupBy("period").pivot("topic_id", list(range(1, k + 1))).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select("period", *[F.col(str(i)).alias(f"topic_{i}") for i in range(1, k + 1)])


def percentages(dist: DataFrame) -> DataFrame:
    """Values as a percentage of their period; a period of zeros stays 0."""
    total = F.sum("value").over(Window.partitionBy("period"))
    return dist.withColumn("value", 100 * F.col("value") / F.when(total == 0, 1.0).otherwise(total))


def z_scores(dist: DataFrame) -> DataFrame:
    """Values as sample z-scores of their topic; 0 where the deviation is 1e-10 or less."""
    t = Window.partitionBy("topic_id")
    s = F.stddev_samp("value").over(t)
    return dist.withColumn("value", F.when(s > 1e-10, (F.col("value") - F.avg("value").over(t)) / s).otherwise(0.0))


def fill_years(dist: DataFrame) -> DataFrame:
    """(year, topic_id, value) with 0 for every year between the first and the last that a topic lacks."""
    ends = dist.agg(F.min("year").alias("a"), F.max("year").alias("b"))
    grid = ends.select(F.explode(F.sequence("a", "b")).alias("year")).crossJoin(dist.select("topic_id").distinct())
    return grid.join(dist, ["year", "topic_id"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast(dict(dist.dtypes)["value"])))


def sparse_periods(dist: DataFrame, least: float = 3) -> DataFrame:
    """(period, total) of periods that total less than `least`."""
    return dist.groupBy("period").agg(F.sum("value").alias("total")).where(F.col("total") < least)


def trends(dist: DataFrame) -> DataFrame:
    """(topic_id, total, peak_period, mean_change, trend) of (period, topic_id, value).

    By the last 3 relative changes (from 0 up is 1): emerging if 60 % exceed 0.1 and so does the mean, declining likewise
    down, else stable if the mean is below 0.15, else volatile; insufficient with fewer than 2 changes.
    """
    w = Window.partitionBy("topic_id").orderBy("ord")
    d = dist.withColumn("ord", period_order(F.col("period"))).withColumn("last", F.lag("value").over(w))
    change = F.when(F.col("last").isNull(), None).when(F.col("last") == 0, F.when(F.col("value") > 0, 1.0).otherwise(0.0)).otherwise((F.col("value") - F.col("last")) / F.col("last"))
    d = d.withColumn("c", change).withColumn("r", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("ord"))))
    recent = F.when((F.col("r") <= 3) & F.col("c").isNotNull(), F.col("c"))
    a = d.groupBy("topic_id").agg(
        F.sum("value").alias("total"), F.max_by("period", F.struct("value", -F.unix_date("ord"))).alias("peak_period"), F.count("c").alias("n"), F.avg(recent).alias("mean_change"),
        F.avg((recent > 0.1).cast("double")).alias("up"), F.avg((recent < -0.1).cast("double")).alias("down"),
    )
    trend = (
        F.when(F.col("n") < 2, "insufficient").when((F.col("up") >= 0.6) & (F.col("mean_change") > 0.1), "emerging")
        .when((F.col("down") >= 0.6) & (F.col("mean_change") < -0.1), "declining").when(F.abs("mean_change") < 0.15, "stable").otherwise("volatile")
    )
    return a.select("topic_id", "total", "peak_period", "mean_change", trend.alias("trend"))


def spikes(dist: DataFrame) -> DataFrame:
    """(period, total, topics): periods above mean + 1.5 sample deviations, with the topics above 1.5 times their own mean."""
    total = dist.groupBy("period").agg(F.sum("value").alias("total"))
    everything = Window.partitionBy()
    high = total.withColumn("lim", F.avg("total").over(everything) + 1.5 * F.stddev_samp("total").over(everything)).where("total > lim").select("period", "total")
    hot = dist.withColumn("m", F.avg("value").over(Window.partitionBy("topic_id"))).where("value > 1.5 * m")
    return high.join(hot.groupBy("period").agg(F.array_sort(F.collect_list("topic_id")).alias("topics")), "period", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<int>")))


def repeated_points(dist: DataFrame) -> DataFrame:
    """(topic_id, decimal_year): each quarter of a topic as often as its whole value says, for violins."""
    y = F.substring("period", 1, 4).cast("int") + (F.substring("period", 6, 1).cast("int") - 1) / 4
    return dist.where("value >= 1").select("topic_id", y.alias("decimal_year"), F.explode(F.sequence(F.lit(1), F.col("value").cast("int"))).alias("i")).drop("i")


def interpolated(dist: DataFrame, steps: int = 10) -> DataFrame:
    """(topic_id, x, value): each topic's periods, numbered from 0, with `steps` linear points to the next."""
    w = Window.partitionBy("topic_id").orderBy("ord")
    d = dist.withColumn("ord", period_order(F.col("period"))).withColumn("i", F.row_number().over(w) - 1).withColumn("next", F.lead("value").over(w))
    d = d.withColumn("j", F.explode(F.when(F.col("next").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(steps - 1)))))
    return d.select("topic_id", (F.col("i") + F.col("j") / steps).alias("x"), (F.col("value") + F.coalesce(F.col("next") - F.col("value"), F.lit(0.0)) * F.col("j") / steps).alias("value"))


def missing_quarters(dist: DataFrame) -> DataFrame:
    """(quarter_start): quarters between the first and last period that have no row."""
    q = dist.select(period_order(F.col("period")).alias("q")).distinct()
    grid = q.agg(F.min("q").alias("a"), F.max("q").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 3 MONTHS"))).alias("q"))
    return grid.join(q, "q", "left_anti").select(F.col("q").alias("quarter_start"))


def forecast(dist: DataFrame, ahead: int = 4, order: int = 2, ridge: float = 1.0) -> DataFrame:
    """(topic_id, step, yhat, lower, upper) of quarterly values: trend and yearly Fourier terms by ridge regression, 95 % interval.

    One group is one topic's series, which is short.
    """

    def design(t: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(t)), t, *[f(2 * np.pi * k * t / 4) for k in range(1, order + 1) for f in (np.sin, np.cos)]])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y = p.sort_values("ord")["value"].to_numpy(dtype=float)
        t = np.arange(len(y), dtype=float)
        x = design(t)
        penalty = ridge * np.eye(x.shape[1])
        penalty[0, 0] = 0
        beta = np.linalg.solve(x.T @ x + penalty + 1e-9 * np.eye(len(penalty)), x.T @ y)
        wide = 1.96 * (np.std(y - x @ beta, ddof=1) if len(y) > 1 else 0.0)
        new = design(len(y) + np.arange(ahead, dtype=float)) @ beta
        return pd.DataFrame({"topic_id": p["topic_id"].iloc[0], "step": range(1, ahead + 1), "yhat": new, "lower": new - wide, "upper": new + wide})

    d = dist.select("topic_id", period_order(F.col("period")).alias("ord"), F.col("value").cast("double").alias("value"))
    return d.groupBy("topic_id").applyInPandas(run, "topic_id int, step int, yhat double, lower double, upper double")


def error_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: mae, rmse, mape (%), r2."""
    a, e = F.col(actual), F.col(actual) - F.col(predicted)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.abs(e / (a + 1e-10)))).alias("mape"), (1 - F.sum(e * e) / F.nullif(F.var_pop(a) * F.count(a), F.lit(0.0))).alias("r2"))


def with_forecast(history: DataFrame, future: DataFrame) -> DataFrame:
    """(topic_id, step, value, lower, upper, is_forecast): history at steps up to 0, then the forecast."""
    w = Window.partitionBy("topic_id").orderBy(F.desc("ord"))
    h = history.withColumn("ord", period_order(F.col("period"))).select("topic_id", (1 - F.row_number().over(w)).alias("step"), F.col("value").cast("double").alias("value"))
    h = h.select("*", F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), F.lit(False).alias("is_forecast"))
    return h.unionByName(future.select("topic_id", "step", F.col("yhat").alias("value"), "lower", "upper", F.lit(True).alias("is_forecast")))


def trend_summary(before: Column, after: Column) -> Column:
    """increasing or decreasing beyond 10 %, else stable."""
    c = (after - before) / F.nullif(before, F.lit(0.0))
    return F.when(c > 0.1, "increasing").when(c < -0.1, "decreasing").otherwise("stable")
