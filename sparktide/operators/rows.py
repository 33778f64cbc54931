"""Row-level operators of the input stage: filters, column choice, timestamps, duplicates, NULLs, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATETIME_COLUMNS = ("year", "date", "datetime", "timestamp", "time", "rev_submit_millis_since_epoch", "created_at", "updated_at")
_MONTHS = ("january february march april may june july august september october november december").split()
MONTHS = {m: i for i, m in enumerate(_MONTHS, 1)} | {m[:3]: i for i, m in enumerate(_MONTHS, 1)} | {"sept": 9}


def filter_year(df: DataFrame, column: str = "year", max_year: int = 2025) -> DataFrame:
    """Rows up to max_year; rows without a year go."""
    return df.where(F.col(column) <= max_year)


def filter_equal_ci(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column equals value but for case; without the column, all rows."""
    return df.where(F.upper(F.col(column)) == F.upper(F.lit(value))) if column in df.columns else df


def filter_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column equals value; without the column, all rows."""
    return df.where(F.col(column) == F.lit(value)) if column in df.columns else df


def first_datetime_column(df: DataFrame, given: str | None = None) -> str | None:
    """The given datetime column, or the first of the usual names that is there."""
    return given or next((c for c in DATETIME_COLUMNS if c in df.columns), None)


def keep_columns(df: DataFrame, text: str, datetime: str | None = None, weight: str | None = None) -> DataFrame:
    """The text column and, if given, the time and weight columns."""
    return df.select(*dict.fromkeys(c for c in (text, datetime, weight) if c))


def month_number(month: Column) -> Column:
    """Month of a name, an abbreviation or a number 1 to 12; January for all else."""
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    number = F.try_to_number(F.trim(month.cast("string")), F.lit("99")).cast("int")
    number = F.when((number >= 1) & (number <= 12), number)
    return F.coalesce(table[F.lower(F.trim(month.cast("string")))], number, F.lit(1))


def year_month_timestamp(year: Column, month: Column) -> Column:
    """First day of the month."""
    return F.make_date(year.cast("int"), month_number(month), F.lit(1)).cast("timestamp")


def epoch_timestamp(value: Column) -> Column:
    """Timestamp of a number: a year (1900 to 2100), else milliseconds above 10^12, seconds above 10^9, else NULL."""
    v = value.cast("double")
    return (
        F.when((v >= 1900) & (v <= 2100), F.make_date(v.cast("int"), F.lit(1), F.lit(1)).cast("timestamp"))
        .when(v > 1e12, F.timestamp_millis(v.cast("bigint")))
        .when(v > 1e9, F.timestamp_seconds(v.cast("bigint")))
    )


def drop_repeated_rows(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """One row for each combination of columns (NULLs equal): with `order`, the least of it."""
    if order is None:
        return df.dropDuplicates(columns)
    w = Window.partitionBy(*columns).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls, total): one row per column, from one pass."""
    one = df.agg(F.count(F.lit(1)).alias("__total"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__{i}") for i, c in enumerate(df.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__{i}").alias("nulls")) for i, c in enumerate(df.columns)])
    return one.select(F.explode(pairs).alias("x"), "__total").select("x.column_name", "x.nulls", F.col("__total").alias("total"))


def check_rows(before: int, after: int) -> str | None:
    """ValueError if nothing is left, a warning if less than a tenth is."""
    if after == 0:
        raise ValueError("no rows are left after cleaning")
    return f"only {after} of {before} rows are left" if after < 0.1 * before else None


def rank_weight(df: DataFrame, column: str, out: str = "weight") -> DataFrame:
    """Weight 1 to 2 by min-max scaling of the column; 1.5 if it is constant. One row of extremes is broadcast."""
    ends = df.agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
    w = F.when(F.col("__hi") == F.col("__lo"), 1.5).otherwise(1 + (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.when(F.col(column).isNotNull(), w)).drop("__lo", "__hi")


def drop_far_points(df: DataFrame, x: str = "x", y: str = "y", share: float = 0.95, least: int = 10) -> DataFrame:
    """Points whose distance from the median point is within the given percentile; all of `least` points or fewer."""
    mid = df.agg(F.percentile(x, F.lit(0.5)).alias("__mx"), F.percentile(y, F.lit(0.5)).alias("__my"), F.count(F.lit(1)).alias("__n"))
    d = df.crossJoin(F.broadcast(mid)).withColumn("__d", F.sqrt(F.pow(F.col(x) - F.col("__mx"), F.lit(2)) + F.pow(F.col(y) - F.col("__my"), F.lit(2))))
    far = d.agg(F.percentile("__d", F.lit(share)).alias("__far"))
    return d.crossJoin(F.broadcast(far)).where((F.col("__n") <= least) | (F.col("__d") <= F.col("__far"))).drop("__mx", "__my", "__n", "__d", "__far")


def grid_sample(df: DataFrame, n: int, x: str = "x", y: str = "y", group: str = "topic_id", order: str = "doc_id") -> DataFrame:
    """About n points that keep the picture: of each cell of a sqrt(2n) by sqrt(2n) grid and each group its share, one at least.

    Which ones is decided by a hash of `order`, so the sample is the same in every run. All points if there are n or fewer.
    """
    side = max(1, round((2 * n) ** 0.5))
    ends = df.agg(*[f(c).alias(f"__{k}_{c}") for c in (x, y) for k, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("__all"))

    def cell(c: str) -> Column:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        return F.least(F.floor((F.col(c) - lo) / F.when(hi > lo, hi - lo).otherwise(1.0) * side), F.lit(side - 1))

    d = df.crossJoin(F.broadcast(ends)).withColumn("__cx", cell(x)).withColumn("__cy", cell(y))
    by = Window.partitionBy("__cx", "__cy", group)
    d = d.withColumn("__n", F.count(F.lit(1)).over(by)).withColumn("__r", F.row_number().over(by.orderBy(F.xxhash64(order), order)))
    kept = d.where((F.col("__all") <= n) | (F.col("__r") <= F.greatest(F.lit(1), F.round(F.col("__n") * n / F.col("__all")))))
    return kept.select(*[F.col(c) for c in df.columns])
