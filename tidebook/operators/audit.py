"""Table audits, coverage and column profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.quantiles import percentile_columns
from tidebook.sources.settle import small_side

#: Hashes that several rows have are sent to all rows up to this number.
SHARED_HASHES = 1_000_000


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def audit_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """rows, columns, duplicate_rows, missing_cells and the column list of every table.

    Only a hash of each row is shuffled; whole rows are compared (nulls equal nulls) where several
    share a hash. Those hashes are stored first, so that the other rows stay where they are.
    """

    def one(name: str, df: DataFrame) -> DataFrame:
        hashed = df.withColumn("_h", F.xxhash64(*df.columns))
        shared = small_side(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), SHARED_HASHES)
        equal = hashed.join(shared, "_h", "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
        duplicates = equal.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("d")).scalar()
        missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in df.columns])
        return df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"),
        ).withColumn("duplicate_rows", duplicates).select(
            F.lit(name).alias("table"),
            "rows",
            F.lit(len(df.columns)).cast("long").alias("columns"),
            "duplicate_rows",
            "missing_cells",
            F.lit(", ".join(df.columns)).alias("columns_list"),
        )

    return _union([one(name, df) for name, df in tables.items()])


def missing_by_column(tables: Mapping[str, DataFrame], top: int = 15) -> DataFrame:
    """Per table, the columns with missing values, most first, at most ``top`` each."""

    def one(name: str, df: DataFrame) -> DataFrame:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        tall = counts.unpivot([], df.columns, "column", "missing").where("missing > 0")
        return tall.orderBy(F.desc("missing"), "column").limit(top).select(F.lit(name).alias("table"), "column", "missing")

    return _union([one(name, df) for name, df in tables.items()])


def coverage(orders: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    """First and last day, span and active days per scope (all / delivered) and year.

    One pass: orders are counted per (day, delivered) and both scopes read that small table.
    """
    daily = (
        orders.where(F.col(ts).isNotNull())
        .groupBy(F.to_date(ts).alias("day"), F.coalesce(F.col("order_status") == "delivered", F.lit(False)).alias("done"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    scopes = F.explode(F.when(F.col("done"), F.array(F.lit("all_orders"), F.lit("delivered"))).otherwise(F.array(F.lit("all_orders"))))
    grouped = (
        daily.withColumn("scope", scopes)
        .groupBy("scope", F.year("day").alias("year"))
        .agg(
            F.sum("n").alias("orders"),
            F.min("day").alias("first_order"),
            F.max("day").alias("last_order"),
            F.countDistinct("day").alias("active_days"),
        )
    )
    new_year = F.make_date(F.col("year"), F.lit(1), F.lit(1))
    year_end = F.make_date(F.col("year"), F.lit(12), F.lit(31))
    return grouped.select(
        "scope", "year", "orders", "first_order", "last_order",
        (F.datediff("last_order", "first_order") + 1).alias("span_days"),
        "active_days",
        F.dayofyear(year_end).alias("calendar_days"),
        F.datediff("first_order", new_year).alias("missing_before"),
        F.datediff(year_end, "last_order").alias("missing_after"),
    )


def year_month_matrix(orders: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    """Distinct delivered orders, one row per year and twelve zero-filled month columns."""
    done = orders.where((F.col("order_status") == "delivered") & F.col(ts).isNotNull())
    monthly = done.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month")).agg(F.countDistinct("order_id").alias("n"))
    wide = monthly.groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("n"))
    return wide.na.fill(0).select("year", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])


def count_describe(df: DataFrame, key: str) -> DataFrame:
    """describe() of the number of rows per key: count, mean, std, min, quartiles, max."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    basic = sizes.agg(
        F.count(F.lit(1)).cast("double").alias("count"), F.avg("size").alias("mean"), F.stddev_samp("size").alias("std"),
        F.min("size").cast("double").alias("min"), F.max("size").cast("double").alias("max"),
    )
    return _described(basic, sizes, "size")


def describe(df: DataFrame, value: str) -> DataFrame:
    """describe() of a numeric column as (statistic, value) rows."""
    x = F.col(value).cast("double")
    basic = df.agg(F.count(x).cast("double").alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return _described(basic, df, value)


def _described(basic: DataFrame, source: DataFrame, value: str) -> DataFrame:
    quartiles = percentile_columns(source, value, {"25%": 0.25, "50%": 0.5, "75%": 0.75})
    tall = lambda d: d.unpivot([], d.columns, "statistic", "value")
    return tall(basic).unionByName(tall(quartiles))


def status_counts(orders: DataFrame) -> DataFrame:
    """Distinct orders and customers per status."""
    return orders.groupBy("order_status").agg(
        F.countDistinct("order_id").alias("orders_count"), F.countDistinct("customer_id").alias("customers_count")
    )


def value_summary(df: DataFrame, value: str) -> DataFrame:
    """One row: min, max, mean and median."""
    x = F.col(value).cast("double")
    median = percentile_columns(df, value, {"m": 0.5}).scalar()
    return df.agg(F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.avg(x).alias("avg_value")).withColumn("median_value", median)


def log_value_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population skewness and excess kurtosis of log(x + 1), one row per column."""
    aggs = []
    for c in columns:
        y = F.log(F.col(c) + 1)
        aggs.append(F.struct(F.lit(c).alias("column"), F.skewness(y).alias("skewness"), F.kurtosis(y).alias("excess_kurtosis")))
    return df.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))


def shifted_logs(df: DataFrame, value: str) -> DataFrame:
    """Add the three shifted logarithms used for distribution checks."""
    x = F.col(value)
    positive = F.when(x != 0, x)
    return df.withColumns({f"{value}_log_1p5": F.log(x + 1.5), f"{value}_log_p1": F.log(x + 1), f"{value}_log_then_1": F.log(positive) + 1})


def outliers(df: DataFrame, value: str, k: float = 2.5) -> DataFrame:
    """Rows above mean + k sample standard deviations, with the bound."""
    bound = df.agg((F.avg(value) + F.lit(k) * F.stddev_samp(value)).alias("b")).scalar()
    return df.withColumn("outlier_bound", bound).where(F.col(value) > F.col("outlier_bound"))
