"""Expensive goods: price thresholds, revenue concentration, event window, installments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidebook.functions.quantiles import percentile_columns, percentiles_struct
from tidebook.functions.scalar import is_true, safe_div, sum0
from tidebook.operators.enrich import CATEGORY, delivered
from tidebook.operators.granularity import category_items
from tidebook.operators.impact import with_period

# Threshold labels and the price quantile each stands for.
THRESHOLDS = {"top5": 0.95, "top10": 0.90, "top15": 0.85, "top20": 0.80}
PERIODS = {
    "month": ("month", "year_month"),
    "quarter": ("quarter",),
    "week": ("week",),
    "weekday": ("weekday", "weekday_name"),
}
LARGE_COLUMNS = (
    CATEGORY, "year", "is_delivered", "month", "year_month", "quarter", "week", "weekday", "weekday_name",
    "order_date", "order_id", "order_item_id", "price", "payment_installments",
)


def with_price_cuts(items: DataFrame) -> DataFrame:
    """Attach the four price thresholds (a scalar subquery over the items themselves)."""
    return items.withColumn("_cut", percentiles_struct(items, "price", THRESHOLDS))


def _is_large(label: str) -> Column:
    return is_true(F.col("price") >= F.col(f"_cut.{label}"))


def price_thresholds(enriched: DataFrame, year: int = 2017) -> DataFrame:
    """Per threshold: minimum price, items, revenue and their shares."""
    items = with_price_cuts(delivered(enriched, year))
    one = items.agg(
        F.count(F.lit(1)).alias("_items"),
        sum0("price").alias("_revenue"),
        *[F.count_if(_is_large(t)).alias(f"_n_{t}") for t in THRESHOLDS],
        *[sum0(F.when(_is_large(t), F.col("price"))).alias(f"_r_{t}") for t in THRESHOLDS],
        *[F.max(F.col(f"_cut.{t}")).alias(f"_c_{t}") for t in THRESHOLDS],
    )
    rows = [
        F.struct(
            F.lit(t).alias("threshold"),
            F.lit(q).alias("price_quantile"),
            F.col(f"_c_{t}").alias("min_item_price"),
            F.col(f"_n_{t}").alias("items_count"),
            safe_div(f"_n_{t}", "_items").alias("items_share"),
            F.col(f"_r_{t}").alias("revenue"),
            safe_div(f"_r_{t}", "_revenue").alias("revenue_share"),
        )
        for t, q in THRESHOLDS.items()
    ]
    return one.select(F.inline(F.array(*rows)))


def large_by_period(enriched: DataFrame, grain: str, year: int = 2017) -> DataFrame:
    """Revenue of expensive goods per period for all four thresholds in one pass.

    The final windows run over the periods of one year, at most 54 rows.
    """
    keys = list(PERIODS[grain])
    items = delivered(enriched, year)
    cut = with_price_cuts(items)
    grouped = cut.groupBy(*keys).agg(
        F.countDistinct("order_id").alias("orders_count"),
        F.count("order_item_id").alias("items_count"),
        sum0("price").alias("total_revenue"),
        F.avg("price").alias("avg_item_price"),
        *[F.count_if(_is_large(t)).alias(f"large_items_count_{t}") for t in THRESHOLDS],
        *[sum0(F.when(_is_large(t), F.col("price"))).alias(f"large_revenue_{t}") for t in THRESHOLDS],
    )
    medians = percentile_columns(items, "price", {"median_item_price": 0.5}, keys[:1])
    joined = grouped.alias("g").join(
        medians.withColumnRenamed(keys[0], "_key"), F.col(keys[0]).eqNullSafe(F.col("_key")), "left"
    ).drop("_key")
    columns = [*keys, "orders_count", "items_count", "total_revenue", "avg_item_price", "median_item_price"]
    whole = W.partitionBy()
    shares: list[Column] = []
    for t in THRESHOLDS:
        shares += [
            F.col(f"large_items_count_{t}"),
            F.col(f"large_revenue_{t}"),
            safe_div(f"large_items_count_{t}", "items_count").alias(f"large_items_share_{t}"),
            safe_div(f"large_revenue_{t}", "total_revenue").alias(f"large_revenue_share_of_period_{t}"),
            safe_div(f"large_revenue_{t}", F.sum(f"large_revenue_{t}").over(whole)).alias(f"large_revenue_distribution_{t}"),
        ]
    return joined.select(*columns, *shares)


# Segment captions.
SEGMENTS = {
    "all_revenue_distribution": "All purchases",
    "large_revenue_distribution_top20": "Top-20% expensive goods",
    "large_revenue_distribution_top10": "Top-10% expensive goods",
}


def weekday_distribution(by_weekday: DataFrame) -> DataFrame:
    """Weekday distribution of all, top-20% and top-10% revenue in long form."""
    share = safe_div("total_revenue", F.sum("total_revenue").over(W.partitionBy()))
    wide = by_weekday.withColumn("all_revenue_distribution", share)
    caption = F.create_map(*[F.lit(x) for pair in SEGMENTS.items() for x in pair])
    return wide.unpivot(["weekday", "weekday_name"], list(SEGMENTS), "segment", "revenue_distribution").withColumn(
        "segment", caption[F.col("segment")]
    )


def top_large_months(by_month: DataFrame, n: int = 5) -> DataFrame:
    return by_month.orderBy(F.desc("large_revenue_distribution_top10"), "month").limit(n)


def event_window(enriched: DataFrame, first: str = "2017-10-15", last: str = "2017-12-15", year: int = 2017) -> DataFrame:
    """Daily revenue of all, top-10% and top-20% goods between two dates of the year."""
    window = with_price_cuts(delivered(enriched, year)).where(F.col("order_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return window.groupBy("order_date").agg(
        sum0("price").alias("all_revenue"),
        sum0(F.when(_is_large("top10"), F.col("price"))).alias("top10_revenue"),
        sum0(F.when(_is_large("top20"), F.col("price"))).alias("top20_revenue"),
    )


def event_window_long(window: DataFrame) -> DataFrame:
    return window.unpivot(["order_date"], ["all_revenue", "top10_revenue", "top20_revenue"], "segment", "revenue")


def category_mix(enriched: DataFrame, ranking: DataFrame, monthly: DataFrame, year: int = 2017) -> DataFrame:
    """Revenue of top-10% goods per category in peak and normal months, with share of period."""
    expensive = with_price_cuts(category_items(enriched, year)).where(_is_large("top10"))
    by_month = expensive.groupBy("category", "month").agg(
        sum0("price").alias("_revenue"), F.count("order_item_id").alias("_items")
    )
    mix = with_period(by_month, ranking, monthly).groupBy("period_type", "category").agg(
        F.sum("_revenue").alias("top10_expensive_revenue"), F.sum("_items").alias("top10_expensive_items")
    )
    total = F.sum("top10_expensive_revenue").over(W.partitionBy("period_type"))
    return mix.withColumn("period_revenue_share", safe_div("top10_expensive_revenue", total))


def top_mix_categories(mix: DataFrame, n: int = 10) -> DataFrame:
    return mix.groupBy("category").agg(F.sum("top10_expensive_revenue").alias("top10_expensive_revenue")).orderBy(
        F.desc("top10_expensive_revenue"), "category"
    ).limit(n)


def installments_by_month(enriched: DataFrame, year: int = 2017) -> DataFrame:
    """Mean installments and share of six or more, for all and for top-10% goods."""
    large, inst = _is_large("top10"), F.col("payment_installments")
    six = is_true(inst >= 6).cast("double")
    return with_price_cuts(delivered(enriched, year)).groupBy("month").agg(
        F.avg(inst).alias("all_avg_installments"),
        F.avg(six).alias("all_share_installments_6_plus"),
        F.avg(F.when(large, inst)).alias("top10_avg_installments"),
        F.avg(F.when(large, six)).alias("top10_share_installments_6_plus"),
    )


def installments_long(by_month: DataFrame) -> DataFrame:
    """Long form with a measure and a segment label read off the metric name."""
    metrics = [c for c in by_month.columns if c != "month"]
    tall = by_month.unpivot(["month"], metrics, "metric", "value")
    return tall.withColumns(
        {
            "measure": F.when(F.contains("metric", F.lit("avg")), "Average installments").otherwise("Share with 6+ installments"),
            "segment": F.when(F.startswith("metric", F.lit("top10")), "Top-10% expensive goods").otherwise("All purchases"),
        }
    )
