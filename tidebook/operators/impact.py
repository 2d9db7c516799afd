"""Peak versus normal months of the seasonal categories.

Being in a peak month is a property of (category, month). The item rows are therefore first
aggregated to (category, month) and only then meet the peak list; no item-grain join on the
skewed category is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidebook.functions.quantiles import percentile_scalar
from tidebook.functions.scalar import safe_div, share_true, sum0
from tidebook.operators.enrich import CATEGORY, UNKNOWN, delivered
from tidebook.operators.granularity import category_items
from tidebook.operators.metrics import order_payments
from tidebook.operators.seasonality import eligible, orders_by_month
from tidebook.sources.settle import small_side

PEAK, NORMAL = "peak_months", "normal_months"
PEAK_INDEX = 1.25
IMPACT_COLUMNS = (
    CATEGORY, "month", "year", "is_delivered", "order_id", "order_item_id", "price", "payment_value",
    "payment_installments", "freight_share", "delivery_time_days", "review_score", "is_low_review",
)


def seasonal_threshold(ranking: DataFrame) -> Column:
    """P75 of the scores of eligible categories (one row per category)."""
    return eligible(ranking).agg(F.percentile("seasonality_score", 0.75).alias("t")).scalar()


def seasonal_categories(ranking: DataFrame) -> DataFrame:
    """Eligible categories in the top quarter by score."""
    return eligible(ranking).where(F.col("seasonality_score") >= seasonal_threshold(ranking))


def peak_keys(ranking: DataFrame, monthly: DataFrame) -> DataFrame:
    """(category, month) pairs of seasonal categories whose seasonal index is at least 1.25."""
    return (
        monthly.where(F.col("seasonal_index") >= PEAK_INDEX)
        .join(seasonal_categories(ranking).select("category"), "category", "left_semi")
        .select("category", "month")
    )


def with_period(by_month: DataFrame, ranking: DataFrame, monthly: DataFrame) -> DataFrame:
    """Keep the seasonal categories of a (category, month) table and label their period."""
    labels = (
        monthly.join(seasonal_categories(ranking).select("category"), "category", "left_semi")
        .select(
            "category", "month",
            F.when(F.col("seasonal_index") >= PEAK_INDEX, PEAK).otherwise(NORMAL).alias("period_type"),
        )
    )
    return by_month.join(labels, ["category", "month"], "inner")


def peak_flagged_counts(enriched: DataFrame, ranking: DataFrame, monthly: DataFrame, year: int | None = None) -> DataFrame:
    """Items, orders and revenue of the seasonal categories by category and period."""
    by_month = (
        delivered(enriched, year)
        .groupBy(F.col(CATEGORY).alias("category"), "month")
        .agg(
            F.countDistinct("order_id").alias("orders_count"),
            F.count("order_item_id").alias("items_sold"),
            sum0("price").alias("revenue"),
        )
    )
    return with_period(by_month, ranking, monthly).groupBy("category", "period_type").agg(
        F.sum("items_sold").alias("items_sold"), F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("months")
    )


def seasonal_items(enriched: DataFrame, ranking: DataFrame, year: int | None = None) -> DataFrame:
    """Delivered items that belong to a seasonal category; the list is broadcast if small."""
    names = small_side(seasonal_categories(ranking).select("category"))
    return delivered(enriched, year).withColumn("category", F.col(CATEGORY)).join(names, "category", "left_semi")


IMPACT_METRICS = {
    "monthly_orders_per_category": "orders_count",
    "monthly_items_per_category": "items_sold",
    "monthly_revenue_per_category": "revenue",
    "avg_order_value": "avg_order_value",
    "avg_item_price": "avg_item_price",
    "large_purchase_share": "large_purchase_share",
    "avg_payment_installments": "avg_payment_installments",
    "share_installments_6_plus": "share_installments_6_plus",
    "freight_share": "freight_share",
    "avg_delivery_time_days": "avg_delivery_time_days",
    "avg_review_score": "avg_review_score",
    "share_low_reviews": "share_low_reviews",
}


def business_impact(
    enriched: DataFrame, ranking: DataFrame, monthly: DataFrame, daily: DataFrame, payments: DataFrame | None = None
) -> DataFrame:
    """Mean category-month in peak and normal months, all years, one row per metric.

    Distinct orders are added up from the daily table, so the items combine before they are shuffled.
    """
    source = order_payments(enriched) if payments is None else payments
    p90 = percentile_scalar(source, "payment_value", 0.9)
    by_month = (
        delivered(enriched)
        .withColumn("_p90", p90)
        .groupBy(F.col(CATEGORY).alias("category"), "month")
        .agg(
            F.count("order_item_id").alias("items_sold"),
            sum0("price").alias("revenue"),
            F.avg("payment_value").alias("avg_order_value"),
            F.avg("price").alias("avg_item_price"),
            share_true(F.col("payment_value") >= F.col("_p90")).alias("large_purchase_share"),
            F.avg("payment_installments").alias("avg_payment_installments"),
            share_true(F.col("payment_installments") >= 6).alias("share_installments_6_plus"),
            F.avg("freight_share").alias("freight_share"),
            F.avg("delivery_time_days").alias("avg_delivery_time_days"),
            F.avg("review_score").alias("avg_review_score"),
            share_true(F.col("is_low_review")).alias("share_low_reviews"),
        )
    )
    counted = with_period(by_month, ranking, monthly).join(orders_by_month(daily), ["category", "month"])
    periods = counted.groupBy("period_type").agg(
        *[F.avg(source).alias(metric) for metric, source in IMPACT_METRICS.items()]
    )
    tall = periods.unpivot(["period_type"], list(IMPACT_METRICS), "metric", "value")
    return _compare(tall, ["metric"])


def _compare(tall: DataFrame, keys: list[str]) -> DataFrame:
    at = lambda p: F.max(F.when(F.col("period_type") == p, F.col("value"))).alias(p)
    return tall.groupBy(*keys).agg(at(NORMAL), at(PEAK)).withColumns(
        {
            "delta_abs": F.col(PEAK) - F.col(NORMAL),
            "delta_pct": safe_div(PEAK, NORMAL) - 1,
        }
    )


UPLIFT_METRICS = (
    "orders_count", "revenue", "avg_item_price", "large_purchase_share", "avg_payment_installments",
    "avg_delivery_time_days", "avg_review_score",
)


def labelled_orders_by_month(items: DataFrame, daily: DataFrame, year: int) -> DataFrame:
    """Distinct orders per (category, month) with unnamed categories pooled.

    Named categories add up from the daily table. The pool may hold an order under no category
    and under the pool's name, so its orders are counted from its own items.
    """
    named = orders_by_month(daily.where(F.col("category") != UNKNOWN), year)
    pooled = items.where(F.col("category") == UNKNOWN).groupBy("category", "month").agg(F.countDistinct("order_id").alias("orders_count"))
    return named.unionByName(pooled)


def impact_by_month(enriched: DataFrame, ranking: DataFrame, monthly: DataFrame, daily: DataFrame, year: int = 2017) -> DataFrame:
    """Category-months of one year with their period and eight measures."""
    items = category_items(enriched, year)
    p90 = percentile_scalar(items, "price", 0.9)
    by_month = (
        items.withColumn("_p90", p90)
        .groupBy("category", "month")
        .agg(
            F.count("order_item_id").alias("items_sold"),
            sum0("price").alias("revenue"),
            F.avg("price").alias("avg_item_price"),
            share_true(F.col("price") >= F.col("_p90")).alias("large_purchase_share"),
            F.avg("payment_installments").alias("avg_payment_installments"),
            F.avg("delivery_time_days").alias("avg_delivery_time_days"),
            F.avg("review_score").alias("avg_review_score"),
        )
    )
    counted = with_period(by_month, ranking, monthly).join(labelled_orders_by_month(items, daily, year), ["category", "month"])
    return counted.withColumn("items_per_order", safe_div("items_sold", "orders_count"))


def category_uplift(by_month: DataFrame) -> DataFrame:
    """Peak against normal months per category and metric; both periods must occur."""
    means = by_month.groupBy("category", "period_type").agg(*[F.avg(m).cast("double").alias(m) for m in UPLIFT_METRICS])
    both = F.count(F.lit(1)).over(W.partitionBy("category")) == 2
    tall = means.withColumn("_both", both).where("_both").unpivot(["category", "period_type"], list(UPLIFT_METRICS), "metric", "value")
    return _compare(tall, ["category", "metric"])


def revenue_decomposition(by_month: DataFrame) -> DataFrame:
    """Mean orders, items per order, item price and revenue per period."""
    return by_month.groupBy("period_type").agg(
        *[F.avg(m).alias(m) for m in ("orders_count", "items_per_order", "avg_item_price", "revenue")]
    )


def decomposition_long(decomposition: DataFrame) -> DataFrame:
    metrics = [c for c in decomposition.columns if c != "period_type"]
    return decomposition.unpivot(["period_type"], metrics, "metric", "value")
