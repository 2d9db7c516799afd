"""First-half features, second-half target and the early-warning score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.calendar import dense_months
from tidebook.functions.scalar import is_true, safe_div, sum0
from tidebook.functions.stats import percent_rank_avg, row_mean
from tidebook.operators.enrich import CATEGORY, UNKNOWN, delivered
from tidebook.operators.seasonality import distinct_states, eligible
from tidebook.sources.settle import settle

# Names of the features.
EARLY_COLUMNS = (
    CATEGORY, "month", "year", "is_delivered", "order_id", "price", "payment_installments", "freight_share",
    "review_score", "customer_state", "seller_state",
)
FEATURES = (
    "h1_orders", "h1_revenue", "h1_avg_item_price", "h1_avg_payment_installments", "h1_share_installments_6_plus",
    "h1_freight_share", "h1_avg_review_score", "h1_customer_state_nunique", "h1_seller_state_nunique",
    "h1_growth_jan_to_jun", "h1_weekday_concentration",
)
SUMMED = (
    "price", "freight_value", "freight_share", "payment_installments", "review_score", "delivery_time_days",
    "product_weight_g", "product_volume_cm3", "product_photos_qty", "product_name_lenght", "product_description_lenght",
)
SCORE_FEATURES = (
    "h1_growth_jan_to_jun", "h1_weekday_concentration", "h1_avg_item_price", "h1_avg_payment_installments",
    "h1_customer_state_nunique",
)


def _days(daily: DataFrame, year: int, first: int, last: int) -> DataFrame:
    """Daily orders of some months of a year, with unnamed categories filled in."""
    day = F.col("order_date")
    return daily.where((F.year(day) == year) & F.month(day).between(first, last)).select(
        F.coalesce("category", F.lit(UNKNOWN)).alias("category"),
        F.month(day).alias("month"),
        F.weekday(day).alias("weekday"),
        "orders_count",
    )


def h1_patterns(daily: DataFrame, year: int = 2017) -> DataFrame:
    """Orders, January-to-June growth and weekday concentration from the daily table.

    Growth is missing unless both months have orders.
    """
    by_day = _days(daily, year, 1, 6).groupBy("category", "weekday").agg(
        F.sum("orders_count").alias("n"),
        F.sum(F.when(F.col("month") == 1, F.col("orders_count"))).alias("jan"),
        F.sum(F.when(F.col("month") == 6, F.col("orders_count"))).alias("jun"),
    )
    return by_day.groupBy("category").agg(
        F.sum("n").alias("h1_orders"),
        ((F.sum("jun") + 1) / (F.sum("jan") + 1) - 1).alias("h1_growth_jan_to_jun"),
        safe_div(F.max("n") - F.min("n"), F.avg("n")).alias("h1_weekday_concentration"),
    )


def _first_half(year: int) -> Column:
    return (F.col("year") == year) & F.col("month").between(1, 6)


def state_sums(enriched: DataFrame, year: int | None = None) -> DataFrame:
    """Counts and sums of the delivered items per category, states of customer and seller, and first half of the year.

    Categories and states are few, so items combine before they are shuffled, in an aggregate without
    sets; the features of all items and those of the first half are derived from it in one pass.
    """
    half = F.lit(False) if year is None else is_true(_first_half(year))
    summed = [c for c in SUMMED if c in enriched.columns]
    low = [F.count_if("is_low_review").alias("low_reviews")] if "is_low_review" in enriched.columns else []
    return delivered(enriched).groupBy(F.col(CATEGORY).alias("category"), half.alias("first_half"), "customer_state", "seller_state").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("payment_installments") >= 6).alias("installments_6_plus"),
        *low,
        *[F.sum(c).alias(f"sum_{c}") for c in summed],
        *[F.count(c).alias(f"n_{c}") for c in summed],
    )


def mean_of(column: str) -> Column:
    """Mean of a column from its sums and counts."""
    return safe_div(F.sum(f"sum_{column}"), F.sum(f"n_{column}"))


def share_of_items(column: str) -> Column:
    """Share of items from their counts."""
    return safe_div(F.sum(column), F.sum("items"))


def h1_features(enriched: DataFrame, daily: DataFrame, year: int = 2017, sums: DataFrame | None = None) -> DataFrame:
    """Eleven features per category over January to June, from the ``sums`` of the items if given."""
    if sums is None:
        sums = state_sums(enriched.where(_first_half(year)), year)
    measured = sums.where("first_half").groupBy(F.coalesce("category", F.lit(UNKNOWN)).alias("category")).agg(
        sum0("sum_price").alias("h1_revenue"),
        mean_of("price").alias("h1_avg_item_price"),
        mean_of("payment_installments").alias("h1_avg_payment_installments"),
        share_of_items("installments_6_plus").alias("h1_share_installments_6_plus"),
        mean_of("freight_share").alias("h1_freight_share"),
        mean_of("review_score").alias("h1_avg_review_score"),
        distinct_states("customer_state").alias("h1_customer_state_nunique"),
        distinct_states("seller_state").alias("h1_seller_state_nunique"),
    )
    return measured.join(h1_patterns(daily, year), "category", "left").select("category", *FEATURES)


def h2_target(daily: DataFrame, year: int = 2017) -> DataFrame:
    """Zero-filled six-month coefficient of variation and orders of July to December."""
    monthly = _days(daily, year, 7, 12).groupBy("category", "month").agg(F.sum("orders_count").alias("orders_count"))
    dense = dense_months(monthly, "category", ["orders_count"], months=(7, 12))
    return dense.groupBy("category").agg(
        safe_div(F.stddev_pop("orders_count"), F.avg("orders_count")).alias("h2_seasonality_score"),
        F.sum("orders_count").alias("h2_orders"),
    )


def early_features(
    enriched: DataFrame, daily: DataFrame, ranking: DataFrame, year: int = 2017, sums: DataFrame | None = None
) -> DataFrame:
    """Features, target and ranking attributes, labelled against the eligible P75.

    The joined table (one row per category) is stored, since the threshold reads it as well.
    """
    joined = settle(
        h1_features(enriched, daily, year, sums)
        .join(h2_target(daily, year), "category", "inner")
        .join(ranking.select("category", "confidence_level", "seasonality_type", "seasonality_score"), "category", "left")
    )
    threshold = early_eligible(joined).agg(F.percentile("h2_seasonality_score", 0.75).alias("t")).scalar()
    return joined.withColumn(
        "is_h2_seasonal", F.coalesce((F.col("h2_seasonality_score") >= threshold).cast("int"), F.lit(0))
    )


def early_eligible(features: DataFrame) -> DataFrame:
    """Confident categories with at least 20 orders in each half."""
    return eligible(features).where((F.col("h1_orders") >= 20) & (F.col("h2_orders") >= 20))


def early_warning_scorecard(features: DataFrame) -> DataFrame:
    """Add a percentile rank per score feature and their mean.

    The unpartitioned ranks run over one row per category.
    """
    ranks = {f"{c}_rank": percent_rank_avg(c) for c in SCORE_FEATURES}
    return features.withColumns(ranks).withColumn("early_warning_score", row_mean(list(ranks)))
