"""Category and product seasonality: profiles, spikes, patterns, ranking.

An order has one purchase time, so distinct orders per day add up to distinct orders per
weekday, month or year. Everything in the category ranking therefore derives from one small
(category, day) table, which is the only aggregation that touches the item rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidebook.functions.calendar import dense_months, month_name, weekday_name
from tidebook.functions.scalar import safe_div, sum0
from tidebook.operators.enrich import CATEGORY, UNKNOWN, delivered

DAILY_COLUMNS = (CATEGORY, "order_date", "order_id", "order_item_id", "price", "is_delivered", "year")
MONTH_COLUMNS = (
    CATEGORY, "month", "year", "is_delivered", "order_item_id", "price", "freight_value",
    "payment_installments", "review_score", "delivery_time_days", "customer_state", "seller_state",
)
MONTH_METRICS = (
    "orders_count", "items_sold", "revenue", "avg_item_price", "avg_freight_value", "avg_payment_installments",
    "avg_review_score", "avg_delivery_time_days", "customer_state_nunique", "seller_state_nunique",
)
SPIKE_WINDOW = 30
SPIKE_MIN_DAYS = 35
SPIKE_Z = 3.0


def category_daily(enriched: DataFrame) -> DataFrame:
    """Delivered orders, items and revenue per (category, day), NULL categories kept."""
    return (
        delivered(enriched)
        .groupBy(F.col(CATEGORY).alias("category"), "order_date")
        .agg(
            F.countDistinct("order_id").alias("orders_count"),
            F.count("order_item_id").alias("items_sold"),
            sum0("price").alias("revenue"),
        )
    )


def distinct_states(column: str) -> Column:
    """Number of distinct states; the set of a group is bounded by the number of states."""
    return F.size(F.collect_set(column)).cast("long")


def orders_by_month(daily: DataFrame, year: int | None = None) -> DataFrame:
    """Distinct orders per (category, month) from the daily table, in which they add up."""
    rows = daily if year is None else daily.where(F.year("order_date") == year)
    return rows.groupBy("category", F.month("order_date").alias("month")).agg(F.sum("orders_count").alias("orders_count"))


def category_month(enriched: DataFrame, daily: DataFrame, year: int = 2017) -> DataFrame:
    """Ten measures per category and month of one year on a dense grid, with seasonal index.

    Distinct orders come from the daily table, distinct states from sets, so that the items of a
    category and month combine before they are shuffled.
    """
    items = (
        delivered(enriched, year)
        .groupBy(F.col(CATEGORY).alias("category"), "month")
        .agg(
            F.count("order_item_id").alias("items_sold"),
            sum0("price").alias("revenue"),
            F.avg("price").alias("avg_item_price"),
            F.avg("freight_value").alias("avg_freight_value"),
            F.avg("payment_installments").alias("avg_payment_installments"),
            F.avg("review_score").alias("avg_review_score"),
            F.avg("delivery_time_days").alias("avg_delivery_time_days"),
            distinct_states("customer_state").alias("customer_state_nunique"),
            distinct_states("seller_state").alias("seller_state_nunique"),
        )
    )
    orders = orders_by_month(daily, year).toDF("_category", "_month", "orders_count")
    same = F.col("category").eqNullSafe(F.col("_category")) & (F.col("month") == F.col("_month"))
    monthly = items.join(orders, same).select("category", "month", *MONTH_METRICS)
    return with_seasonal_index(dense_months(monthly, "category", MONTH_METRICS, unknown=UNKNOWN)).withColumn(
        "month_name", month_name("month")
    )


def with_seasonal_index(dense: DataFrame) -> DataFrame:
    """Month's orders over the category's mean month; NULL when the mean is 0."""
    mean = F.avg("orders_count").over(W.partitionBy("category"))
    return dense.withColumn("seasonal_index", safe_div("orders_count", mean))


def monthly_profile(daily: DataFrame, year: int = 2017) -> DataFrame:
    """Dense (category, month, orders_count, revenue, seasonal_index) from the daily table."""
    monthly = (
        daily.where(F.year("order_date") == year)
        .groupBy("category", F.month("order_date").alias("month"))
        .agg(F.sum("orders_count").alias("orders_count"), F.sum("revenue").alias("revenue"))
    )
    return with_seasonal_index(dense_months(monthly, "category", ["orders_count", "revenue"], unknown=UNKNOWN))


def category_week(enriched: DataFrame) -> DataFrame:
    """Orders, revenue and items per category and week."""
    return (
        delivered(enriched)
        .where(F.col(CATEGORY).isNotNull() & F.col("week").isNotNull())
        .groupBy(F.col(CATEGORY).alias("category"), "week")
        .agg(
            F.countDistinct("order_id").alias("orders_count"),
            sum0("price").alias("revenue"),
            F.count("order_item_id").alias("items_sold"),
        )
    )


def _z_scores(df: DataFrame, partition: list[str], day: str) -> DataFrame:
    """Rolling statistics over the last 30 *active* days, the current one included."""
    frame = W.partitionBy(*partition).orderBy(day).rowsBetween(-(SPIKE_WINDOW - 1), 0)
    full = F.count("orders_count").over(frame) >= SPIKE_WINDOW
    return df.withColumns(
        {
            "rolling_mean_30": F.when(full, F.avg("orders_count").over(frame)),
            "rolling_std_30": F.when(full, F.stddev_samp("orders_count").over(frame)),
        }
    ).withColumn("z_score", safe_div(F.col("orders_count") - F.col("rolling_mean_30"), "rolling_std_30"))


def event_spikes(daily: DataFrame) -> DataFrame:
    """Days on which a category deviates by more than three rolling deviations."""
    known = daily.where(F.col("category").isNotNull() & F.col("order_date").isNotNull()).select(
        "category", "order_date", "orders_count"
    )
    long_enough = known.withColumn("_days", F.count(F.lit(1)).over(W.partitionBy("category"))).where(
        F.col("_days") >= SPIKE_MIN_DAYS
    )
    scored = _z_scores(long_enough.drop("_days"), ["category"], "order_date")
    return scored.where(F.abs("z_score") > SPIKE_Z)


def total_daily(enriched: DataFrame) -> DataFrame:
    """Distinct delivered orders per day over all categories."""
    return (
        delivered(enriched)
        .where(F.col("order_date").isNotNull())
        .groupBy(F.col("order_date").alias("date"))
        .agg(F.countDistinct("order_id").alias("orders_count"))
    )


def total_spikes(enriched: DataFrame) -> DataFrame:
    """Total daily demand with rolling statistics and an is_spike flag.

    The single window partition holds one row per calendar day.
    """
    scored = _z_scores(total_daily(enriched), [], "date")
    return scored.withColumn("is_spike", F.coalesce(F.abs("z_score") > SPIKE_Z, F.lit(False)))


def spike_counts(spikes: DataFrame) -> DataFrame:
    return spikes.groupBy("category").agg(
        F.count("order_date").alias("event_spike_count"), F.max("z_score").alias("max_spike_z_score")
    )


def weekly_strength(daily: DataFrame) -> DataFrame:
    """Spread (max - min) of the weekday index, i.e. of orders over the mean weekday."""
    weekday = (
        daily.where(F.col("category").isNotNull() & F.col("order_date").isNotNull())
        .groupBy("category", F.weekday("order_date").alias("weekday"))
        .agg(F.sum("orders_count").alias("n"))
    )
    return weekday.groupBy("category").agg(
        safe_div(F.max("n") - F.min("n"), F.avg("n")).alias("weekly_pattern_strength")
    )


def trend_strength(monthly: DataFrame) -> DataFrame:
    """|least-squares slope| over the year relative to the best month."""
    y = F.col("orders_count").cast("double")
    slope = F.regr_slope(y, (F.col("month") - 1).cast("double"))
    strength = F.abs(slope) * 11 / F.greatest(F.max(y), F.lit(1.0))
    return monthly.groupBy("category").agg(
        F.when(F.avg(y) == 0, 0.0).otherwise(strength).alias("trend_strength")
    )


def first_peak_month(orders: str = "orders_count") -> Column:
    """Month with most orders, the earliest on ties (aggregate)."""
    return F.min_by(F.col("month"), F.struct(-F.col(orders), F.col("month")))


def quarter_sums(orders: str = "orders_count") -> list[Column]:
    quarter = F.ceil(F.col("month") / 3)
    return [F.sum(F.when(quarter == q, F.col(orders)).otherwise(0)).alias(f"_q{q}") for q in (1, 2, 3, 4)]


def first_peak_quarter() -> Column:
    """Quarter with the largest sum, the lowest on ties, from the columns of quarter_sums."""
    best = F.greatest("_q1", "_q2", "_q3", "_q4")
    return F.when(F.col("_q1") == best, 1).when(F.col("_q2") == best, 2).when(F.col("_q3") == best, 3).otherwise(4)


def confidence_level(high: tuple[int, int], medium: tuple[int, int]) -> Column:
    """Tier by (total orders, active months)."""
    reaches = lambda t: (F.col("total_orders") >= t[0]) & (F.col("active_months") >= t[1])
    return F.when(reaches(high), "high").when(reaches(medium), "medium").otherwise("low")


def category_profile(monthly: DataFrame) -> DataFrame:
    """Yearly seasonality figures per category from the dense monthly grid."""
    y = F.col("orders_count")
    grouped = monthly.groupBy("category").agg(
        F.sum(y).alias("total_orders"),
        F.sum("revenue").alias("total_revenue"),
        F.count_if(y > 0).alias("active_months"),
        F.avg(y).alias("monthly_mean"),
        F.stddev_pop(y).alias("monthly_std"),
        F.max(y).alias("_max"),
        F.min(F.when(y > 0, y)).alias("_min"),
        first_peak_month().alias("_pm"),
        *quarter_sums(),
    )
    sold = F.col("total_orders") > 0
    return grouped.select(
        "category", "total_orders", "total_revenue", "active_months", "monthly_mean", "monthly_std",
        safe_div("monthly_std", "monthly_mean").alias("cv"),
        safe_div("_max", "monthly_mean").alias("peak_to_mean"),
        safe_div("_max", "_min").alias("peak_to_min"),
        safe_div("_max", "total_orders").alias("peak_month_share"),
        safe_div(F.greatest("_q1", "_q2", "_q3", "_q4"), "total_orders").alias("peak_quarter_share"),
        safe_div("_max", "monthly_mean").alias("seasonal_index_max"),
        F.when(sold, F.col("_pm")).alias("peak_month"),
        F.when(sold, first_peak_quarter()).alias("peak_quarter"),
        confidence_level((200, 10), (100, 6)).alias("confidence_level"),
    ).withColumn("seasonality_score", F.col("cv"))


# Ordered rules; the first that holds names the type. Thresholds and names.
def seasonality_type() -> Column:
    c = F.col
    quarter_heavy = c("peak_quarter_share") >= 0.34
    return (
        F.when(c("confidence_level") == "low", "low_confidence")
        .when((c("trend_strength") > 0.55) & (c("cv") > 0.8), "trend_driven")
        .when((c("event_spike_count") >= 3) & (c("peak_month_share") < 0.25), "event_driven")
        .when((c("cv") < 0.35) & (c("peak_to_mean") < 1.6), "stable")
        .when((c("peak_month_share") >= 0.35) | (c("peak_to_mean") >= 2.6), "single_month_spike")
        .when((c("peak_quarter") == 4) & quarter_heavy, "holiday_q4")
        .when((c("peak_quarter") == 1) & quarter_heavy, "early_year")
        .when(c("peak_quarter").isin(2, 3) & quarter_heavy, "mid_year")
        .when(c("peak_quarter_share") >= 0.45, "quarter_peak")
        .when(c("weekly_pattern_strength") >= 0.45, "weekly_pattern")
        .otherwise("mixed_seasonal")
    )


RANKING_COLUMNS = (
    "category", "total_orders", "total_revenue", "active_months", "monthly_mean", "monthly_std", "cv", "peak_to_mean",
    "peak_to_min", "peak_month_share", "peak_quarter_share", "seasonal_index_max", "peak_month", "peak_quarter",
    "confidence_level", "event_spike_count", "max_spike_z_score", "weekly_pattern_strength", "trend_strength",
    "seasonality_score", "seasonality_type",
)


def category_ranking(daily: DataFrame, year: int = 2017) -> DataFrame:
    """Categories with profile, spikes, weekly and trend strength and their seasonality type.

    Unordered; use ``ranked`` for the presentation order.
    """
    monthly = monthly_profile(daily, year)
    joined = (
        category_profile(monthly)
        .join(spike_counts(event_spikes(daily)), "category", "left")
        .join(weekly_strength(daily), "category", "left")
        .join(trend_strength(monthly), "category", "left")
        .na.fill(0, ["event_spike_count", "weekly_pattern_strength", "trend_strength"])
    )
    return joined.withColumn("seasonality_type", seasonality_type()).select(*RANKING_COLUMNS)


BY_SCORE = ("seasonality_score", "category")


def ranked(ranking: DataFrame, ascending: bool = False, tiebreak: tuple[str, ...] = ("category",)) -> DataFrame:
    """Order by seasonality score, unscored last, with a unique tiebreak."""
    score = F.col("seasonality_score")
    return ranking.orderBy(score.asc_nulls_last() if ascending else score.desc_nulls_last(), *tiebreak)


def eligible(ranking: DataFrame) -> DataFrame:
    return ranking.where(F.col("confidence_level") != "low")


def top_seasonal(ranking: DataFrame, n: int) -> DataFrame:
    """The n most seasonal categories of sufficient confidence."""
    return ranked(eligible(ranking)).limit(n)


def most_stable(ranking: DataFrame, n: int = 10) -> DataFrame:
    return ranked(eligible(ranking), ascending=True).limit(n)


def seasonal_index_matrix(ranking: DataFrame, monthly: DataFrame, top: int | None = 20) -> DataFrame:
    """Seasonal index, one row per eligible category (or the top n) and a column per month."""
    if top is None:
        rows = eligible(ranking).select("category")
    else:
        rows = F.broadcast(top_seasonal(ranking, top).select("category"))  # at most ``top`` rows
    wide = (
        monthly.join(rows, "category", "left_semi")
        .groupBy("category")
        .pivot("month", list(range(1, 13)))
        .agg(F.first("seasonal_index"))
    )
    return wide.select("category", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])


def type_composition(ranking: DataFrame) -> DataFrame:
    return ranking.groupBy("seasonality_type", "confidence_level").agg(F.count(F.lit(1)).alias("categories_count"))


def robustness(ranking: DataFrame, min_orders: tuple[int, ...] = (50, 100, 200), min_months: int = 6, top: int = 10) -> DataFrame:
    """Eligible categories and the sorted top-10 names under several order minimums."""
    settings = ranking.sparkSession.createDataFrame([(m,) for m in min_orders], "min_orders int")
    fits = F.filter(F.array(*[F.lit(m) for m in min_orders]), lambda m: m <= F.col("total_orders"))
    rows = ranking.where(F.col("active_months") >= min_months).withColumn("min_orders", F.explode(fits))
    place = F.row_number().over(
        W.partitionBy("min_orders").orderBy(F.col("seasonality_score").desc_nulls_last(), "category")
    )
    counted = (
        rows.withColumn("_place", place)
        .groupBy("min_orders")
        .agg(
            F.count(F.lit(1)).alias("n_categories"),
            F.concat_ws("; ", F.array_sort(F.collect_list(F.when(F.col("_place") <= top, F.col("category"))))).alias("top10_categories"),
        )
    )
    return settings.join(counted, "min_orders", "left").select(
        F.concat(F.lit("min_orders_"), F.col("min_orders").cast("string")).alias("setting"),
        F.coalesce("n_categories", F.lit(0)).alias("n_categories"),
        F.coalesce("top10_categories", F.lit("")).alias("top10_categories"),
    )


def weekday_orders(enriched: DataFrame) -> DataFrame:
    """Orders and revenue per weekday over all delivered items."""
    return (
        delivered(enriched)
        .where(F.col("weekday").isNotNull())
        .groupBy("weekday")
        .agg(F.countDistinct("order_id").alias("orders_count"), sum0("price").alias("revenue"))
        .withColumn("weekday_name", weekday_name("weekday"))
    )


PRODUCT_COLUMNS = ("product_id", CATEGORY, "month", "year", "is_delivered", "order_id", "order_item_id", "price")


def product_month(enriched: DataFrame, year: int = 2017) -> DataFrame:
    """Orders, revenue and items per product and month."""
    keys = F.col("product_id").isNotNull() & F.col(CATEGORY).isNotNull()
    return (
        delivered(enriched, year)
        .where(keys)
        .groupBy("product_id", F.col(CATEGORY).alias("category"), "month")
        .agg(
            F.countDistinct("order_id").alias("orders_count"),
            sum0("price").alias("revenue"),
            F.count("order_item_id").alias("items_sold"),
        )
    )


def product_ranking(monthly: DataFrame) -> DataFrame:
    """Seasonality of products over twelve zero-filled months.

    Absent months need no rows: with S the sum and Q the sum of squares of the months present,
    the zero-filled coefficient of variation is sqrt(12 Q - S^2) / S, exact in integers.
    """
    y = F.col("orders_count")
    grouped = monthly.groupBy("product_id", "category").agg(
        F.sum(y).alias("total_orders"),
        F.sum("revenue").alias("total_revenue"),
        F.count_if(y > 0).alias("active_months"),
        F.sum(y * y).alias("_squares"),
        F.max(y).alias("_max"),
        first_peak_month().alias("peak_month"),
        *quarter_sums(),
    )
    total = F.col("total_orders")
    spread = F.sqrt((12 * F.col("_squares") - total * total).cast("double"))
    return grouped.where(total > 0).select(
        "product_id", "category", "total_orders", "total_revenue", "active_months",
        (spread / total).alias("seasonality_score"),
        (F.col("_max") * 12.0 / total).alias("peak_to_mean"),
        "peak_month",
        first_peak_quarter().alias("peak_quarter"),
        safe_div(F.greatest("_q1", "_q2", "_q3", "_q4"), total).alias("peak_quarter_share"),
        confidence_level((30, 4), (20, 3)).alias("confidence_level"),
    )


def top_products_seasonal(products: DataFrame, n: int = 20) -> DataFrame:
    """The n most seasonal products of sufficient confidence, with a shortened id."""
    return (
        ranked(eligible(products), tiebreak=("product_id",))
        .limit(n)
        .withColumn("product_short", F.substring(F.col("product_id").cast("string"), 1, 8))
    )
