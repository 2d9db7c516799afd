"""Descriptive sales statistics: shares, trends, crosstabs, portfolios, dashboard figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidebook.functions.calendar import month_label, weekday_name, with_calendar, with_fine_calendar
from tidebook.functions.quantiles import percentile_columns
from tidebook.functions.scalar import elapsed_days, percent, safe_div, sum0, time_between
from tidebook.operators.audit import shifted_logs
from tidebook.operators.enrich import CATEGORY
from tidebook.operators.merged import Merge

Tables = Mapping[str, DataFrame]
_TS = "order_purchase_timestamp"


# --- the all-table merge -------------------------------------------------------------------

def merged_rows(merge: Merge) -> DataFrame:
    """Rows of the full outer merge of seven tables per payment type, customer and seller state.

    Members of a table that match nothing count once.
    """
    tall = lambda df, dim, value: df.select(F.lit(dim).alias("dimension"), value.cast("string").alias("value"), "weight")
    parts = [
        tall(merge.total(), "total", F.lit("rows")),
        tall(merge.weighted("payments"), "payment_type", F.col("payment_type")),
        tall(merge.weighted("customers"), "customer_state", F.col("customer_state")),
        tall(merge.weighted("sellers"), "seller_state", F.col("seller_state")),
    ]
    everything = reduce(DataFrame.unionByName, parts)
    return everything.where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.sum("weight").alias("rows"))


def merged_payment_share(merge: Merge) -> DataFrame:
    """Merged rows per payment type and their percent of all merged rows."""
    counts = merge.weighted("payments").where(F.col("payment_type").isNotNull()).groupBy("payment_type").agg(F.sum("weight").alias("total"))
    return counts.withColumn("percent", percent(safe_div("total", merge.rows())))


def freight_by_region(merge: Merge, regions: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean freight of the merged rows per seller state, one column per customer region.

    ``regions`` maps state to region, ``names`` are the regions that become columns.
    """
    tables = merge.tables
    places = tables["customers"].select("customer_id", F.col("customer_state").alias("state")).join(regions, "state")
    orders = tables["orders"].select("order_id", "customer_id").join(places, "customer_id").select("order_id", "region")
    priced = merge.weighted("items").where(F.col("price").isNotNull()).join(tables["sellers"].select("seller_id", "seller_state"), "seller_id")
    cells = priced.join(orders, "order_id").where(F.col("freight_value").isNotNull()).groupBy("seller_state", "region").agg(
        safe_div(F.sum(F.col("freight_value") * F.col("weight")), F.sum("weight")).alias("freight")
    )
    return cells.groupBy("seller_state").pivot("region", list(names)).agg(F.first("freight"))


def items_score_crosstab(merge: Merge, top: int = 12) -> DataFrame:
    """Percent of each score among the merged rows of an item position, first positions only.

    Items and scores are counted per order first: a pair of (position, score) meets once.
    """
    tables = merge.tables
    positions = tables["items"].where("order_item_id IS NOT NULL").groupBy("order_id", "order_item_id").agg(F.count(F.lit(1)).alias("_i"))
    scores = tables["reviews"].where("review_score IS NOT NULL").groupBy("order_id", "review_score").agg(F.count(F.lit(1)).alias("_s"))
    payments = merge.sizes.where("in_orders = 1").select("order_id", "n_pay")
    cells = (
        positions.join(scores, "order_id").join(payments, "order_id")
        .withColumn("_w", F.col("_i") * F.col("_s") * F.greatest(F.coalesce("n_pay", F.lit(0)), F.lit(1)))
        .groupBy("order_item_id").pivot("review_score", [1, 2, 3, 4, 5]).agg(F.sum("_w"))
    )
    total = sum((F.coalesce(F.col(str(s)), F.lit(0)) for s in range(1, 6)), F.lit(0))
    shares = [percent(safe_div(F.coalesce(F.col(str(s)), F.lit(0)), total)).alias(f"score_{s}") for s in range(1, 6)]
    return cells.select("order_item_id", *shares).orderBy("order_item_id").limit(top)


# --- shares and distributions --------------------------------------------------------------

def class_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """Distribution of a class within each group."""
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("qty"))
    return counts.withColumn("percent_qty", safe_div("qty", F.sum("qty").over(W.partitionBy(group))))


def item_count_buckets(merge: Merge) -> DataFrame:
    """Merged rows per item position, 7 to 10 and 10 to 20 pooled, with share in percent.

    An item stands in as many rows of the merge as its order has pairs of payment and review.
    """
    n = F.col("order_item_id")
    label = F.when(n.between(7, 10), "7 to 10").when(n > 10, "10 to 20").otherwise(n.cast("string"))
    counts = merge.weighted("items").where(n.isNotNull()).groupBy(label.alias("bucket")).agg(F.sum("weight").alias("total"))
    return counts.withColumn("percent", percent(safe_div("total", F.sum("total").over(W.partitionBy()))))


FIVE_NUMBERS = {"min_value": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max_value": 1.0}


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Five-number summary of a value per group."""
    return percentile_columns(df, value, FIVE_NUMBERS, [by])


PAYMENT_QUANTILES = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def payment_quantiles(payments: DataFrame) -> DataFrame:
    """Mean and five quantiles of the payment value per type."""
    means = payments.groupBy("payment_type").agg(F.avg("payment_value").alias("avg_value"))
    return means.join(percentile_columns(payments, "payment_value", PAYMENT_QUANTILES, ["payment_type"]), "payment_type")


def payment_logs(payments: DataFrame) -> DataFrame:
    """Per payment type: payments other than 0, and the mean of their three shifted logarithms."""
    logs = shifted_logs(payments.where(F.col("payment_value") != 0), "payment_value")
    means = [F.avg(c).alias(f"avg_{c}") for c in ("payment_value_log_1p5", "payment_value_log_p1", "payment_value_log_then_1")]
    return logs.groupBy("payment_type").agg(F.count(F.lit(1)).alias("payments"), *means)


# --- time ----------------------------------------------------------------------------------

def sales_by_day(enriched: DataFrame) -> DataFrame:
    return enriched.where("order_date IS NOT NULL").groupBy("order_date").agg(sum0("price").alias("products_value"))


def sales_by_week(enriched: DataFrame) -> DataFrame:
    return enriched.where("week IS NOT NULL").groupBy("week").agg(
        sum0("price").alias("products_value"), F.avg("review_score").alias("avg_review_score")
    )


def order_hours(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Item rows and value per purchase hour: the one aggregate every trend below reads."""
    sums = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), sum0("price").alias("v"))
    return orders.where(F.col(_TS).isNotNull()).join(sums, "order_id").groupBy(
        F.to_date(_TS).alias("day"), F.hour(_TS).alias("hour")
    ).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


def trend(hours: DataFrame, grain: str) -> DataFrame:
    """Total and mean value and rows per year, month, weekday or hour."""
    part = {"year": F.year("day"), "month": F.month("day"), "weekday": F.weekday("day"), "hour": F.col("hour")}[grain]
    out = hours.groupBy(part.alias(grain)).agg(
        F.sum("v").alias("total_value"), (F.sum("v") / F.sum("n")).alias("mean_transaction"), F.sum("n").alias("order_count")
    )
    return out.withColumn("weekday_name", weekday_name("weekday")) if grain == "weekday" else out


def weekday_hour(hours: DataFrame) -> DataFrame:
    """Rows per weekday (Sunday first) and hour, a column per hour."""
    wide = hours.groupBy(F.weekday("day").alias("weekday")).pivot("hour", list(range(24))).agg(F.sum("n"))
    names = [F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h:02d}") for h in range(24)]
    return wide.select(
        ((F.col("weekday") + 1) % 7).alias("position"), weekday_name("weekday").alias("weekday_name"), *names
    ).orderBy("position")


def actives_by_month(tables: Tables) -> DataFrame:
    """Distinct customers, categories (an unnamed one counts) and sellers per month.

    Three separate distincts keep each shuffle as narrow as its own column.
    """
    when = (F.year(_TS).alias("year"), F.month(_TS).alias("month"))
    orders = tables["orders"].where(F.col(_TS).isNotNull()).select("order_id", "customer_id", *when)
    keys = ["year", "month"]
    count = lambda df, column, name: df.select(*keys, column).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    items = tables["items"].select("order_id", "product_id", "seller_id").join(orders.drop("customer_id"), "order_id")
    customers = orders.join(tables["customers"].select("customer_id", "customer_unique_id"), "customer_id")
    names = tables["products"].join(tables["translations"], "product_category_name", "left").select("product_id", CATEGORY)
    return (
        count(customers, "customer_unique_id", "customers_count")
        .join(count(items.join(names, "product_id", "left"), CATEGORY, "categories_count"), keys, "full_outer")
        .join(count(items, "seller_id", "sellers_count"), keys, "full_outer")
    )


# Volume bands as (label, lowest, highest).
VOLUME_BANDS = (("1", 1, 1), ("2-5", 2, 5), ("6-20", 6, 20), ("21-92", 21, 92), ("93-250", 93, 250))


def category_volume_bands(tables: Tables) -> DataFrame:
    """Item rows per category and month with their volume band."""
    orders = tables["orders"].where(F.col(_TS).isNotNull()).select(
        "order_id", F.year(_TS).alias("year"), F.month(_TS).alias("month")
    )
    names = tables["products"].join(tables["translations"], "product_category_name", "left").select("product_id", CATEGORY)
    counts = (
        tables["items"].select("order_id", "product_id").join(names, "product_id").where(F.col(CATEGORY).isNotNull())
        .join(orders, "order_id").groupBy("year", "month", F.col(CATEGORY).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    )
    band = F.lit(">250")
    for label, low, high in reversed(VOLUME_BANDS):
        band = F.when(F.col("n").between(low, high), label).otherwise(band)
    return counts.withColumns({"month_label": month_label("month"), "band": band})


# --- places, orders, sellers ---------------------------------------------------------------

def value_by_place(enriched: DataFrame, place: str, n: int | None = None) -> DataFrame:
    """Mean item value per state or city, highest first."""
    out = enriched.where(F.col(place).isNotNull()).groupBy(place).agg(F.avg("price").alias("avg_trans"))
    return out if n is None else out.orderBy(F.desc("avg_trans"), place).limit(n)


def order_sums(items: DataFrame) -> DataFrame:
    """Product and freight value per order."""
    return items.where("order_id IS NOT NULL").groupBy("order_id").agg(
        sum0("price").alias("products_value"), sum0("freight_value").alias("freight_value"), F.count(F.lit(1)).alias("items_qty")
    )


def top_orders(items: DataFrame, n: int = 5) -> DataFrame:
    return order_sums(items).orderBy(F.desc("products_value"), "order_id").limit(n)


def items_per_order_hist(items: DataFrame) -> DataFrame:
    """Orders per item quantity."""
    return order_sums(items).groupBy("items_qty").agg(F.count(F.lit(1)).alias("orders_count"))


def category_orders(enriched: DataFrame, n: int = 10) -> DataFrame:
    """Categories with most item rows."""
    return enriched.where(F.col(CATEGORY).isNotNull()).groupBy(F.col(CATEGORY).alias("category")).agg(
        F.count("order_id").alias("order_count")
    ).orderBy(F.desc("order_count"), "category").limit(n)


def category_review_score(enriched: DataFrame, more_than: int = 50) -> DataFrame:
    """Scored rows and mean score of categories with more than 50 scored rows."""
    return enriched.where(F.col(CATEGORY).isNotNull()).groupBy(F.col(CATEGORY).alias("category")).agg(
        F.count("review_score").alias("count"), F.avg("review_score").alias("mean")
    ).where(F.col("count") > more_than)


def attach_sellers(lines: DataFrame, sellers: DataFrame) -> DataFrame:
    """Left join on the composite key (order_id, product_id)."""
    return lines.join(sellers, ["order_id", "product_id"], "left")


def seller_portfolio(enriched: DataFrame) -> DataFrame:
    """Rows and the sorted list of categories per seller; the list is bounded by the categories."""
    return enriched.where("seller_id IS NOT NULL").groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("items_count"), F.array_sort(F.collect_set(CATEGORY)).alias("products")
    ).withColumn("product_count", F.size("products"))


def top_sellers(enriched: DataFrame, n: int = 15) -> DataFrame:
    return enriched.where("seller_id IS NOT NULL").groupBy("seller_id").agg(F.count(F.lit(1)).alias("items_count")).orderBy(
        F.desc("items_count"), "seller_id"
    ).limit(n)


# --- dashboard -----------------------------------------------------------------------------

def slice_items(
    enriched: DataFrame, *, category: Any = None, status: Any = None, state: Any = None, seller: Any = None,
    payment_type: Any = None, year: Any = None, month: Any = None,
) -> DataFrame:
    """Interactive slicers: keep rows whose value equals, or is one of, each given choice."""
    chosen = {
        CATEGORY: category, "order_status": status, "customer_state": state, "seller_id": seller,
        "payment_type": payment_type, "year": year, "month": month,
    }
    for column, choice in chosen.items():
        if choice is not None:
            options: Sequence[Any] = choice if isinstance(choice, (list, tuple, set)) else [choice]
            enriched = enriched.where(F.col(column).isin(list(options)))
    return enriched


def sales_cards(enriched: DataFrame) -> DataFrame:
    """One row: sales, items, orders, products and mean rating."""
    return enriched.agg(
        sum0("price").alias("total_sales"), F.count(F.lit(1)).alias("items_sold"), F.countDistinct("order_id").alias("orders_count"),
        F.countDistinct("product_id").alias("products_count"), F.avg("review_score").alias("avg_rating"),
    )


def dashboard_kpis(tables: Tables) -> DataFrame:
    """(kpi, value) cards: totals, lateness, mean stage times and review counts."""
    tall = lambda one: one.select([F.col(c).cast("double").alias(c) for c in one.columns]).unpivot([], one.columns, "kpi", "value")
    orders = tables["orders"].agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")).alias("late_orders"),
        F.avg(time_between("HOUR", _TS, "order_approved_at", "boundary")).alias("avg_processing_hours"),
        F.avg(time_between("DAY", "order_approved_at", "order_delivered_carrier_date", "boundary")).alias("avg_days_to_carrier"),
        F.avg(time_between("DAY", "order_delivered_carrier_date", "order_delivered_customer_date", "boundary")).alias("avg_days_to_customer"),
    )
    items = tables["items"].agg(sum0("price").alias("total_sales"), F.count(F.lit(1)).alias("products_sold"))
    products = tables["products"].agg(F.countDistinct("product_id").alias("products_for_sale"))
    # The earliest limit of an order decides; its items need not meet the order row one by one.
    limits = tables["items"].groupBy("order_id").agg(F.min("shipping_limit_date").alias("limit"))
    dispatched = tables["orders"].select("order_id", "order_delivered_carrier_date").join(limits, "order_id").agg(
        F.count_if(F.col("order_delivered_carrier_date") > F.col("limit")).alias("late_dispatches")
    )
    score = F.col("review_score")
    reviews = tables["reviews"].agg(
        F.count(F.lit(1)).alias("total_reviews"), F.avg(score).alias("avg_rating"), F.count_if(score == 5).alias("five_star_reviews"),
        F.count_if(score == 1).alias("one_star_reviews"), F.count_if(score <= 3).alias("bad_reviews"),
    )
    return tall(orders).unionByName(tall(items)).unionByName(tall(products)).unionByName(tall(dispatched)).unionByName(tall(reviews))


def review_score_distribution(tables: Tables) -> DataFrame:
    """Distinct reviewed orders per score."""
    return tables["reviews"].where("review_score IS NOT NULL").groupBy("review_score").agg(F.countDistinct("order_id").alias("orders_count"))


def price_vs_delivery(tables: Tables) -> DataFrame:
    """Mean order price against mean delivery days per customer state."""
    sums = tables["items"].groupBy("order_id").agg(sum0("price").alias("order_price"))
    days = elapsed_days(_TS, "order_delivered_customer_date")
    orders = tables["orders"].select("order_id", "customer_id", days.alias("days")).join(sums, "order_id")
    return orders.join(tables["customers"].select("customer_id", "customer_state"), "customer_id").groupBy("customer_state").agg(
        F.avg("order_price").alias("avg_order_price"), F.avg("days").alias("avg_delivery_days")
    )


def calendar_rows(orders: DataFrame) -> DataFrame:
    """Order ids with every calendar feature."""
    return with_fine_calendar(with_calendar(orders.select("order_id", _TS)))
