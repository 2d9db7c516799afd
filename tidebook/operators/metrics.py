"""Order-grain table and monthly / weekly demand metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.quantiles import percentiles_struct
from tidebook.functions.scalar import is_true, safe_div, share_true, sum0
from tidebook.operators.enrich import CATEGORY, delivered

# The keys of an order row, and the names of its measures and of those below.
ORDER_KEYS = (
    "order_id", "order_purchase_timestamp", "year", "month", "year_month", "week", "weekday", "payment_value",
    "payment_installments", "payment_type", "customer_state", "delivery_time_days",
    "estimated_delivery_delta_days", "review_score",
)
PAYMENT_COLUMNS = ("order_id", "payment_value", "is_delivered")
ORDER_TABLE_COLUMNS = ORDER_KEYS + ("price", "freight_value", "order_item_id", "is_delivered")
ORDER_LEVEL_COLUMNS = ORDER_TABLE_COLUMNS + (CATEGORY,)
SOLD_COLUMNS = ("year_month", "product_id", "is_delivered")


def order_table(enriched: DataFrame, categories: bool = False) -> DataFrame:
    """Delivered orders with additive sums of their items, the base of every order-grain and monthly measure.

    One row per combination of order attributes (missing ones included). Store it where several
    measures follow: months and weeks only add up these rows. ``categories`` adds the number of
    distinct categories, which needs the product joins.
    """
    sums = [
        sum0("price").alias("revenue"),
        sum0("freight_value").alias("freight_sum"),
        F.count("order_item_id").alias("items_sold"),
        F.count(F.lit(1)).alias("item_rows"),
        F.count("price").alias("priced_items"),
        F.count("freight_value").alias("freight_items"),
    ]
    if categories:
        sums.append(F.countDistinct(CATEGORY).alias("categories_count"))
    return delivered(enriched).groupBy(*ORDER_KEYS).agg(*sums)


def order_level(enriched: DataFrame) -> DataFrame:
    """Delivered orders with revenue, freight, items, categories and their gross value."""
    rows = order_table(enriched, categories=True).select(*ORDER_KEYS, "revenue", "freight_sum", "items_sold", "categories_count")
    return rows.withColumn("gmv", F.col("revenue") + F.col("freight_sum"))


def order_payments(enriched: DataFrame) -> DataFrame:
    """(order_id, payment_value) of delivered orders: the order-grain table without its measures."""
    return delivered(enriched).select("order_id", "payment_value").distinct()


def order_flags(orders: DataFrame, payments: DataFrame | None = None) -> DataFrame:
    """Mark orders whose payment reaches the global P90 / P75.

    ``payments`` may supply the order payments more cheaply than the order-grain table does.
    """
    source = orders if payments is None else payments
    cut = percentiles_struct(source, "payment_value", {"p90": 0.9, "p75": 0.75})
    return (
        orders.withColumn("_cut", cut)
        .withColumns(
            {
                "large_purchase_p90": is_true(F.col("payment_value") >= F.col("_cut.p90")),
                "large_purchase_p75": is_true(F.col("payment_value") >= F.col("_cut.p75")),
            }
        )
        .drop("_cut")
    )


def products_by_month(enriched: DataFrame) -> DataFrame:
    """Distinct delivered products per month: (month, product) pairs combine before they are counted."""
    pairs = delivered(enriched).where(F.col("year_month").isNotNull() & F.col("product_id").isNotNull()).select("year_month", "product_id").distinct()
    return pairs.groupBy("year_month").agg(F.count(F.lit(1)).alias("products_sold"))


def monthly_metrics(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Fourteen order- and item-level measures per purchase month.

    ``orders`` is a stored ``order_table``, ``products`` is ``products_by_month``. Item means follow
    from sums and counts, since an item's score and delivery time are its order's.
    """
    of_items = lambda c: safe_div(F.sum(F.col(c) * F.col("item_rows")), F.sum(F.when(F.col(c).isNotNull(), F.col("item_rows"))))
    months = (
        order_flags(orders)
        .where(F.col("year_month").isNotNull())
        .groupBy("year_month")
        .agg(
            F.countDistinct("order_id").alias("orders_count"),
            sum0("payment_value").alias("payment_value_sum"),
            F.avg("payment_value").alias("avg_order_value"),
            share_true(F.col("large_purchase_p90")).alias("large_purchase_share"),
            F.avg("payment_installments").alias("avg_payment_installments"),
            share_true(F.col("payment_installments") >= 6).alias("share_installments_6_plus"),
            F.sum("items_sold").alias("items_sold"),
            F.sum("revenue").alias("revenue"),
            F.sum("freight_sum").alias("freight_sum"),
            safe_div(F.sum("revenue"), F.sum("priced_items")).alias("avg_item_price"),
            safe_div(F.sum("freight_sum"), F.sum("freight_items")).alias("avg_freight_value"),
            of_items("review_score").alias("avg_review_score"),
            of_items("delivery_time_days").alias("avg_delivery_time_days"),
        )
    )
    return months.join(products, "year_month", "left").withColumns(
        {
            "products_sold": F.coalesce("products_sold", F.lit(0).cast("long")),
            "gmv": F.col("revenue") + F.col("freight_sum"),
            "year": F.substring("year_month", 1, 4).cast("int"),
            "month": F.substring("year_month", 6, 2).cast("int"),
        }
    )


def weekly_metrics(orders: DataFrame) -> DataFrame:
    """Orders, revenue, mean order value and large-purchase share per week from a stored ``order_table``."""
    return (
        order_flags(orders)
        .where(F.col("week").isNotNull())
        .groupBy("week")
        .agg(
            F.countDistinct("order_id").alias("orders_count"),
            sum0("revenue").alias("revenue"),
            F.avg("payment_value").alias("avg_order_value"),
            share_true(F.col("large_purchase_p90")).alias("large_purchase_share"),
        )
    )
