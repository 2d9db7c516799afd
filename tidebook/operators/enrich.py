"""The item-grain enriched table every other operator consumes.

Join order matters at scale. Order-side attributes (customer) are attached to the order row
before it meets its items, and seller and product attributes come first, so the three joins
on ``order_id`` share one partitioning that order-grain aggregations can then reuse. Sellers
are counted: few are broadcast to the joined rows, so that their columns are never shuffled; many
come before products, so that a shuffle by seller moves no product column. No other side is
hinted: Spark broadcasts one only when its measured size is under the threshold, and splits hot
keys in the shuffled joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions import calendar as cal
from tidebook.functions.scalar import elapsed_days, is_true, safe_div, sum0

UNKNOWN = "unknown"
CATEGORY = "product_category_name_english"

ITEM_COLUMNS = ("order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value")
ORDER_COLUMNS = (
    "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
)
PRODUCT_COLUMNS = (
    "product_category_name", "product_name_lenght", "product_description_lenght", "product_photos_qty",
    "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
)
PAYMENT_COLUMNS = ("payment_value", "payment_installments", "payment_type", "payment_methods_count", "payment_rows")
REVIEW_COLUMNS = ("review_score", "review_count", "review_creation_date")
CUSTOMER_COLUMNS = ("customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state")
SELLER_COLUMNS = ("seller_zip_code_prefix", "seller_city", "seller_state")

# Spark multiplies the estimates of a join's sides, so by itself it would shuffle items even by a few sellers.
FEW_SELLERS = 500_000

_TS = "order_purchase_timestamp"


def _derived() -> dict[str, tuple[tuple[str, ...], Column]]:
    """Derived column -> (inputs, expression)."""
    ts = F.col(_TS)
    return {
        "year": ((_TS,), F.year(ts)),
        "quarter": ((_TS,), F.quarter(ts)),
        "month": ((_TS,), F.month(ts)),
        "month_name": ((_TS,), cal.month_name(F.month(ts))),
        "year_month": ((_TS,), cal.year_month(ts)),
        "week": ((_TS,), cal.week_range(ts)),
        "order_date": ((_TS,), F.to_date(ts)),
        "weekday": ((_TS,), F.weekday(ts)),
        "weekday_name": ((_TS,), cal.weekday_name(F.weekday(ts))),
        "product_volume_cm3": (
            ("product_length_cm", "product_height_cm", "product_width_cm"),
            F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm"),
        ),
        "delivery_time_days": (
            ("order_delivered_customer_date", _TS), elapsed_days(_TS, "order_delivered_customer_date"),
        ),
        "estimated_delivery_delta_days": (
            ("order_delivered_customer_date", "order_estimated_delivery_date"),
            elapsed_days("order_delivered_customer_date", "order_estimated_delivery_date"),
        ),
        "freight_share": (
            ("freight_value", "price"), safe_div("freight_value", F.col("price") + F.col("freight_value")),
        ),
        "is_delivered": (("order_status",), is_true(F.col("order_status") == "delivered")),
        "is_low_review": (("review_score",), is_true(F.col("review_score") <= 2)),
        "is_high_review": (("review_score",), is_true(F.col("review_score") >= 4)),
    }


DERIVED_COLUMNS = (
    "year", "quarter", "month", "month_name", "year_month", "week", "order_date", "weekday", "weekday_name",
    "product_volume_cm3", "delivery_time_days", "estimated_delivery_delta_days", "freight_share",
    "is_delivered", "is_low_review", "is_high_review",
)
ENRICHED_COLUMNS = (
    ITEM_COLUMNS + ORDER_COLUMNS + PRODUCT_COLUMNS + (CATEGORY,) + PAYMENT_COLUMNS + REVIEW_COLUMNS
    + CUSTOMER_COLUMNS + SELLER_COLUMNS + DERIVED_COLUMNS
)


def payments_per_order(payments: DataFrame, types: bool = True) -> DataFrame:
    """Sum, max installments, most frequent type (smallest on ties), distinct types, rows.

    Counting per (order, type) first lets a hot order combine before the shuffle, and the
    mode and the distinct count then need no collected values. Without ``types`` those two are
    absent, and payments are shuffled once.
    """
    if not types:
        return payments.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
            sum0("payment_value").alias("payment_value"),
            F.max("payment_installments").alias("payment_installments"),
            F.count(F.lit(1)).alias("payment_rows"),
        )
    per_type = payments.groupBy("order_id", "payment_type").agg(
        sum0("payment_value").alias("_v"), F.max("payment_installments").alias("_i"), F.count(F.lit(1)).alias("_n")
    )
    known = F.col("payment_type").isNotNull()
    return per_type.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.sum("_v").alias("payment_value"),
        F.max("_i").alias("payment_installments"),
        F.min_by("payment_type", F.when(known, F.struct(-F.col("_n"), F.col("payment_type")))).alias("payment_type"),
        F.count("payment_type").alias("payment_methods_count"),
        F.sum("_n").alias("payment_rows"),
    )


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    """Mean score, distinct reviews and first creation date per order."""
    return reviews.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.avg("review_score").alias("review_score"),
        F.countDistinct("review_id").alias("review_count"),
        F.min("review_creation_date").alias("review_creation_date"),
    )


def english_categories(products: DataFrame, translations: DataFrame) -> DataFrame:
    """Attach the English category: translation, else the original name, else 'unknown'."""
    return products.join(translations, "product_category_name", "left").withColumn(
        CATEGORY, F.coalesce(CATEGORY, "product_category_name", F.lit(UNKNOWN))
    )


def build_enriched(tables: Mapping[str, DataFrame], columns: Iterable[str] | None = None) -> DataFrame:
    """One row per order item with everything known about it.

    ``columns`` restricts the result; a source table none of them needs is not joined at all
    (the optimizer prunes columns but cannot know that a dimension key is unique).
    """
    derived = _derived()
    wanted = list(dict.fromkeys(columns)) if columns is not None else list(ENRICHED_COLUMNS)
    needed: set[str] = set(wanted)
    for name in wanted:
        if name in derived:
            needed.update(derived[name][0])

    side = lambda available: [c for c in available if c in needed]
    df = tables["items"].select("order_id", *[c for c in ITEM_COLUMNS if c != "order_id" and (c in needed or c in ("product_id", "seller_id"))])

    sellers, few = None, False
    if seller_side := side(SELLER_COLUMNS):
        sellers = tables["sellers"].select("seller_id", *seller_side)
        few = sellers.limit(FEW_SELLERS + 1).count() <= FEW_SELLERS
    if sellers is not None and not few:
        df = df.join(sellers, "seller_id", "left")
    product_side = side(PRODUCT_COLUMNS)
    if CATEGORY in needed:
        products = english_categories(tables["products"], tables["translations"])
        df = df.join(products.select("product_id", *product_side, CATEGORY), "product_id", "left")
    elif product_side:
        df = df.join(tables["products"].select("product_id", *product_side), "product_id", "left")

    order_side, customer_side = side(ORDER_COLUMNS), side(CUSTOMER_COLUMNS)
    if order_side or customer_side:
        orders = tables["orders"].select("order_id", *dict.fromkeys([*order_side, *(["customer_id"] if customer_side else [])]))
        if customer_side:
            orders = orders.join(tables["customers"].select("customer_id", *customer_side), "customer_id", "left")
        df = df.join(orders, "order_id", "left")
    if payment_side := side(PAYMENT_COLUMNS):
        types = not {"payment_type", "payment_methods_count"}.isdisjoint(payment_side)
        df = df.join(payments_per_order(tables["payments"], types).select("order_id", *payment_side), "order_id", "left")
    if review_side := side(REVIEW_COLUMNS):
        df = df.join(reviews_per_order(tables["reviews"]).select("order_id", *review_side), "order_id", "left")
    if few:
        df = df.join(F.broadcast(sellers), "seller_id", "left")

    return df.select(*[derived[c][1].alias(c) if c in derived else F.col(c) for c in wanted])


def delivered(enriched: DataFrame, year: int | None = None) -> DataFrame:
    """Items of delivered orders, of one purchase year if given."""
    out = enriched.where("is_delivered")
    return out if year is None else out.where(F.col("year") == year)
