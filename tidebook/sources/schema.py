"""Explicit schemas of the nine source tables (no inference scans).

Column names, misspellings included, are fixed values of the data set.
"""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _DOUBLE, _INT, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


SCHEMAS: dict[str, T.StructType] = {
    "orders": _schema(
        ("order_id", _STRING),
        ("customer_id", _STRING),
        ("order_status", _STRING),
        ("order_purchase_timestamp", _TS),
        ("order_approved_at", _TS),
        ("order_delivered_carrier_date", _TS),
        ("order_delivered_customer_date", _TS),
        ("order_estimated_delivery_date", _TS),
    ),
    "items": _schema(
        ("order_id", _STRING),
        ("order_item_id", _INT),
        ("product_id", _STRING),
        ("seller_id", _STRING),
        ("shipping_limit_date", _TS),
        ("price", _DOUBLE),
        ("freight_value", _DOUBLE),
    ),
    "products": _schema(
        ("product_id", _STRING),
        ("product_category_name", _STRING),
        ("product_name_lenght", _DOUBLE),
        ("product_description_lenght", _DOUBLE),
        ("product_photos_qty", _DOUBLE),
        ("product_weight_g", _DOUBLE),
        ("product_length_cm", _DOUBLE),
        ("product_height_cm", _DOUBLE),
        ("product_width_cm", _DOUBLE),
    ),
    "translations": _schema(
        ("product_category_name", _STRING),
        ("product_category_name_english", _STRING),
    ),
    "payments": _schema(
        ("order_id", _STRING),
        ("payment_sequential", _INT),
        ("payment_type", _STRING),
        ("payment_installments", _INT),
        ("payment_value", _DOUBLE),
    ),
    "reviews": _schema(
        ("review_id", _STRING),
        ("order_id", _STRING),
        ("review_score", _INT),
        ("review_comment_title", _STRING),
        ("review_comment_message", _STRING),
        ("review_creation_date", _TS),
        ("review_answer_timestamp", _TS),
    ),
    "customers": _schema(
        ("customer_id", _STRING),
        ("customer_unique_id", _STRING),
        ("customer_zip_code_prefix", _STRING),
        ("customer_city", _STRING),
        ("customer_state", _STRING),
    ),
    "sellers": _schema(
        ("seller_id", _STRING),
        ("seller_zip_code_prefix", _STRING),
        ("seller_city", _STRING),
        ("seller_state", _STRING),
    ),
    "geolocation": _schema(
        ("geolocation_zip_code_prefix", _STRING),
        ("geolocation_lat", _DOUBLE),
        ("geolocation_lng", _DOUBLE),
        ("geolocation_city", _STRING),
        ("geolocation_state", _STRING),
    ),
}

# File name patterns: exports differ in their prefix only.
FILES: dict[str, str] = {
    "orders": "*_orders_dataset.csv",
    "items": "*_order_items_dataset.csv",
    "products": "*_products_dataset.csv",
    "translations": "product_category_name_translation.csv",
    "payments": "*_order_payments_dataset.csv",
    "reviews": "*_order_reviews_dataset.csv",
    "customers": "*_customers_dataset.csv",
    "sellers": "*_sellers_dataset.csv",
    "geolocation": "*_geolocation_dataset.csv",
}

# Macro regions of the 27 states.
STATE_REGIONS: dict[str, tuple[str, ...]] = {
    "Southeast": ("SP", "RJ", "ES", "MG"),
    "Northeast": ("MA", "PI", "CE", "RN", "PE", "PB", "SE", "AL", "BA"),
    "North": ("AM", "RR", "AP", "PA", "TO", "RO", "AC"),
    "Midwest": ("MT", "GO", "MS", "DF"),
    "South": ("SC", "RS", "PR"),
}
