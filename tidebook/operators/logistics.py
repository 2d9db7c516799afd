"""Lead times, delivery distance and delivery-time features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.calendar import fill_dates
from tidebook.functions.geo import haversine_km
from tidebook.functions.scalar import is_true, sum0, time_between, whole_days

Tables = Mapping[str, DataFrame]

_BOUGHT, _APPROVED = "order_purchase_timestamp", "order_approved_at"
_CARRIER, _RECEIVED, _PROMISED = "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"


def lead_times(orders: DataFrame) -> DataFrame:
    """Add elapsed lead times (floored) and the boundary-counting dashboard measures."""
    return orders.withColumns(
        {
            "est_lead_days": whole_days(_BOUGHT, _PROMISED),
            "act_lead_days": whole_days(_BOUGHT, _RECEIVED),
            "approval_mins": time_between("MINUTE", _BOUGHT, _APPROVED),
            "purchase_to_carrier_days": whole_days(_BOUGHT, _CARRIER),
            "carrier_to_customer_days": whole_days(_CARRIER, _RECEIVED),
            "processing_minutes": time_between("MINUTE", _BOUGHT, _APPROVED, "boundary"),
            "processing_hours": time_between("HOUR", _BOUGHT, _APPROVED, "boundary"),
            "approved_to_carrier_days": time_between("DAY", _APPROVED, _CARRIER, "boundary"),
            "carrier_to_customer_dates": time_between("DAY", _CARRIER, _RECEIVED, "boundary"),
            "customer_vs_estimate_days": time_between("DAY", _RECEIVED, _PROMISED, "boundary"),
            "approved_to_customer_days": time_between("DAY", _APPROVED, _RECEIVED, "boundary"),
        }
    )


LEAD_TIMES = ("est_lead_days", "act_lead_days", "approval_mins", "purchase_to_carrier_days", "carrier_to_customer_days")


def lead_time_by_quarter(orders: DataFrame) -> DataFrame:
    """Mean lead times per purchase quarter and status."""
    quarter = F.concat(F.year(_BOUGHT).cast("string"), F.lit("."), F.quarter(_BOUGHT).cast("string"))
    return lead_times(orders).groupBy(quarter.alias("year_quarter"), "order_status").agg(
        *[F.avg(c).alias(f"avg_{c}") for c in LEAD_TIMES]
    )


def order_cost_flags(items: DataFrame) -> DataFrame:
    """Item number times price and freight, their sum, and whether freight reaches the price."""
    return items.withColumns(
        {
            "order_price": F.col("order_item_id") * F.col("price"),
            "order_freight": F.col("order_item_id") * F.col("freight_value"),
            "total_order_cost": F.col("order_item_id") * F.col("price") + F.col("order_item_id") * F.col("freight_value"),
            "freight_over_price": F.when(F.col("freight_value") >= F.col("price"), 1).when(F.col("freight_value") < F.col("price"), 0),
        }
    )


def geo_first(geolocation: DataFrame) -> DataFrame:
    """One point per zip prefix: the lowest (lat, lng, city, state)."""
    point = F.struct("geolocation_lat", "geolocation_lng", "geolocation_city", "geolocation_state")
    return (
        geolocation.where(F.col("geolocation_zip_code_prefix").isNotNull())
        .groupBy("geolocation_zip_code_prefix")
        .agg(F.min(point).alias("p"))
        .select("geolocation_zip_code_prefix", "p.*")
    )


def mono_seller_orders(items: DataFrame) -> DataFrame:
    """Orders served by exactly one seller (lowest and highest seller agree, no distinct set needed)."""
    return (
        items.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(F.min("seller_id").alias("seller_id"), F.max("seller_id").alias("_last"), F.count(F.lit(1)).alias("items_count"))
        .where(F.col("seller_id") == F.col("_last"))
        .drop("_last")
    )


def order_package(items: DataFrame, products: DataFrame) -> DataFrame:
    """Package volume and weight per order, missing measures counting as 0."""
    volume = F.col("product_length_cm") * F.col("product_width_cm") * F.col("product_height_cm")
    sized = products.select("product_id", volume.alias("_v"), F.col("product_weight_g").alias("_w"))
    return (
        items.select("order_id", "product_id")
        .join(sized, "product_id", "left")
        .where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(sum0("_v").alias("product_size_cm3"), sum0("_w").alias("product_weight_g"))
    )


def delivery_data(tables: Tables) -> DataFrame:
    """Item rows of single-seller orders with distance, package and whole days of waiting.

    Coordinates are attached to customers and sellers, not to the item rows. Rows with any
    missing order date, zip or coordinate are dropped; the approval time may be missing.
    """
    zips = geo_first(tables["geolocation"])

    def placed(df: DataFrame, key: str, zip_column: str, role: str) -> DataFrame:
        named = zips.select(
            F.col("geolocation_zip_code_prefix").alias(zip_column),
            *[F.col(f"geolocation_{c}").alias(f"geolocation_{c}_{role}") for c in ("lat", "lng", "state")],
        )
        return df.select(key, zip_column).join(named, zip_column, "inner").drop(zip_column)

    sellers = placed(tables["sellers"], "seller_id", "seller_zip_code_prefix", "seller")
    customers = placed(tables["customers"], "customer_id", "customer_zip_code_prefix", "customer")
    orders = tables["orders"].drop(_APPROVED).dropna().join(customers, "customer_id", "inner")
    # A single-seller order repeats the same row per item: keep one row and its multiplicity.
    single = mono_seller_orders(tables["items"]).join(sellers, "seller_id", "inner")
    package = order_package(tables["items"], tables["products"])
    distance = haversine_km(
        "geolocation_lng_seller", "geolocation_lat_seller", "geolocation_lng_customer", "geolocation_lat_customer"
    )
    return orders.join(single, "order_id", "inner").join(package, "order_id", "left").select(
        "order_id", _BOUGHT, _RECEIVED, _PROMISED,
        "geolocation_state_customer", "geolocation_state_seller",
        "geolocation_lat_seller", "geolocation_lng_seller",
        distance.alias("distance"),
        "product_size_cm3", "product_weight_g",
        whole_days(_BOUGHT, _RECEIVED).alias("wait_time"),
        whole_days(_BOUGHT, _PROMISED).alias("estimated_wait"),
        F.weekday(_BOUGHT).alias("purchase_dow"),
        F.year(_BOUGHT).alias("year"),
        F.month(_BOUGHT).alias("purchase_month"),
        F.col("items_count").alias("count"),
    )


def daily_resample(data: DataFrame) -> DataFrame:
    """Items per calendar day by purchase and by delivery, gaps 0, with the mean wait."""
    both = F.inline(
        F.array(
            *[F.struct(F.lit(b).alias("basis"), F.to_date(ts).alias("day")) for b, ts in (("purchase", _BOUGHT), ("delivery", _RECEIVED))]
        )
    )
    daily = data.select("count", "wait_time", both).groupBy("basis", "day").agg(
        F.sum("count").alias("count"), (F.sum(F.col("wait_time") * F.col("count")) / F.sum("count")).alias("mean_wait_time")
    )
    filled = fill_dates(daily, "day", {"count": F.lit(0), "mean_wait_time": F.lit(None)}, by=["basis"])
    return filled.withColumn("dow", F.weekday("day"))


def directed_error(data: DataFrame, predicted: str = "estimated_wait", actual: str = "wait_time", weight: str = "count") -> DataFrame:
    """Mean of predicted - actual; positive means earlier than predicted."""
    error = (F.col(predicted) - F.col(actual)) * F.col(weight)
    return data.agg((F.sum(error) / F.sum(weight)).alias("directed_error"), F.sum(weight).alias("rows"))


def seller_heat(data: DataFrame) -> DataFrame:
    """Items per seller coordinate."""
    return data.groupBy("geolocation_lat_seller", "geolocation_lng_seller").agg(F.sum("count").alias("count"))


def delivery_hist(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Item rows per whole day from purchase to delivery."""
    sizes = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"))
    days = orders.select("order_id", whole_days(_BOUGHT, _RECEIVED).alias("day_to_delivery")).where("day_to_delivery IS NOT NULL")
    return days.join(sizes, "order_id").groupBy("day_to_delivery").agg(F.sum("_n").alias("freq"))


def state_flow(enriched: DataFrame) -> DataFrame:
    """Items per order status, customer state and seller state, and those within one zip."""
    same = is_true(F.col("customer_zip_code_prefix") == F.col("seller_zip_code_prefix"))
    return enriched.groupBy("order_status", "customer_state", "seller_state").agg(
        F.count(F.lit(1)).alias("items_count"), F.count_if(same).alias("same_zip_count")
    )


def same_zip_share(enriched: DataFrame) -> DataFrame:
    """Share of items whose customer and seller share the zip prefix, per status."""
    same = is_true(F.col("customer_zip_code_prefix") == F.col("seller_zip_code_prefix")).cast("double")
    return enriched.groupBy("order_status").agg(F.count(F.lit(1)).alias("items_count"), F.avg(same).alias("same_zip_share"))
