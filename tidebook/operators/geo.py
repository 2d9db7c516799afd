"""Zip-prefix levels, map coordinates, grids and order metrics per three-digit zip."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.geo import inside_box, mercator_x, mercator_y
from tidebook.functions.quantiles import percentile_columns
from tidebook.functions.scalar import is_true, safe_div, sum0, whole_days
from tidebook.sources.settle import small_side

ZIP = "geolocation_zip_code_prefix"


def zip_prefix_levels(df: DataFrame, column: str = ZIP) -> DataFrame:
    """Add the integer prefixes of 1 to 4 digits and the whole prefix as an integer."""
    levels = {f"{column}_{n}_digits": F.substring(column, 1, n).cast("int") for n in (1, 2, 3, 4)}
    return df.withColumns({**levels, f"{column}_int": F.col(column).cast("int")})


def geo_clip(geolocation: DataFrame) -> DataFrame:
    """Points inside the bounding rectangle of Brazil."""
    return geolocation.where(inside_box("geolocation_lat", "geolocation_lng"))


def geo_points(geolocation: DataFrame) -> DataFrame:
    """Clipped points with zip levels and Web-Mercator metres."""
    return zip_prefix_levels(geo_clip(geolocation)).withColumns(
        {"x": mercator_x("geolocation_lng"), "y": mercator_y("geolocation_lat")}
    )


def geo_grid(points: DataFrame, cell: float, value: str) -> DataFrame:
    """Points, mean and minimum of a value per square cell of ``cell`` metres."""
    index = lambda c: F.floor(F.col(c) / F.lit(float(cell))).cast("long")
    return points.groupBy(index("x").alias("cell_x"), index("y").alias("cell_y")).agg(
        F.count(F.lit(1)).alias("points"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value")
    )


def geo_trim(points: DataFrame, level: str, name: str | int | None = None, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Points of one place (or of every place of a level) without coordinate outliers.

    x is trimmed to its quantile range first, then y to the range of what is left.
    """
    out = points if name is None else points.where(F.col(level) == F.lit(name))
    out = out.where(F.col(level).isNotNull())
    for axis in ("x", "y"):
        cuts = small_side(percentile_columns(out, axis, {"_low": low, "_high": high}, [level]))
        out = out.join(cuts, level).where(F.col(axis).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")
    return out


def order_places(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per order with items and reviews: zip3, multiplicities and sums.

    The source analysis joins orders, items, customers and reviews row by row, so every item
    repeats per review. The sums over that join follow from the two per-order aggregates;
    the pairs themselves are never formed.
    """
    items = tables["items"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("items_n"), sum0("price").alias("price_sum"), sum0("freight_value").alias("freight_sum")
    )
    reviews = tables["reviews"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("reviews_n"), F.sum("review_score").alias("score_sum"), F.count("review_score").alias("score_n")
    )
    customers = tables["customers"].select("customer_id", F.substring("customer_zip_code_prefix", 1, 3).cast("int").alias("zip3"))
    orders = tables["orders"].select(
        "order_id", "customer_id",
        whole_days("order_delivered_carrier_date", "order_delivered_customer_date").alias("days"),
        is_true(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")).alias("is_delayed"),
    )
    return orders.join(customers, "customer_id").join(items, "order_id").join(reviews, "order_id").withColumn(
        "rows_n", F.col("items_n") * F.col("reviews_n")
    )


def zip3_metrics(places: DataFrame) -> DataFrame:
    """Seven order metrics per three-digit customer zip."""
    weighted = lambda value, weight: safe_div(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))
    return places.where(F.col("zip3").isNotNull()).groupBy("zip3").agg(
        F.sum(F.col("price_sum") * F.col("reviews_n")).alias("revenue"),
        F.avg(F.col("price_sum") * F.col("reviews_n")).alias("avg_ticket"),
        F.avg(safe_div("freight_sum", "price_sum")).alias("freight_ratio"),
        weighted("days", "rows_n").alias("avg_delivery_time"),
        safe_div(F.sum(F.col("score_sum") * F.col("items_n")), F.sum(F.col("score_n") * F.col("items_n"))).alias("avg_score"),
        safe_div(F.sum(F.when(F.col("is_delayed"), F.col("rows_n")).otherwise(0)), F.sum("rows_n")).alias("delayed"),
        F.avg("rows_n").alias("avg_qty"),
    )


def points_with_metric(points: DataFrame, metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join of map points with per-zip3 metrics."""
    key = F.col(f"{ZIP}_3_digits")
    # A three-character integer takes at most 1,099 values, so this side is bounded.
    right = F.broadcast(metrics.select(F.col("zip3").alias("_zip3"), *columns))
    return points.join(right, key == F.col("_zip3"), "left").drop("_zip3")
