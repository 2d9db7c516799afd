"""Line metrics of the most seasonal categories and top-N entities per period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidebook.functions.calendar import month_name, weekday_name
from tidebook.functions.scalar import sum0
from tidebook.operators.enrich import CATEGORY, UNKNOWN, delivered
from tidebook.operators.seasonality import top_seasonal

LINE_COLUMNS = (
    CATEGORY, "year", "is_delivered", "quarter", "month", "week", "weekday", "order_id", "order_item_id", "price", "product_id",
)
GRAINS = ("quarter", "month", "week", "weekday")


def _volumes() -> list[Column]:
    return [
        F.countDistinct("order_id").alias("orders_count"),
        F.count("order_item_id").alias("items_sold"),
        sum0("price").alias("revenue"),
    ]


def category_items(enriched: DataFrame, year: int = 2017) -> DataFrame:
    """Delivered items of a year with a filled-in category."""
    return delivered(enriched, year).withColumn("category", F.coalesce(CATEGORY, F.lit(UNKNOWN)))


def line_metrics(enriched: DataFrame, ranking: DataFrame, grain: str, year: int = 2017, top: int = 8) -> DataFrame:
    """Orders, items and revenue of the top categories per quarter, month, week or weekday."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
    names = F.broadcast(top_seasonal(ranking, top).select("category"))  # at most ``top`` rows
    out = category_items(enriched, year).join(names, "category", "left_semi").groupBy("category", grain).agg(*_volumes())
    if grain == "month":
        return out.withColumn("month_name", month_name("month"))
    if grain == "week":
        return out.withColumn("week_start", F.to_date(F.substring("week", 1, 10)))
    if grain == "weekday":
        return out.withColumn("weekday_name", weekday_name("weekday"))
    return out


def top_n_by_period(data: DataFrame, period: Sequence[str], entity: Sequence[str], n: int) -> DataFrame:
    """The n best entities of each period by orders, revenue, items, then entity.

    The rank filter is pushed below the shuffle as a per-task limit, so a period never
    gathers all its entities in one task.
    """
    grouped = data.groupBy(*period, *entity).agg(*_volumes())
    order = [F.desc("orders_count"), F.desc("revenue"), F.desc("items_sold"), *[F.col(e).asc_nulls_last() for e in entity]]
    rank = F.row_number().over(W.partitionBy(*period).orderBy(*order))
    return grouped.withColumn("rank", rank).where(F.col("rank") <= n)


def top_by_period(enriched: DataFrame, period: str, entity: Sequence[str], n: int, year: int = 2017) -> DataFrame:
    out = top_n_by_period(category_items(enriched, year), [period], list(entity), n)
    return out.withColumn("month_name", month_name("month")) if period == "month" else out
