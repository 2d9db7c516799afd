"""Calendar features of a timestamp, and dense calendar spines.

Everything is date arithmetic, so the session time zone has no influence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidebook.functions.scalar import col

# English names, January first and Monday first.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTH_LABELS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def _name(names: Sequence[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), position)


def month_name(month: Column | str) -> Column:
    return _name(MONTH_NAMES, col(month).cast("int"))


def month_label(month: Column | str) -> Column:
    return _name(MONTH_LABELS, col(month).cast("int"))


def weekday_name(weekday: Column | str) -> Column:
    return _name(WEEKDAY_NAMES, (col(weekday) + 1).cast("int"))


def year_month(ts: Column | str) -> Column:
    return F.concat(F.year(col(ts)).cast("string"), F.lit("-"), F.lpad(F.month(col(ts)).cast("string"), 2, "0"))


def week_start(ts: Column | str) -> Column:
    """Monday of the week."""
    day = F.to_date(col(ts))
    return F.date_sub(day, F.weekday(day))


def week_range(ts: Column | str) -> Column:
    """Monday-to-Sunday label, e.g. 2017-11-20/2017-11-26."""
    monday = week_start(ts)
    return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))


def with_calendar(df: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    """Add year, quarter, month, month_name, year_month, week, order_date, weekday, weekday_name."""
    return df.withColumns(
        {
            "year": F.year(ts),
            "quarter": F.quarter(ts),
            "month": F.month(ts),
            "month_name": month_name(F.month(ts)),
            "year_month": year_month(ts),
            "week": week_range(ts),
            "order_date": F.to_date(ts),
            "weekday": F.weekday(ts),
            "weekday_name": weekday_name(F.weekday(ts)),
        }
    )


def with_fine_calendar(df: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    """Add day of month, hour, quarter with year (2017.4) and the full month label."""
    return df.withColumns(
        {
            "monthday": F.dayofmonth(ts),
            "hour": F.hour(ts),
            "year_quarter": F.concat(F.year(ts).cast("string"), F.lit("."), F.quarter(ts).cast("string")),
            "month_label": month_label(F.month(ts)),
        }
    )


def dense_months(
    monthly: DataFrame, key: str, metrics: Sequence[str], months: tuple[int, int] = (1, 12), unknown: str | None = None
) -> DataFrame:
    """One row per key and month; a month the key lacks gets 0 in *every* metric.

    ``monthly`` holds at most one row per (key, month). With ``unknown``, rows whose key is
    NULL contribute no values but make that name appear as a key. Each key carries at most
    one entry per month, so the lookup map is bounded, and no second scan or join is needed.
    """
    entry = F.struct(F.col("month").cast("int").alias("month"), F.struct(*metrics).alias("values"))
    label = F.col(key) if unknown is None else F.coalesce(F.col(key), F.lit(unknown))
    source = monthly.where(F.col(key).isNotNull()) if unknown is None else monthly
    maps = source.groupBy(label.alias("_key")).agg(
        F.map_from_entries(F.collect_list(F.when(F.col(key).isNotNull(), entry))).alias("_by_month")
    )
    spine = maps.select(
        F.col("_key").alias(key),
        F.explode(F.sequence(F.lit(months[0]), F.lit(months[1]))).alias("month"),
        "_by_month",
    ).withColumn("_v", F.try_element_at("_by_month", F.col("month")))
    filled = [
        F.when(F.col("_v").isNull(), F.lit(0).cast(monthly.schema[m].dataType)).otherwise(F.col("_v")[m]).alias(m)
        for m in metrics
    ]
    return spine.select(key, "month", *filled)


def fill_dates(df: DataFrame, day: str, values: dict[str, Column], step_days: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Insert the dates missing between consecutive rows, every ``step_days`` days.

    ``values`` gives each value column its filler. Every row emits itself and the gap up to its
    successor, so the frame is read once and needs no join with a spine.
    """
    followed = df.withColumn("_next", F.lead(day).over(W.partitionBy(*by).orderBy(day)))
    until = F.coalesce(F.date_sub("_next", step_days), F.col(day))
    dates = F.sequence(F.col(day), until, F.expr(f"INTERVAL {step_days} DAYS"))
    grown = followed.withColumn("_day", F.explode(dates))
    own = F.col("_day") == F.col(day)
    return grown.select(
        *by, F.col("_day").alias(day), *[F.when(own, F.col(c)).otherwise(filler).alias(c) for c, filler in values.items()]
    )
