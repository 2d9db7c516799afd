"""Weekly demand series, hold-out split and naive forecasts.

After the weekly counts every frame has one row per calendar week.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidebook.functions.calendar import fill_dates
from tidebook.operators.enrich import delivered

FORECAST_COLUMNS = ("order_id", "order_date", "is_delivered")
MODELS = ("last_4_week_mean", "seasonal_naive_or_8w_mean")


def weekly_series(enriched: DataFrame, cutoff: str | None = "2018-08-27") -> DataFrame:
    """(week_start, y): delivered orders per Monday week, gaps 0, weeks after the cut-off dropped."""
    day = F.col("order_date")
    weekly = (
        delivered(enriched)
        .where(day.isNotNull())
        .groupBy(F.date_sub(day, F.weekday(day)).alias("week_start"))
        .agg(F.countDistinct("order_id").alias("n"))
    )
    series = fill_dates(weekly, "week_start", {"n": F.lit(0)}, 7).select("week_start", F.col("n").cast("double").alias("y"))
    return series if cutoff is None else series.where(F.col("week_start") <= F.lit(cutoff).cast("date"))


def forecast_holdout(series: DataFrame, min_weeks: int = 50) -> DataFrame:
    """Actual and forecast per held-out week; empty when the series is too short.

    The horizon is an eighth of the series between 4 and 8 weeks. The seasonal forecast is the
    value 52 weeks earlier if the training part has it for every held-out week, else the mean
    of the last eight training weeks.
    """
    whole = W.partitionBy()
    weeks = F.count(F.lit(1)).over(whole)
    horizon = F.least(F.lit(8), F.greatest(F.lit(4), F.floor(weeks / 8).cast("int")))
    numbered = series.withColumns(
        {"_n": weeks, "_h": horizon, "_back": F.row_number().over(W.partitionBy().orderBy(F.desc("week_start")))}
    )
    in_tail = lambda k: (F.col("_back") > F.col("_h")) & (F.col("_back") <= F.col("_h") + k)
    tail_mean = lambda k: F.avg(F.when(in_tail(k), F.col("y"))).over(whole)
    prepared = numbered.withColumns({"_m4": tail_mean(4), "_m8": tail_mean(8)})
    train = prepared.where(F.col("_back") > F.col("_h")).select(
        F.date_add("week_start", 52 * 7).alias("week_start"), F.col("y").alias("_naive")
    )
    test = prepared.where((F.col("_back") <= F.col("_h")) & (F.col("_n") >= min_weeks)).join(train, "week_start", "left")
    complete = F.count("_naive").over(whole) == F.count(F.lit(1)).over(whole)
    return test.select(
        "week_start",
        F.col("y").alias("actual"),
        F.col("_m4").alias("last_4_week_mean"),
        F.when(complete, F.col("_naive")).otherwise(F.col("_m8")).alias("seasonal_naive_or_8w_mean"),
    )


def forecast_comparison(holdout: DataFrame) -> DataFrame:
    """MAE and MAPE per model; weeks with actual 0 are left out of the MAPE."""
    models = [c for c in holdout.columns if c not in ("week_start", "actual")]
    error = F.abs(F.col("actual") - F.col("forecast"))
    return (
        holdout.unpivot(["week_start", "actual"], models, "model", "forecast")
        .groupBy("model")
        .agg(F.avg(error).alias("mae"), F.avg(F.try_divide(error, F.col("actual"))).alias("mape"))
    )
