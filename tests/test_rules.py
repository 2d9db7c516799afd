"""Null, tie and window rules on literal micro-frames."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.functions import calendar as cal
from tidebook.functions import scalar, stats
from tidebook.functions.geo import haversine_km, mercator_x, mercator_y
from tidebook.functions.quantiles import exact_percentiles, percentile_columns
from tidebook.operators import early, enrich, forecast, models, seasonality


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_null_sum_mean_and_share(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 7.0), ("b", None)], "g string, x double")
    out = {
        r["g"]: r
        for r in rows(df.groupBy("g").agg(scalar.sum0("x").alias("s"), F.avg("x").alias("m"), scalar.share_true(F.col("x") >= 6).alias("p")))
    }
    assert (out["a"]["s"], out["a"]["m"], out["a"]["p"]) == (0.0, None, 0.0)
    assert (out["b"]["s"], out["b"]["p"]) == (7.0, 0.5)


def test_mode_takes_smallest_on_ties_and_null_when_unknown(spark):
    pay = spark.createDataFrame(
        [("o1", "b", 1, 2.0), ("o1", "a", 3, 1.0), ("o1", "b", 1, None), ("o1", "a", 1, 1.0), ("o2", None, None, None)],
        "order_id string, payment_type string, payment_installments int, payment_value double",
    )
    out = {r["order_id"]: r for r in rows(enrich.payments_per_order(pay))}
    assert out["o1"] == {
        "order_id": "o1", "payment_value": 4.0, "payment_installments": 3, "payment_type": "a", "payment_methods_count": 2, "payment_rows": 4,
    }
    assert out["o2"]["payment_type"] is None and out["o2"]["payment_value"] == 0.0 and out["o2"]["payment_methods_count"] == 0


def test_interpolating_percentile_literal(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (2.0,), (5.0,), (None,)], "x double")
    assert exact_percentiles(df, "x", [0.9]).first()["value"] == pytest.approx(3.8)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_percentiles_match_numpy_with_hot_values_and_groups(spark, seed):
    rng = random.Random(seed)
    data = []
    for _ in range(3000):
        group = rng.choice([None, "hot", "hot", "hot", "b"])
        x = rng.choice([42.0, 42.0, rng.uniform(-500, 90000), rng.gauss(0, 1e-3), 0.0, -0.0])
        data.append((group, x))
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame(data, "g string, x double").repartition(7)
    got = {(r["g"], r["q"]): r["value"] for r in rows(exact_percentiles(df, "x", qs, ["g"]))}
    for g in (None, "hot", "b"):
        values = np.array([x for k, x in data if k == g])
        for q in qs:
            assert got[(g, q)] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12)


def test_percentile_of_nothing_is_absent_and_scalar_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_percentiles(df, "x", [0.5]).count() == 0
    assert percentile_columns(df, "x", {"m": 0.5}).first()["m"] is None


def _daily(spark, values, category="c"):
    start = dt.date(2017, 1, 1)
    data = [(category, start + dt.timedelta(days=3 * i), v, v, 1.0) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "category string, order_date date, orders_count long, items_sold long, revenue double")


def test_spikes_need_35_active_days_and_a_full_window(spark):
    short = _daily(spark, [2, 3] * 16 + [2, 90], "short")  # 34 days
    assert seasonality.event_spikes(short).count() == 0
    values = [2, 3] * 17 + [60] + [2] * 5
    out = rows(seasonality.event_spikes(_daily(spark, values)))
    assert [r["orders_count"] for r in out] == [60]
    window = pd.Series(values[5:35], dtype=float)
    assert out[0]["z_score"] == pytest.approx((60 - window.mean()) / window.std(), rel=1e-9)
    assert seasonality.event_spikes(_daily(spark, [4] * 40)).count() == 0  # flat window: deviation 0


def test_dense_months_fill_zeros_and_keep_present_nulls(spark):
    df = spark.createDataFrame(
        [("a", 2, 5, None), ("a", 7, 5, 1.5), (None, 1, 9, 9.0)], "category string, month int, orders_count long, avg_x double"
    )
    out = cal.dense_months(df, "category", ["orders_count", "avg_x"], unknown="unknown")
    got = {(r["category"], r["month"]): (r["orders_count"], r["avg_x"]) for r in rows(out)}
    assert len(got) == 24
    assert got[("a", 2)] == (5, None) and got[("a", 3)] == (0, 0.0) and got[("a", 7)] == (5, 1.5)
    assert all(v == (0, 0.0) for k, v in got.items() if k[0] == "unknown")


def test_profile_ties_choose_first_month_and_lowest_quarter(spark):
    data = [("t", 2, 5, 1.0), ("t", 8, 5, 1.0), ("z", 1, 0, 0.0)]
    monthly = cal.dense_months(
        spark.createDataFrame(data, "category string, month int, orders_count long, revenue double"), "category", ["orders_count", "revenue"]
    )
    out = {r["category"]: r for r in rows(seasonality.category_profile(monthly))}
    assert (out["t"]["peak_month"], out["t"]["peak_quarter"], out["t"]["active_months"]) == (2, 1, 2)
    assert out["t"]["cv"] == pytest.approx(np.std([5, 5] + [0] * 10) / (10 / 12))
    assert out["z"]["cv"] is None and out["z"]["peak_month"] is None and out["z"]["peak_to_min"] is None


def test_product_ranking_equals_zero_filled_definition(spark):
    rng = random.Random(5)
    data = [(p, "c", m, rng.randint(1, 9), 1.0, 1) for p in range(20) for m in rng.sample(range(1, 13), rng.randint(1, 12))]
    df = spark.createDataFrame(data, "product_id long, category string, month int, orders_count long, revenue double, items_sold long")
    for r in rows(seasonality.product_ranking(df)):
        y = np.zeros(12)
        for p, _, m, n, _, _ in data:
            if p == r["product_id"]:
                y[m - 1] = n
        quarters = y.reshape(4, 3).sum(axis=1)
        assert r["seasonality_score"] == pytest.approx(y.std() / y.mean(), abs=1e-12)
        assert (r["peak_month"], r["peak_quarter"]) == (int(y.argmax()) + 1, int(quarters.argmax()) + 1)


def test_percent_rank_matches_average_ranks(spark):
    values = [3.0, 1.0, 3.0, None, 7.0, 1.0, 1.0]
    df = spark.createDataFrame([(i, v, 2.0) for i, v in enumerate(values)], "i int, x double, flat double")
    out = df.select("i", stats.percent_rank_avg("x").alias("r"), stats.percent_rank_avg("flat").alias("f")).orderBy("i").collect()
    expected = pd.Series(values).rank(pct=True)
    for r in out:
        assert (r["r"] is None) if math.isnan(expected[r["i"]]) else r["r"] == pytest.approx(expected[r["i"]])
        assert r["f"] == 0.0


def test_spearman_and_scores_against_pandas(spark):
    pdf = pd.DataFrame({"a": [1, 2, 2, 4, 5, 6.0], "k": [3.0] * 6, "t": [2, 1, 4, 3, 6, 5.0], "y": [0, 0, 1, 0, 1, 1], "s": [0.1, 0.6, 0.6, 0.3, 0.9, 0.4]})
    df = spark.createDataFrame(pdf)
    got = {r["feature"]: r["importance"] for r in rows(stats.spearman_importance(df, ["a", "k"], "t"))}
    assert got["a"] == pytest.approx(abs(pdf["a"].rank().corr(pdf["t"].rank()))) and got["k"] is None
    pairs = [(p > n) + 0.5 * (p == n) for p in pdf.s[pdf.y == 1] for n in pdf.s[pdf.y == 0]]
    out = stats.binary_scores(df, "y", "s").first()
    assert out["roc_auc"] == pytest.approx(np.mean(pairs)) and out["accuracy"] == pytest.approx(4 / 6)


def test_elapsed_and_boundary_durations(spark):
    df = spark.sql("SELECT timestamp_ntz'2017-01-01 23:30:00' a, timestamp_ntz'2017-01-02 00:30:00' b")
    out = df.select(
        scalar.time_between("DAY", "a", "b").alias("e"), scalar.time_between("DAY", "a", "b", "boundary").alias("d"),
        scalar.time_between("HOUR", "a", "b", "boundary").alias("h"), scalar.whole_days("b", "a").alias("neg"), scalar.guarded_days("b", "a").alias("g"),
    ).first()
    assert (out["e"], out["d"], out["h"], out["neg"], out["g"]) == (0, 1, 1, -1, None)


def test_calendar_labels_ignore_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2017-11-24 01:02:03' ts")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        r = cal.with_fine_calendar(cal.with_calendar(df, "ts"), "ts").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (r["week"], r["year_month"], r["weekday"], r["weekday_name"], r["month_name"]) == ("2017-11-20/2017-11-26", "2017-11", 4, "Fri", "Nov")
    assert (r["year_quarter"], r["hour"], r["month_label"]) == ("2017.4", 1, "November")


def test_geo_formulas(spark):
    r = spark.range(1).select(
        haversine_km(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)).alias("d"), mercator_x(F.lit(180.0)).alias("x"), mercator_y(F.lit(0.0)).alias("y")
    ).first()
    assert r["d"] == pytest.approx(6371 * math.pi / 2) and r["x"] == pytest.approx(20037508.34, abs=0.01) and r["y"] == pytest.approx(0, abs=1e-6)


def _weeks(spark, n, skip=()):
    start = dt.date(2016, 10, 3)
    return spark.createDataFrame([(start + dt.timedelta(weeks=i), float(100 + i)) for i in range(n) if i not in skip], "week_start date, y double")


def test_seasonal_naive_is_all_or_nothing(spark):
    full = rows(forecast.forecast_holdout(_weeks(spark, 60)).orderBy("week_start"))
    assert len(full) == 7  # an eighth of 60
    assert [r["seasonal_naive_or_8w_mean"] for r in full] == [100.0 + i - 52 for i in range(53, 60)]
    assert full[0]["last_4_week_mean"] == pytest.approx(100 + np.mean([49, 50, 51, 52]))
    gap = rows(forecast.forecast_holdout(_weeks(spark, 60, skip={3})))
    assert len({r["seasonal_naive_or_8w_mean"] for r in gap}) == 1
    assert forecast.forecast_holdout(_weeks(spark, 49)).count() == 0


def test_comparison_skips_zero_actuals_in_mape(spark):
    df = spark.createDataFrame([(dt.date(2018, 1, 1), 0.0, 2.0), (dt.date(2018, 1, 8), 4.0, 2.0)], "week_start date, actual double, m double")
    r = forecast.forecast_comparison(df).first()
    assert (r["mae"], r["mape"]) == (2.0, 0.5)


def test_fill_dates_inserts_only_gaps(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 3), ("a", dt.date(2020, 1, 4), 5), ("b", dt.date(2020, 1, 2), 7)], "k string, day date, n int")
    out = cal.fill_dates(df, "day", {"n": F.lit(0)}, by=["k"]).orderBy("k", "day").collect()
    assert [(r["k"], r["day"].day, r["n"]) for r in out] == [("a", 1, 3), ("a", 2, 0), ("a", 3, 0), ("a", 4, 5), ("b", 2, 7)]


def test_folds_are_contiguous_equal_and_unique(spark):
    data = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(days=0 if i % 3 else i % 50)) for i in range(1003)]  # one day holds most rows
    out = models.with_folds(spark.createDataFrame(data, "id long, ts timestamp_ntz"), "ts", "id").toPandas()
    sizes = out.groupby("fold").size()
    assert len(out) == 1003 and list(sizes.index) == list(range(10)) and sizes.max() - sizes.min() <= 1
    assert out.groupby("fold")["ts"].max().shift().dropna().le(out.groupby("fold")["ts"].min().iloc[1:]).all()


def test_growth_is_missing_unless_both_months_sold(spark):
    data = [("a", dt.date(2017, 1, 2), 1), ("a", dt.date(2017, 6, 5), 3), ("b", dt.date(2017, 6, 5), 3)]
    df = spark.createDataFrame(data, "category string, order_date date, orders_count long")
    out = {r["category"]: r["h1_growth_jan_to_jun"] for r in rows(early.h1_patterns(df))}
    assert out == {"a": 1.0, "b": None}
