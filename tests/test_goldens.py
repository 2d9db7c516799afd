"""A few published result rows, retyped, through the operators that derive from them."""

import datetime as dt

import pytest

from tidebook.functions import stats
from tidebook.operators import forecast, prediction, seasonality

COLUMNS = (
    "category string, total_orders long, active_months long, cv double, peak_to_mean double, peak_month_share double, peak_quarter_share double, "
    "peak_quarter int, confidence_level string, event_spike_count long, weekly_pattern_strength double, trend_strength double, seasonality_score double"
)


def test_published_forecast_errors(spark):
    weeks = [
        ("2018-07-09", 972.0, 1375.0, 926.0),
        ("2018-07-16", 1649.0, 1375.0, 937.0),
    ]
    df = spark.createDataFrame(
        [(dt.date.fromisoformat(w), a, m, n) for w, a, m, n in weeks],
        "week_start date, actual double, last_4_week_mean double, seasonal_naive_or_8w_mean double",
    )
    out = {r["model"]: r["mae"] for r in forecast.forecast_comparison(df).collect()}
    assert out == {"last_4_week_mean": pytest.approx((403 + 274) / 2), "seasonal_naive_or_8w_mean": pytest.approx((46 + 712) / 2)}


def test_published_low_confidence_rows_classify(spark):
    data = [
        ("diapers_and_hygiene", 1, 1, 3.3166247903554, 12.0, 1.0, 1.0, 4, "low", 0, 1.4, 0.42307692307692313, 3.3166247903554),
        ("flowers", 8, 2, 2.5495097567963927, 9.0, 0.75, 1.0, 4, "low", 0, 1.4482758620689653, 0.48717948717948717, 2.5495097567963927),
    ]
    df = spark.createDataFrame(data, COLUMNS)
    assert {r["t"] for r in df.select(seasonality.seasonality_type().alias("t")).collect()} == {"low_confidence"}


@pytest.mark.parametrize(
    "change, expected",
    [
        ({"confidence_level": "low"}, "low_confidence"),
        ({"trend_strength": 0.6, "cv": 0.9}, "trend_driven"),
        ({"event_spike_count": 3}, "event_driven"),
        ({"cv": 0.3, "peak_to_mean": 1.5}, "stable"),
        ({"peak_month_share": 0.35}, "single_month_spike"),
        ({"peak_to_mean": 2.6}, "single_month_spike"),
        ({"peak_quarter_share": 0.34, "peak_quarter": 4}, "holiday_q4"),
        ({"peak_quarter_share": 0.34, "peak_quarter": 1}, "early_year"),
        ({"peak_quarter_share": 0.34, "peak_quarter": 3}, "mid_year"),
        ({"weekly_pattern_strength": 0.45}, "weekly_pattern"),
        ({}, "mixed_seasonal"),
    ],
)
def test_type_rules(spark, change, expected):
    base = dict(
        category="x", total_orders=300, active_months=12, cv=0.5, peak_to_mean=1.8, peak_month_share=0.2, peak_quarter_share=0.3,
        peak_quarter=2, confidence_level="high", event_spike_count=0, weekly_pattern_strength=0.1, trend_strength=0.1, seasonality_score=0.5,
    )
    base.update(change)
    df = spark.createDataFrame([tuple(base.values())], COLUMNS)
    assert df.select(seasonality.seasonality_type().alias("t")).first()["t"] == expected


# Published categories as (category, orders, active months, score).
PUBLISHED = [
    ("drinks", 70, 9, 1.4843400237554902), ("computers", 121, 7, 1.3345252282607556), ("construction_tools_construction", 100, 10, 1.2531560158256432),
    ("home_construction", 110, 11, 1.148336921791864), ("food_drink", 104, 10, 0.9330391900544774),
    ("kitchen_dining_laundry_garden_furniture", 105, 12, 0.833482979760847), ("stationery", 897, 12, 0.7802731254768075),
    ("electronics", 810, 12, 0.7789761491072207), ("home_appliances", 232, 11, 0.7370563620620364), ("costruction_tools_garden", 62, 10, 0.736304013581505),
    ("audio", 159, 11, 0.7233251278203815), ("watches_gifts", 2073, 12, 0.7031364194279757), ("consoles_games", 640, 12, 0.6468674516467804),
    ("garden_tools", 1934, 12, 0.6233688152242748), ("toys", 2404, 12, 0.6141232368917439), ("books_general_interest", 214, 12, 0.594689281118992),
    ("home_confort", 246, 11, 0.5804331462959849), ("musical_instruments", 241, 12, 0.5725990737096663),
]


def test_published_top_categories(spark):
    df = spark.createDataFrame(PUBLISHED, "category string, total_orders long, active_months long, seasonality_score double")
    top = {r["setting"]: r["top10_categories"] for r in seasonality.robustness(df).collect()}
    assert top == {
        "min_orders_50": "computers; construction_tools_construction; costruction_tools_garden; drinks; electronics; food_drink; home_appliances; "
        "home_construction; kitchen_dining_laundry_garden_furniture; stationery",
        "min_orders_100": "audio; computers; construction_tools_construction; electronics; food_drink; home_appliances; home_construction; "
        "kitchen_dining_laundry_garden_furniture; stationery; watches_gifts",
        "min_orders_200": "books_general_interest; consoles_games; electronics; garden_tools; home_appliances; home_confort; musical_instruments; "
        "stationery; toys; watches_gifts",
    }


def test_published_spikes_sum_up(spark):
    spikes = [
        ("agro_industry_and_commerce", "2017-11-23", 3.6787679096857056), ("agro_industry_and_commerce", "2018-02-28", 4.58822970783415),
        ("agro_industry_and_commerce", "2018-07-18", 4.58822970783415), ("agro_industry_and_commerce", "2018-07-19", 3.398890850909079),
        ("watches_gifts", "2017-02-28", 3.927877250751313), ("watches_gifts", "2017-05-24", 3.3280839181011634),
        ("watches_gifts", "2017-10-16", 3.2229581657983064), ("watches_gifts", "2017-11-24", 4.91160107791057), ("watches_gifts", "2018-04-26", 3.0996168504537733),
    ]
    df = spark.createDataFrame([(c, dt.date.fromisoformat(d), z) for c, d, z in spikes], "category string, order_date date, z_score double")
    out = {r["category"]: (r["event_spike_count"], r["max_spike_z_score"]) for r in seasonality.spike_counts(df).collect()}
    assert out == {"agro_industry_and_commerce": (4, 4.58822970783415), "watches_gifts": (5, 4.91160107791057)}


# Published numbers of customer states of the 67 categories, in order of name.
STATES = (
    "9 9 9 1 15 22 23 25 16 1 6 3 4 2 25 20 7 1 26 9 1 3 8 23 7 19 2 9 15 8 7 17 12 5 5 27 17 3 24 27 16 8 3 14 9 24 4 9 2 19 17 4 15 20 25 23 1 6 13 1 "
    "26 23 14 26 26 24 24"
).split()


def test_published_percent_ranks(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(STATES)], "i int, states double")
    ranks = {r["i"]: r["r"] for r in df.select("i", stats.percent_rank_avg("states").alias("r")).collect()}
    # agro industry, air conditioning, art; arts and craftmanship; audio; auto
    assert [ranks[i] for i in range(6)] == pytest.approx(
        [0.44776119402985076, 0.44776119402985076, 0.44776119402985076, 0.05223880597014925, 0.582089552238806, 0.746268656716418]
    )


@pytest.mark.parametrize("rows, positive, n_train, n_test", [(39, 10, 25, 14), (36, 9, 23, 13)])
def test_published_split_sizes(spark, rows, positive, n_train, n_test):
    df = spark.createDataFrame([(f"c{i}", int(i < positive)) for i in range(rows)], "category string, label int")
    split = prediction.stratified_split(df, "label", "category").collect()
    assert (sum(not r["is_test"] for r in split), sum(r["is_test"] for r in split)) == (n_train, n_test)
    assert sum(r["is_test"] and r["label"] for r in split) in (int(n_test * positive / rows), int(n_test * positive / rows) + 1)


def test_robustness_lists_every_setting(spark):
    data = [("b", 120, 7, 0.9), ("a", 60, 6, 0.7), ("c", 500, 5, 0.99)]
    df = spark.createDataFrame(data, "category string, total_orders long, active_months long, seasonality_score double")
    out = {r["setting"]: (r["n_categories"], r["top10_categories"]) for r in seasonality.robustness(df).collect()}
    assert out == {"min_orders_50": (2, "a; b"), "min_orders_100": (1, "b"), "min_orders_200": (0, "")}
