"""Features from one pass of sums."""

import pytest

from tidebook.operators import early, prediction


@pytest.fixture
def items(spark):
    row = lambda order, cat, month, price, n, low, cs, ss, year=2017, ok=True: (
        cat, month, year, ok, order, price, 1.0, 0.5, n, 4.0, low, 2.0, 10.0, 6.0, 1.0, 5.0, 7.0, cs, ss)
    columns = (
        "product_category_name_english string, month int, year int, is_delivered boolean, order_id int, price double, freight_value double, "
        "freight_share double, payment_installments int, review_score double, is_low_review boolean, delivery_time_days double, product_weight_g double, "
        "product_volume_cm3 double, product_photos_qty double, product_name_lenght double, product_description_lenght double, customer_state string, seller_state string"
    )
    return spark.createDataFrame([
        row(1, "a", 1, 1.0, 6, True, "X", "P"), row(1, "a", 1, 1.0, 6, True, "X", "P"), row(2, "a", 6, None, None, False, None, "P"), row(3, "a", 9, 7.0, 1, False, "Y", None),
        row(4, None, 2, 3.0, 8, True, "Z", "Q"), row(5, "b", 3, None, None, False, None, None), row(6, "a", 2, 99.0, 9, True, "V", "R", 2016), row(7, "a", 1, 50.0, 9, True, "W", "S", ok=False),
    ], columns)


@pytest.fixture
def daily(spark):
    return spark.sql("SELECT c AS category, make_date(2017, m, 3) AS order_date, 4L AS orders_count FROM VALUES ('a'), ('b'), (null) t(c), VALUES (1), (6), (9) u(m)")


def test_first_half_from_the_sums_of_all_items(items, daily):
    key = lambda r: r["category"]
    want = sorted(early.h1_features(items, daily).collect(), key=key)
    got = sorted(early.h1_features(None, daily, sums=early.state_sums(items, 2017)).collect(), key=key)
    assert got == want and [r["category"] for r in got] == ["a", "b", "unknown"]
    a, b, _ = got
    assert (a["h1_revenue"], a["h1_avg_item_price"], a["h1_avg_payment_installments"], a["h1_customer_state_nunique"], a["h1_seller_state_nunique"]) == (2.0, 1.0, 6.0, 1, 1)
    assert a["h1_share_installments_6_plus"] == pytest.approx(2 / 3)
    assert (b["h1_revenue"], b["h1_avg_item_price"], b["h1_share_installments_6_plus"], b["h1_customer_state_nunique"]) == (0.0, None, 0.0, 0)


def test_features_of_all_items(items, daily):
    prices = items.select(*prediction.PRICE_SOURCE)
    sums = early.state_sums(items, 2017)
    got = {r["category"]: r for r in prediction.category_features(prices, daily, sums).collect()}
    assert got == {r["category"]: r for r in prediction.category_features(items, daily).collect()} and set(got) == {"a", "b"}
    a = got["a"]
    assert (a["total_revenue"], a["avg_price"], a["median_price"], a["customer_state_nunique"], a["seller_state_nunique"]) == (108.0, 27.0, 4.0, 3, 2)
    assert (a["share_low_reviews"], a["share_installments_6_plus"], a["avg_payment_installments"], a["total_orders"]) == (0.6, 0.6, 5.5, 12)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
