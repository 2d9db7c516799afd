"""What the enriched table shuffles."""

import pytest

from tidebook.operators import enrich, prediction


@pytest.fixture
def star(spark):
    make = spark.createDataFrame
    return {
        "items": make([(1, 1, 1, 1), (1, 2, 2, None), (2, 1, 1, 9), (None, 1, 1, 1)], "order_id int, order_item_id int, product_id int, seller_id int"),
        "products": make([(1, "c"), (2, None)], "product_id int, product_category_name string"),
        "translations": make([("c", "d")], "product_category_name string, product_category_name_english string"),
        "sellers": make([(1, "S"), (1, "T"), (2, "U")], "seller_id int, seller_state string"),
        "payments": make([(1, "a", 2.0, 1), (1, "b", None, 3), (1, "a", 3.0, 2), (2, None, None, None), (None, "a", 1.0, 1)], "order_id int, payment_type string, payment_value double, payment_installments int"),
    }


def test_sellers_shuffle_no_wide_row(spark, star, monkeypatch):
    columns = ("order_id", "order_item_id", "product_category_name_english", "seller_state", "payment_installments")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    key = lambda r: tuple(map(str, r))
    try:
        few = enrich.build_enriched(star, columns)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(seller_id" not in plan and plan.count("hashpartitioning(order_id") == 2
        monkeypatch.setattr(enrich, "FEW_SELLERS", 1)
        many = enrich.build_enriched(star, columns)
        plan = many._jdf.queryExecution().executedPlan().toString()
        # the deeper join is the one by seller
        assert plan.index("SortMergeJoin [product_id") < plan.index("SortMergeJoin [seller_id")
        assert sorted(map(key, few.collect())) == sorted(map(key, many.collect())) and few.count() == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_payments_without_types(star):
    whole = enrich.payments_per_order(star["payments"])
    plain = enrich.payments_per_order(star["payments"], types=False)
    assert sorted(plain.collect()) == sorted(whole.select(*plain.columns).collect())
    assert plain.where("order_id = 2").first()["payment_value"] == 0.0


def test_prices_count_items_of_repeated_keys(spark, star):
    make = spark.createDataFrame
    more = star | {
        "items": make([(1, 1, 1, 3.0), (2, 1, 2, 5.0)], "order_id int, product_id int, seller_id int, price double"),
        "orders": make([(1, 7, "delivered"), (2, 8, "delivered")], "order_id int, customer_id int, order_status string"),
        "customers": make([(7, "X"), (8, "X"), (8, "Y"), (8, "Y")], "customer_id int, customer_state string"),
    }
    # two sellers 1, three customers 8
    assert sorted(r["price"] for r in enrich.build_enriched(more, prediction.PRICE_SOURCE).collect()) == [3.0, 3.0, 5.0, 5.0, 5.0]
