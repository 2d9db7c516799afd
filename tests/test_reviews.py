"""Reviews of odd rows: equal rows, shared reviews and missing keys, and what their steps move."""

import pytest

from tidebook.operators import audit, merged, reviews


@pytest.fixture
def tables(spark):
    make = spark.createDataFrame
    review = "review_id int, order_id int, review_score int, review_comment_title string, review_comment_message string, review_creation_date string"
    order = "order_id int, customer_id int, order_status string, order_approved_at string, order_delivered_carrier_date string, order_estimated_delivery_date string"
    same = (5, "", "m", "d")
    return {
        "reviews": make([(1, 1, *same), (1, 1, *same), (1, 2, *same), (2, 2, *same), (None, 1, *same), (None, 2, *same), (3, None, *same), (4, 3, *same), (5, 4, *same)], review),
        "orders": make([(1, 7, "s", None, "c", "e"), (2, 7, "s", None, "c", "e"), (2, 8, "s", None, "c", "e"), (3, 9, "s", "a", "c", "e"), (None, 7, "s", "a", "c", "e"), (4, 7, "t", "a", "c", "e"), (4, 7, "t", "a", "c", "e")], order),
        "customers": make([(7, "X"), (8, "X"), (8, "Y")], "customer_id int, customer_state string"),
        "items": make([(1, 1), (1, 2), (2, 1), (2, 1), (3, 1), (None, 1), (4, 3), (4, 4)], "order_id int, product_id int"),
        "products": make([(1, "a"), (2, ""), (3, None), (4, None), (1, "b")], "product_id int, product_category_name string"),
    }


def test_equal_to_the_plain_join(spark, tables):
    plain = spark.sql(
        """SELECT r.review_id, r.review_score, r.review_comment_title, r.review_comment_message, r.review_creation_date, o.order_status,
                  o.order_approved_at, o.order_delivered_carrier_date, o.order_estimated_delivery_date, c.customer_state, p.product_category_name
           FROM {reviews} r JOIN {orders} o ON r.order_id = o.order_id JOIN {customers} c ON c.customer_id = o.customer_id
           JOIN {items} i ON i.order_id = o.order_id JOIN {products} p ON p.product_id = i.product_id""",
        **tables,
    )
    key = lambda r: tuple(map(str, r))
    want = sorted(map(key, reviews.review_clean(plain).collect()))
    by_order = reviews.review_sql_join(tables, by_order=True)
    assert want == sorted(map(key, reviews.review_clean(by_order, reviews.shared_reviews(tables["reviews"])).collect()))
    joined = reviews.review_sql_join(tables)
    assert joined.groupBy().sum("item_rows").first()[0] == plain.count() and want == sorted(map(key, reviews.review_clean(joined).collect()))
    few = tables | {"reviews": tables["reviews"].where("review_id > 3")}
    assert reviews.review_clean(reviews.review_sql_join(few, by_order=True), reviews.shared_reviews(few["reviews"])).count() == 1


def test_distinct_rows_need_no_exchange(spark, tables):
    few = tables | {"reviews": tables["reviews"].where("review_id > 3")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clean = reviews.review_clean(reviews.review_sql_join(few, by_order=True), reviews.shared_reviews(few["reviews"]))
        plan = clean._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # customers and orders, reviews and orders by order, items and products, categories and orders of the items
    assert plan.count("Exchange hashpartitioning") <= 8 and plan.count("hashpartitioning(review_id") == 0


def test_audit_sends_shared_hashes(spark, monkeypatch):
    stored = []
    inner = audit.small_side
    monkeypatch.setattr(audit, "small_side", lambda df, n: stored.append(inner(df, n)) or stored[-1])
    out = audit.audit_tables({"t": spark.createDataFrame([(1,), (1,), (2,)], "a int")}).first()
    assert out["duplicate_rows"] == 1 and [s.count() for s in stored] == [1]


def test_merge_sums_are_stored_once(spark, monkeypatch):
    made = []
    inner = merged.settle
    monkeypatch.setattr(merged, "settle", lambda df: made.append(df.columns) or inner(df))
    make = spark.createDataFrame
    t = {
        "orders": make([(1, 7), (2, None)], "order_id int, customer_id int"), "items": make([(1, 5, 3), (1, None, 3), (9, 5, 3)], "order_id int, product_id int, seller_id int"),
        "payments": make([(1, "a"), (1, "b")], "order_id int, kind string"), "reviews": make([(None, 4)], "order_id int, score int"),
        "products": make([(5, 1), (6, 2)], "product_id int, size int"), "customers": make([(7, "X")], "customer_id int, state string"), "sellers": make([(3, "Y")], "seller_id int, zone string"),
    }
    merge = merged.Merge(t)
    got = {(r["name"], r["value"]): r["n"] for r in merge.value_counts().collect()}
    assert merge.rows() is not None and len(made) == 4  # sizes, and the sums of each dimension
    assert got == {
        ("order_id", "1"): 4, ("order_id", "2"): 1, ("product_id", "5"): 2, ("product_id", "6"): 1, ("seller_id", "3"): 4, ("customer_id", "7"): 4,
        ("kind", "a"): 2, ("kind", "b"): 2, ("score", "4"): 1, ("size", "1"): 2, ("size", "2"): 1, ("state", "X"): 4, ("zone", "Y"): 4,
    }


def test_categories_meet_in_one_shuffle(spark, tables):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reviews.review_sql_join(tables, by_order=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # customers and orders, reviews and orders by order, items and products, categories by order
    assert plan.count("Exchange hashpartitioning") == 7


def test_missing_values_are_dropped_before_the_joins(spark, tables, monkeypatch):
    nan = float("nan")
    rows = spark.createDataFrame([(1, "a", 1.0, 2), (2, None, 1.0, 2), (3, "b", nan, 2), (4, "c", None, 2), (5, "d", 1.0, None)], "i int, s string, x double, n int")
    seen = []
    monkeypatch.setattr(reviews, "small_side", lambda df: seen.append(df) or df)
    assert reviews._complete(rows).collect() == rows.dropna().collect() and reviews._complete(rows).count() == 1
    few = tables | {"reviews": tables["reviews"].where("review_id > 3")}
    reviews.review_delivery(reviews.review_clean(reviews.review_sql_join(few, by_order=True), reviews.shared_reviews(few["reviews"])))
    lines = seen[-1]._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, line in enumerate(lines) if "Join" in line]
    filters = [i for i, line in enumerate(lines) if "Filter" in line and "review_comment_message" in line]
    assert filters and min(filters) > min(joins)
