"""The weighted merge against the merge itself, and the other table statistics on odd rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.functions.quantiles import exact_percentiles
from tidebook.operators import audit, merged, metrics, models, sales
from tidebook.sources.catalog import state_regions


@pytest.fixture(scope="module")
def frames():
    return {
        "orders": pd.DataFrame({"order_id": [1, 2, 3, 4], "customer_id": [10, 11, 10, 99], "order_status": ["a", "b", "a", None]}),
        "items": pd.DataFrame(
            {"order_id": [1, 1, 2, 8, 3], "order_item_id": [1, 2, 1, 1, 1], "product_id": [100, 101, 100, 100, 777], "seller_id": [5, 6, 5, 5, 55], "price": [1.5, 2.0, 7.0, 3.0, None], "freight_value": [1.0, 2.0, 3.0, 4.0, 5.0]}
        ),
        "payments": pd.DataFrame({"order_id": [1, 1, 2, 9], "payment_sequential": [1, 2, 1, 1], "payment_type": ["x", "y", "x", "z"]}),
        "reviews": pd.DataFrame({"order_id": [1, 4, 4, 4, 9], "review_id": [1, 2, 3, 4, 5], "review_score": [5, 4, 4, 1, 1]}),
        "products": pd.DataFrame({"product_id": [100, 101, 102], "product_category_name": ["p", None, "q"]}),
        "customers": pd.DataFrame({"customer_id": [10, 11, 12], "customer_state": ["SP", "AM", "SP"]}),
        "sellers": pd.DataFrame({"seller_id": [5, 6, 7], "seller_state": ["S1", "S2", "S3"]}),
    }


@pytest.fixture(scope="module")
def whole(frames):
    f = frames
    out = f["orders"].merge(f["items"], on="order_id", how="left").merge(f["payments"], on="order_id", how="outer").merge(f["reviews"], on="order_id", how="outer")
    for name, key in (("products", "product_id"), ("customers", "customer_id"), ("sellers", "seller_id")):
        known, lone = out[out[key].notna()], out[out[key].isna()]
        out = pd.concat([known.merge(f[name], on=key, how="outer"), lone], ignore_index=True)
    return out


@pytest.fixture(scope="module")
def merge(spark, frames):
    return merged.Merge({n: spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), ", ".join(f"{c} {'string' if p[c].dtype == object else 'double' if p[c].dtype == float else 'long'}" for c in p)) for n, p in frames.items()})


def test_rows_and_value_counts(merge, whole):
    assert merge.total().agg(F.sum("weight")).first()[0] == len(whole)
    want = {(c, v if isinstance(v, str) else float(v)): n for c in whole for v, n in whole[c].value_counts().items()}
    types = merge.columns()
    got = {(r["name"], r["value"] if types[r["name"]] == "string" else float(r["value"])): r["n"] for r in merge.value_counts().collect()}
    assert got == want


def test_profile_and_kinds(merge, whole):
    rows = {r["name"]: r for r in merged.profile(merge, ["order_id", "order_item_id", "payment_sequential", "review_id"]).collect()}
    assert set(rows) == set(whole.columns)
    for c in whole:
        p = whole[c].value_counts(normalize=True)
        assert (rows[c]["missing"], rows[c]["uniques"]) == (whole[c].isna().sum(), whole[c].nunique())
        assert rows[c]["entropy"] == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-9)
    head = whole.sort_values(["order_id", "order_item_id", "payment_sequential", "review_id"], na_position="last").head(3)
    assert [float(rows["payment_sequential"][f"{w}_value"]) for w in ("first", "second", "third")] == list(head["payment_sequential"])
    kinds = {r["name"]: r["kind"] for r in merged.kinds(merge, ["order_id"], 3).collect()}
    assert kinds["order_id"] == "id" and kinds["order_status"] == "binary" and kinds["payment_type"] == "categorical" and kinds["review_id"] == "numeric"


def test_merged_statistics(spark, merge, whole):
    share = {r["payment_type"]: (r["total"], r["percent"]) for r in sales.merged_payment_share(merge).collect()}
    counts = whole["payment_type"].value_counts()
    assert share == {t: (n, round(100 * n / len(whole) + 1e-9, 2)) for t, n in counts.items()}
    freight = {r["seller_state"]: (r["North"], r["Southeast"]) for r in sales.freight_by_region(merge, state_regions(spark), ["North", "Southeast"]).collect()}
    assert freight == {"S1": (3.0, 1.0), "S2": (None, 2.0)}


def test_audit_compares_rows_where_hashes_meet(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, 1, "a"), (None, 1, "a"), (2, 2, None), (None, None, None), (None, None, None), (None, None, None)]
    out = audit.audit_tables({"t": spark.createDataFrame(rows, "a int, b int, c string")}).first()
    assert (out["rows"], out["duplicate_rows"], out["missing_cells"]) == (8, 4, 14)
    empty = audit.audit_tables({"t": spark.createDataFrame([], "a int")}).first()
    assert (empty["rows"], empty["duplicate_rows"], empty["missing_cells"]) == (0, 0, 0)


@pytest.mark.parametrize("values", [[1000 + i * 1e-7 for i in range(5000)], [5.0] * 40 + [5.0 + 1e-9], [-1e-8 * i for i in range(999)] + [3.0, None], [7.25]])
def test_percentiles_of_values_close_together(spark, values):
    df = spark.createDataFrame([(v, "g") for v in values], "x double, g string").repartition(4)
    qs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    known = [v for v in values if v is not None]
    for by in ([], ["g"]):
        got = {r["q"]: r["value"] for r in exact_percentiles(df, "x", qs, by).collect()}
        assert got == {q: pytest.approx(np.quantile(known, q), rel=1e-15, abs=1e-18) for q in qs}


def test_order_table_adds_up(spark):
    columns = ", ".join(f"{c} {'double' if c in ('price', 'freight_value', 'payment_value', 'review_score', 'delivery_time_days') else 'string' if c in ('year_month', 'product_id') else 'boolean' if c == 'is_delivered' else 'int'}" for c in (*metrics.ORDER_TABLE_COLUMNS, "product_id"))
    names = [c.split()[0] for c in columns.split(", ")]
    base = dict.fromkeys(names) | {"year_month": "2017-01", "is_delivered": True, "week": 1, "payment_value": 9.0}
    items = [
        base | {"order_id": 1, "order_item_id": 1, "price": 2.0, "freight_value": 1.0, "review_score": 4.0, "product_id": "a"},
        base | {"order_id": 1, "order_item_id": 2, "price": None, "freight_value": 3.0, "review_score": 4.0, "product_id": "a"},
        base | {"order_id": 2, "order_item_id": 1, "price": 6.0, "freight_value": None, "review_score": None, "product_id": "b"},
        base | {"order_id": 3, "order_item_id": 1, "price": 50.0, "product_id": "c", "is_delivered": False},
    ]
    enriched = spark.createDataFrame([tuple(i[n] for n in names) for i in items], columns)
    month = metrics.monthly_metrics(metrics.order_table(enriched), metrics.products_by_month(enriched)).first()
    assert (month["orders_count"], month["items_sold"], month["products_sold"], month["revenue"], month["freight_sum"]) == (2, 3, 2, 8.0, 4.0)
    assert (month["avg_item_price"], month["avg_freight_value"], month["avg_review_score"], month["avg_delivery_time_days"]) == (4.0, 2.0, 4.0, None)


def test_fold_fits_equal_single_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.random((200, 2))
    kind = rng.integers(0, 3, 200)
    features = np.hstack([x, np.eye(3)[kind]])
    y = 3 * x[:, 0] - x[:, 1] + kind + rng.normal(0, 0.1, 200)
    weight, fold = rng.integers(1, 4, 200), np.arange(200) * 4 // 200
    rows = [(i, float(y[i]), int(weight[i]), int(fold[i]), [float(v) for v in features[i]]) for i in range(200)]
    matrix = spark.createDataFrame(rows, "order_id long, wait_time double, count long, fold int, features array<double>")
    got = {r["order_id"]: r["prediction"] for r in models.delivery_lr_cv(matrix, 4).collect()}
    for f in range(4):
        used = fold != f
        design = np.hstack([np.ones((200, 1)), features]) * np.sqrt(weight)[:, None]
        beta = np.linalg.lstsq(design[used], (y * np.sqrt(weight))[used], rcond=None)[0]
        want = np.hstack([np.ones((200, 1)), features]) @ beta
        assert [got[i] for i in np.flatnonzero(~used)] == pytest.approx(list(want[~used]), abs=1e-6)
    assert max(r["worst"] for r in models.delivery_lr_normal(matrix, 4).collect()) < 1e-8
    assert models.delivery_lr_cv(matrix.limit(0), 4).count() == 0


def test_clusters_come_to_rest(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(float(v) for v in rng.normal(10 * (i % 6), 1, 6).round(1)) + ("delivered",) for i in range(300)] * 2
    factors = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in models.FACTORS) + ", order_status string")
    clusters = models.order_clusters(factors)
    out = models.misplaced(clusters).first()
    assert (out["rows"], out["clusters"], out["misplaced"]) == (600, 6, 0)
    wrong = clusters.withColumn("cluster", F.when(F.rand(1) < 0.1, (F.col("cluster") + 1) % 6).otherwise(F.col("cluster")))
    assert models.misplaced(wrong).first()["misplaced"] > 0


def test_polynomial_needs_positions(spark):
    items = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 5.0)], "order_item_id int, freight_value double")
    with pytest.raises(ValueError):
        models.freight_poly(items, 6)
    fitted = {r["x"]: r["fitted"] for r in models.freight_poly(items, 1).collect()}
    assert fitted[2.0] == pytest.approx(10 / 3) and math.isclose(fitted[3.0] - fitted[1.0], 3.0, abs_tol=1e-6)
