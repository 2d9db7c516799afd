"""Registered queries against independent SQL.

By default a representative set runs at the middle scale; ``TIDEBOOK_ALL=1`` runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences

DIR = os.environ.get("TIDEBOOK_SF_DIR", "/root/testdata/sf0.01")
CORE = (
    "table_audit coverage_by_year zip_count_describe payments_per_order order_flags monthly_metrics category_month event_spikes "
    "category_ranking robustness product_ranking line_week top_products_month peak_keys business_impact category_uplift "
    "large_by_week bf_window large_category_mix early_warning_scorecard spearman_importance forecast_holdout geo_trim zip3_revenue "
    "seller_customer_distance daily_resample review_delivery_imputed category_share_by_score full_outer_base freight_by_region "
    "items_score_crosstab freight_glm column_profile column_kinds merged_payment_share payment_quantiles delivery_knn order_clusters_check"
).split()
SQL = entry.oracle_sql()
QUERIES = entry.queries()
NAMES = [n for n in QUERIES if n in SQL] if os.environ.get("TIDEBOOK_ALL") else CORE

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    return connect(DIR)


@pytest.mark.parametrize("name", NAMES)
def test_same_result(spark, duck, name):
    assert differences(QUERIES[name](spark, DIR), duck, SQL[name]) == []


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
