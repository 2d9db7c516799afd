"""The complete analysis: raw tables in, every intermediate and result table out.

    python -m tidebook.plans.analysis RAW_DIR OUT_DIR [--year 2017]

Stages hand over through written Parquet tables, so a later stage reads only the columns it
needs, prunes to the analysed year, and survives the loss of any executor.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import audit, early, enrich, forecast, granularity, impact, large, metrics, prediction, seasonality
from tidebook.session import build_session
from tidebook.sources.catalog import load_tables, read_result
from tidebook.sources.sinks import write_csv, write_parquet
from tidebook.sources.settle import settle


class Output:
    """Where results go: ``processed`` Parquet tables and ``tables`` CSV results."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.dir = spark, directory.rstrip("/")
        self.tables: list[str] = []

    def stored(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write an intermediate table and continue from what was written."""
        path = f"{self.dir}/processed/{name}"
        write_parquet(df, path, partition_by)
        return read_result(self.spark, path)

    def table(self, name: str, df: DataFrame, bounded: bool = True) -> None:
        """Write a result as CSV; ``bounded`` results (categories, dates) get a single file."""
        write_csv(df, f"{self.dir}/tables/{name}", single_file=bounded)
        self.tables.append(name)


def run_analysis(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    out_dir: str,
    year: int = 2017,
    cutoff: str | None = "2018-08-27",
    window: tuple[str, str] = ("2017-10-15", "2017-12-15"),
    trees: int | None = None,
) -> dict[str, int]:
    """Run all stages; returns row counts of the main tables and the number of results."""
    out = Output(spark, out_dir)
    out.table("data_audit", audit.audit_tables(tables))
    out.table("missing_by_column", audit.missing_by_column(tables))

    enriched = out.stored("orders_items_enriched", enrich.build_enriched(tables), ("year",))
    out.table("coverage_by_year", audit.coverage(tables["orders"]))
    out.table("year_month_matrix", audit.year_month_matrix(tables["orders"]))

    orders = out.stored("orders_enriched_order_level", metrics.order_flags(metrics.order_level(enriched)))
    payments = orders.select("order_id", "payment_value")
    order_rows = settle(metrics.order_table(enriched))
    months = metrics.monthly_metrics(order_rows, metrics.products_by_month(enriched))
    out.table("monthly_metrics", out.stored("monthly_metrics", months).orderBy("year_month"))
    out.stored("weekly_metrics", metrics.weekly_metrics(order_rows))

    daily = out.stored("category_daily_metrics", seasonality.category_daily(enriched))
    monthly = out.stored("category_monthly_metrics", seasonality.category_month(enriched, daily, year))
    out.stored("category_weekly_metrics", seasonality.category_week(enriched))
    spikes = seasonality.event_spikes(daily)
    out.table("event_spikes", spikes.orderBy("category", "order_date"))
    out.table("total_daily_spikes", seasonality.total_spikes(enriched).orderBy("date"))
    out.table("weekday_orders", seasonality.weekday_orders(enriched).orderBy("weekday"))
    ranking = out.stored("category_seasonality_scores", seasonality.category_ranking(daily, year))
    out.table("category_seasonality_ranking", seasonality.ranked(ranking))
    out.table("seasonality_type_composition", seasonality.type_composition(ranking).orderBy("seasonality_type", "confidence_level"))
    clusters = out.stored(
        "seasonality_clusters", prediction.seasonality_clusters(seasonality.seasonal_index_matrix(ranking, monthly, None))
    )
    out.table("seasonality_cluster_profiles", prediction.cluster_profiles(clusters).orderBy("cluster"))

    for grain, name in (("quarter", "quarterly"), ("month", "monthly"), ("week", "weekly"), ("weekday", "weekday")):
        out.table(f"category_{name}_line_metrics", granularity.line_metrics(enriched, ranking, grain, year).orderBy(grain, "category"))
    for period in ("month", "quarter"):
        for n, kind, entity in ((3, "categories", ["category"]), (5, "products", ["product_id", "category"])):
            top = granularity.top_by_period(enriched, period, entity, n, year)
            out.table(f"top{n}_{kind}_by_{period}", top.orderBy(period, "rank"))

    products = seasonality.product_ranking(out.stored("product_monthly_metrics", seasonality.product_month(enriched, year)))
    products = out.stored("product_seasonality_scores", products)
    out.table("product_seasonality_ranking", seasonality.ranked(products, tiebreak=("product_id",)), bounded=False)
    out.table("top20_seasonal_products", seasonality.top_products_seasonal(products))

    out.table("business_impact_peak_vs_normal", impact.business_impact(enriched, ranking, monthly, daily, payments))
    by_month = out.stored("impact_by_month", impact.impact_by_month(enriched, ranking, monthly, daily, year))
    out.table("business_impact_by_category_uplift", impact.category_uplift(by_month).orderBy("category", "metric"))
    out.table("business_revenue_decomposition_peak_vs_normal", impact.revenue_decomposition(by_month).orderBy("period_type"))

    out.table("large_purchase_price_thresholds", large.price_thresholds(enriched, year))
    for grain, keys in large.PERIODS.items():
        out.table(f"large_purchase_revenue_by_{grain}", large.large_by_period(enriched, grain, year).orderBy(*keys))
    out.table("large_purchase_black_friday_window", large.event_window(enriched, *window, year).orderBy("order_date"))
    mix = large.category_mix(enriched, ranking, monthly, year)
    out.table("large_purchase_category_mix_peak_vs_normal", mix.orderBy("period_type", "category"))
    out.table("large_purchase_installments_by_month", large.installments_by_month(enriched, year).orderBy("month"))

    features = out.stored("seasonality_prediction_features", prediction.prediction_features(enriched, ranking, daily))
    results, importance = prediction.predictability(features, **({"trees": trees} if trees else {}))
    out.table("seasonality_prediction_results", results)
    out.table("model_feature_importance", importance.orderBy(F.desc("importance"), "feature"))
    first_half = out.stored("early_seasonality_prediction_features", early.early_features(enriched, daily, ranking, year))
    out.table("early_seasonality_prediction_features", first_half.orderBy("category"))
    out.table("early_warning_scorecard", early.early_warning_scorecard(first_half).orderBy("category"))
    results, importance = prediction.early_predictability(first_half, **({"trees": trees} if trees else {}))
    out.table("early_seasonality_prediction_results", results)
    out.table("early_seasonality_feature_importance", importance.orderBy(F.desc("importance"), "feature"))

    weekly = out.stored("weekly_series", forecast.weekly_series(enriched, cutoff))
    holdout = out.stored("forecast_holdout_predictions", forecast.forecast_holdout(weekly))
    out.table("forecast_holdout_predictions", holdout.orderBy("week_start"))
    out.table("forecast_model_comparison", forecast.forecast_comparison(holdout).orderBy("model"))
    out.table("seasonality_robustness", seasonality.robustness(ranking))

    return {
        "enriched_rows": enriched.count(),
        "category_rankings": ranking.count(),
        "product_rankings": products.count(),
        "tables": len(out.tables),
    }


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run the complete analysis over the raw CSV tables.")
    parser.add_argument("raw_dir")
    parser.add_argument("out_dir")
    parser.add_argument("--year", type=int, default=2017)
    parser.add_argument("--cutoff", default="2018-08-27")
    args = parser.parse_args(argv)
    spark = build_session("tidebook-analysis")
    window = (f"{args.year}-10-15", f"{args.year}-12-15")
    summary = run_analysis(spark, load_tables(spark, args.raw_dir), args.out_dir, args.year, args.cutoff, window)
    print(json.dumps(summary, indent=2))


if __name__ == "__main__":
    main()
