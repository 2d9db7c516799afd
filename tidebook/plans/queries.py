"""Registered queries over the star-schema tables.

Each entry is a callable (spark, directory) -> DataFrame plus a column specification used for
presentation: ``name`` is a double shown with four digits, ``name:2`` with two, ``name:i`` a
whole number. Every query reads only the columns and joins only the tables it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.calendar import with_calendar
from tidebook.functions.scalar import steady, sum0
from tidebook.functions.stats import binary_scores, roc_curve, spearman_importance
from tidebook.operators import audit, early, enrich, forecast, geo, granularity, impact, large, logistics, merged, metrics
from tidebook.operators import models, prediction, reviews, sales, seasonality
from tidebook.operators.enrich import CATEGORY, build_enriched
from tidebook.session import tune
from tidebook.sources.settle import settle
from tidebook.sources.star import YEAR, StarTables

CUTOFF = "2001-07-23"
WINDOW = (f"{YEAR}-10-15", f"{YEAR}-12-15")


class Context:
    """Tables and the intermediate frames the queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.t = StarTables(spark, sf_dir)
        self._settled: dict[str, DataFrame] = {}

    def enriched(self, columns: Iterable[str] | None = None) -> DataFrame:
        return build_enriched(self.t, columns)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A small frame several steps of this query read, computed once."""
        if name not in self._settled:
            self._settled[name] = settle(build())
        return self._settled[name]

    def payments(self) -> DataFrame:
        return metrics.order_payments(self.enriched(metrics.PAYMENT_COLUMNS))

    def orders(self) -> DataFrame:
        return self.once("orders", lambda: metrics.order_table(self.enriched(metrics.ORDER_TABLE_COLUMNS)))

    def daily(self) -> DataFrame:
        return self.once("daily", lambda: seasonality.category_daily(self.enriched(seasonality.DAILY_COLUMNS)))

    def monthly(self) -> DataFrame:
        return seasonality.monthly_profile(self.daily(), YEAR)

    def profile(self) -> DataFrame:
        """The ranking without spikes, weekly pattern and type: enough for scores and tiers."""
        return seasonality.category_profile(self.monthly())

    def ranking(self) -> DataFrame:
        return seasonality.category_ranking(self.daily(), YEAR)

    def impact_months(self) -> DataFrame:
        return impact.impact_by_month(self.enriched(impact.IMPACT_COLUMNS), self.profile(), self.monthly(), self.daily(), YEAR)

    def large(self) -> DataFrame:
        return self.enriched(large.LARGE_COLUMNS)

    def sums(self) -> DataFrame:
        """Sums of all items, of which those of the first half are a part."""
        return self.once("sums", lambda: early.state_sums(self.enriched((*prediction.FEATURE_SOURCE, "year", "month")), YEAR))

    def early(self) -> DataFrame:
        sums = self._settled.get("sums")  # without them, only the first half is read
        build = lambda: early.early_features(self.enriched(early.EARLY_COLUMNS), self.daily(), self.ranking(), YEAR, sums)
        return self.once("early", build)

    def labelled(self) -> DataFrame:
        prices = self.enriched(prediction.PRICE_SOURCE)
        build = lambda: prediction.prediction_features(prices, self.ranking(), self.daily(), self.sums())
        return self.once("labelled", build)

    def holdout(self) -> DataFrame:
        return forecast.forecast_holdout(self.weekly())

    def weekly(self) -> DataFrame:
        return self.once("weekly", lambda: forecast.weekly_series(self.enriched(forecast.FORECAST_COLUMNS), CUTOFF))

    def merge(self) -> merged.Merge:
        return merged.Merge(self.t)

    def points(self) -> DataFrame:
        return geo.geo_points(self.t["geolocation"])

    def zip3(self) -> DataFrame:
        return geo.zip3_metrics(geo.order_places(self.t))

    def delivery(self) -> DataFrame:
        return logistics.delivery_data(self.t)

    def review_rows(self) -> DataFrame:
        joined = reviews.review_sql_join(self.t, by_order=True)
        return reviews.review_clean(joined, reviews.shared_reviews(self.t["reviews"]))

    def hours(self) -> DataFrame:
        return sales.order_hours(self.t["orders"], self.t["items"])


@dataclass(frozen=True)
class Query:
    build: Callable[[Context], DataFrame]
    columns: str = ""

    def spec(self) -> dict[str, str]:
        return {c.partition(":")[0]: c.partition(":")[2] or "4" for c in self.columns.split()}

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(self.build(Context(spark, sf_dir)), self.spec())


def present(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Round and cast the specified columns; other columns pass unchanged."""
    out = []
    for name in df.columns:
        kind = spec.get(name)
        quoted = F.col(f"`{name}`")
        if kind is None:
            out.append(quoted)
        elif kind == "i":
            out.append(quoted.cast("long").alias(name))
        else:
            out.append(steady(quoted.cast("double"), int(kind)).alias(name))
    return df.select(*out)


QUERIES: dict[str, Query] = {}


def query(columns: str = "", name: str | None = None):
    def register(build: Callable[[Context], DataFrame]):
        QUERIES[name or build.__name__] = Query(build, columns)
        return build

    return register


# --- sources, audit, profiles --------------------------------------------------------------

@query("rows:i")
def load_counts(c):
    counts = [c.t[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n in c.t.keys()]
    return audit._union(counts)


@query("rows:i columns:i duplicate_rows:i missing_cells:i")
def table_audit(c):
    return audit.audit_tables(c.t.items_of())


@query("missing:i")
def missing_by_column(c):
    return audit.missing_by_column(c.t.items_of())


@query("year:i orders:i span_days:i active_days:i calendar_days:i missing_before:i missing_after:i")
def coverage_by_year(c):
    return audit.coverage(c.t["orders"])


_MONTHS = [f"m{m:02d}" for m in range(1, 13)]


@query("year:i " + " ".join(f"{m}:i" for m in _MONTHS))
def year_month_matrix(c):
    return audit.year_month_matrix(c.t["orders"])


# The id columns of the merged tables.
_IDS = ("order_id", "seller_id", "customer_id", "order_item_id", "product_id", "review_id", "customer_unique_id", "seller_zip_code_prefix")


@query("missing:i uniques:i entropy")
def column_profile(c):
    return merged.profile(c.merge())


@query("uniques:i")
def column_kinds(c):
    return merged.kinds(c.merge(), _IDS)


@query("value")
def zip_count_describe(c):
    return audit.count_describe(c.t["geolocation"], "geolocation_zip_code_prefix")


@query("value")
def zip_describe(c):
    return audit.describe(c.points(), "geolocation_zip_code_prefix_int")


@query("orders_count:i customers_count:i")
def status_counts(c):
    return audit.status_counts(c.t["orders"])


@query("min_value:2 max_value:2 avg_value:2 median_value:2")
def order_value_summary(c):
    return audit.value_summary(c.t["items"], "price")


@query("skewness excess_kurtosis")
def log_value_moments(c):
    return audit.log_value_moments(c.t["items"], ["price", "freight_value"])


@query("price:2 outlier_bound:2 order_id:i order_item_id:i")
def price_outliers(c):
    rows = audit.outliers(c.t["items"], "price", 1.6)
    return rows.select("order_id", "order_item_id", "price", "outlier_bound")


# --- enrichment and scalar features --------------------------------------------------------

_CALENDAR_INTS = "year:i quarter:i month:i weekday:i"


@query(
    "order_id:i order_item_id:i product_id:i seller_id:i price:2 freight_value:2 customer_id:i product_name_lenght:i "
    "product_description_lenght:i product_photos_qty:i product_weight_g:i product_length_cm:i product_height_cm:i "
    "product_width_cm:i payment_value:2 payment_installments:i payment_methods_count:i payment_rows:i review_score "
    f"review_count:i {_CALENDAR_INTS} product_volume_cm3:i delivery_time_days estimated_delivery_delta_days freight_share"
)
def enriched_items(c):
    return c.enriched()


@query(f"order_id:i {_CALENDAR_INTS} monthday:i hour:i")
def calendar_features(c):
    return sales.calendar_rows(c.t["orders"])


@query("order_id:i payment_value:2 payment_installments:i payment_methods_count:i payment_rows:i")
def payments_per_order(c):
    return enrich.payments_per_order(c.t["payments"])


@query("order_id:i review_score review_count:i")
def reviews_per_order(c):
    return enrich.reviews_per_order(c.t["reviews"])


_LEADS = (
    "est_lead_days act_lead_days approval_mins purchase_to_carrier_days carrier_to_customer_days processing_minutes "
    "processing_hours approved_to_carrier_days carrier_to_customer_dates customer_vs_estimate_days approved_to_customer_days"
).split()


@query("order_id:i " + " ".join(f"{n}:i" for n in _LEADS))
def lead_times(c):
    return logistics.lead_times(c.t["orders"]).select("order_id", *_LEADS)


@query("order_id:i order_item_id:i order_price:2 order_freight:2 total_order_cost:2 freight_over_price:i")
def order_cost_flags(c):
    return logistics.order_cost_flags(c.t["items"]).select(
        "order_id", "order_item_id", "order_price", "order_freight", "total_order_cost", "freight_over_price"
    )


# --- metrics -------------------------------------------------------------------------------

@query(
    "order_id:i year:i month:i weekday:i payment_value:2 payment_installments:i delivery_time_days "
    "estimated_delivery_delta_days review_score revenue:2 freight_sum:2 items_sold:i categories_count:i gmv:2"
)
def order_level(c):
    return metrics.order_level(c.enriched(metrics.ORDER_LEVEL_COLUMNS))


@query("order_id:i payment_value:2")
def order_flags(c):
    return metrics.order_flags(metrics.order_level(c.enriched(metrics.ORDER_LEVEL_COLUMNS)), c.payments()).select(
        "order_id", "payment_value", "large_purchase_p90", "large_purchase_p75"
    )


@query(
    "orders_count:i payment_value_sum:2 avg_order_value:2 large_purchase_share avg_payment_installments "
    "share_installments_6_plus items_sold:i products_sold:i revenue:2 freight_sum:2 avg_item_price:2 avg_freight_value "
    "avg_review_score avg_delivery_time_days gmv:2 year:i month:i"
)
def monthly_metrics(c):
    return metrics.monthly_metrics(c.orders(), metrics.products_by_month(c.enriched(metrics.SOLD_COLUMNS)))


@query("orders_count:i revenue:2 avg_order_value:2 large_purchase_share")
def weekly_metrics(c):
    return metrics.weekly_metrics(c.orders())


# --- seasonality ---------------------------------------------------------------------------

@query(
    "month:i orders_count:i items_sold:i revenue:2 avg_item_price:2 avg_freight_value avg_payment_installments "
    "avg_review_score avg_delivery_time_days customer_state_nunique:i seller_state_nunique:i seasonal_index"
)
def category_month(c):
    return seasonality.category_month(c.enriched(seasonality.MONTH_COLUMNS), c.daily(), YEAR)


@query("orders_count:i revenue:2 items_sold:i")
def category_week(c):
    return seasonality.category_week(c.enriched([CATEGORY, "week", "is_delivered", "order_id", "order_item_id", "price"]))


@query("orders_count:i items_sold:i revenue:2")
def category_daily(c):
    return seasonality.category_daily(c.enriched(seasonality.DAILY_COLUMNS))


@query("orders_count:i rolling_mean_30 rolling_std_30 z_score")
def event_spikes(c):
    return seasonality.event_spikes(c.daily())


@query("orders_count:i rolling_mean_30 rolling_std_30 z_score")
def total_spikes(c):
    return seasonality.total_spikes(c.enriched(["order_id", "order_date", "is_delivered"]))


@query("weekday:i orders_count:i revenue:2")
def weekday_orders(c):
    return seasonality.weekday_orders(c.enriched(["order_id", "weekday", "price", "is_delivered"]))


@query("trend_strength")
def trend_strength(c):
    return seasonality.trend_strength(c.monthly())


@query("weekly_pattern_strength")
def weekly_strength(c):
    return seasonality.weekly_strength(c.daily())


_RANKING = (
    "total_orders:i total_revenue:2 active_months:i monthly_mean monthly_std cv peak_to_mean peak_to_min peak_month_share "
    "peak_quarter_share seasonal_index_max peak_month:i peak_quarter:i event_spike_count:i max_spike_z_score "
    "weekly_pattern_strength trend_strength seasonality_score"
)


@query(_RANKING)
def category_ranking(c):
    return seasonality.ranked(c.ranking())


@query(_RANKING)
def top_seasonal(c):
    return seasonality.top_seasonal(c.ranking(), 15)


@query(_RANKING)
def most_stable(c):
    return seasonality.most_stable(c.ranking(), 10)


@query("categories_count:i")
def type_composition(c):
    return seasonality.type_composition(c.ranking())


@query("n_categories:i")
def robustness(c):
    return seasonality.robustness(c.profile())


@query(" ".join(_MONTHS))
def seasonal_index_matrix(c):
    return seasonality.seasonal_index_matrix(c.profile(), c.monthly(), 20)


_PRODUCT = (
    "product_id:i total_orders:i total_revenue:2 active_months:i seasonality_score peak_to_mean peak_month:i "
    "peak_quarter:i peak_quarter_share"
)


@query("product_id:i month:i orders_count:i revenue:2 items_sold:i")
def product_month(c):
    return seasonality.product_month(c.enriched(seasonality.PRODUCT_COLUMNS), YEAR)


@query(_PRODUCT)
def product_ranking(c):
    return seasonality.product_ranking(seasonality.product_month(c.enriched(seasonality.PRODUCT_COLUMNS), YEAR))


@query(_PRODUCT)
def top_products_seasonal(c):
    ranked = seasonality.product_ranking(seasonality.product_month(c.enriched(seasonality.PRODUCT_COLUMNS), YEAR))
    return seasonality.top_products_seasonal(ranked, 20)


# --- granularity ---------------------------------------------------------------------------

def _line(grain):
    def build(c):
        columns = (CATEGORY, "year", "is_delivered", grain, "order_id", "order_item_id", "price")
        return granularity.line_metrics(c.enriched(columns), c.profile(), grain, YEAR)

    return build


def _top(period, entity, n):
    def build(c):
        columns = (CATEGORY, "year", "is_delivered", period, "order_id", "order_item_id", "price", "product_id")
        return granularity.top_by_period(c.enriched(columns), period, entity, n, YEAR)

    return build


for _grain in granularity.GRAINS:
    _key = "" if _grain == "week" else f"{_grain}:i "
    query(_key + "orders_count:i items_sold:i revenue:2", f"line_{_grain}")(_line(_grain))
for _period in ("month", "quarter"):
    _vols = f"{_period}:i orders_count:i items_sold:i revenue:2 rank:i"
    query(_vols, f"top_categories_{_period}")(_top(_period, ["category"], 3))
    query("product_id:i " + _vols, f"top_products_{_period}")(_top(_period, ["product_id", "category"], 5))


# --- peak against normal -------------------------------------------------------------------

@query("month:i")
def peak_keys(c):
    return impact.peak_keys(c.profile(), c.monthly())


@query("items_sold:i revenue:2")
def seasonal_items(c):
    rows = impact.seasonal_items(c.enriched([CATEGORY, "is_delivered", "year", "order_item_id", "price"]), c.profile())
    return rows.groupBy("category").agg(F.count("order_item_id").alias("items_sold"), sum0("price").alias("revenue"))


@query("items_sold:i revenue:2 months:i")
def peak_flagged_items(c):
    columns = (CATEGORY, "month", "is_delivered", "order_id", "order_item_id", "price", "year")
    return impact.peak_flagged_counts(c.enriched(columns), c.profile(), c.monthly())


@query("normal_months:2 peak_months:2 delta_abs:2 delta_pct")
def business_impact(c):
    return impact.business_impact(c.enriched(impact.IMPACT_COLUMNS), c.profile(), c.monthly(), c.daily(), c.payments())


@query("normal_months:2 peak_months:2 delta_abs:2 delta_pct")
def category_uplift(c):
    return impact.category_uplift(c.impact_months())


@query("orders_count items_per_order avg_item_price:2 revenue:2")
def revenue_decomposition(c):
    return impact.revenue_decomposition(c.impact_months())


@query("value:2")
def decomposition_long(c):
    return impact.decomposition_long(impact.revenue_decomposition(c.impact_months()))


# --- expensive goods -----------------------------------------------------------------------

@query("price_quantile min_item_price:2 items_count:i items_share revenue:2 revenue_share")
def price_thresholds(c):
    return large.price_thresholds(c.large(), YEAR)


_LARGE = "orders_count:i items_count:i total_revenue:2 avg_item_price:2 median_item_price:2 " + " ".join(
    f"large_items_count_{t}:i large_revenue_{t}:2 large_items_share_{t} large_revenue_share_of_period_{t} large_revenue_distribution_{t}"
    for t in large.THRESHOLDS
)


def _large_by(grain):
    return lambda c: large.large_by_period(c.large(), grain, YEAR)


for _grain, _keys in large.PERIODS.items():
    query(("" if _grain == "week" else f"{_keys[0]}:i ") + _LARGE, f"large_by_{_grain}")(_large_by(_grain))


@query("weekday:i revenue_distribution")
def weekday_distribution(c):
    return large.weekday_distribution(large.large_by_period(c.large(), "weekday", YEAR))


@query("month:i " + _LARGE)
def top_large_months(c):
    return large.top_large_months(large.large_by_period(c.large(), "month", YEAR))


@query("all_revenue:2 top10_revenue:2 top20_revenue:2")
def bf_window(c):
    return large.event_window(c.large(), *WINDOW, YEAR)


@query("revenue:2")
def bf_window_long(c):
    return large.event_window_long(large.event_window(c.large(), *WINDOW, YEAR))


@query("top10_expensive_revenue:2 top10_expensive_items:i period_revenue_share")
def large_category_mix(c):
    return large.category_mix(c.large(), c.profile(), c.monthly(), YEAR)


@query("top10_expensive_revenue:2")
def top_mix_categories(c):
    return large.top_mix_categories(large.category_mix(c.large(), c.profile(), c.monthly(), YEAR))


_INST = "month:i all_avg_installments all_share_installments_6_plus top10_avg_installments top10_share_installments_6_plus"


@query(_INST)
def installments_by_month(c):
    return large.installments_by_month(c.large(), YEAR)


@query("month:i value")
def installments_long(c):
    return large.installments_long(large.installments_by_month(c.large(), YEAR))


# --- early signals, prediction, forecast ---------------------------------------------------

_EARLY = (
    "h1_orders:i h1_revenue:2 h1_avg_item_price:2 h1_avg_payment_installments h1_share_installments_6_plus h1_freight_share "
    "h1_avg_review_score h1_customer_state_nunique:i h1_seller_state_nunique:i h1_growth_jan_to_jun h1_weekday_concentration "
    "h2_seasonality_score h2_orders:i seasonality_score is_h2_seasonal:i"
)


@query(_EARLY)
def early_features(c):
    return c.early()


@query(_EARLY + " " + " ".join(f"{f}_rank" for f in early.SCORE_FEATURES) + " early_warning_score")
def early_warning_scorecard(c):
    return early.early_warning_scorecard(c.early())


@query(
    "avg_price:2 median_price:2 avg_freight_value freight_share avg_payment_installments share_installments_6_plus "
    "avg_review_score share_low_reviews avg_delivery_time_days avg_product_weight_g:2 avg_product_volume_cm3:2 "
    "avg_product_photos_qty avg_product_name_length avg_product_description_length customer_state_nunique:i "
    "seller_state_nunique:i total_orders:i total_revenue:2 seasonality_score is_seasonal:i"
)
def prediction_features(c):
    return c.labelled()


@query("n_train:i n_test:i")
def strat_split(c):
    labelled = seasonality.eligible(c.profile()).withColumn(
        "is_seasonal", (F.col("seasonality_score") >= impact.seasonal_threshold(c.profile())).cast("int")
    )
    parts = prediction.stratified_split(labelled, "is_seasonal", "category")
    return parts.groupBy(F.when(F.col("is_seasonal") == 1, "seasonal").otherwise("other").alias("label")).agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test")
    )


@query("importance")
def spearman_importance_query(c):
    return spearman_importance(early.early_eligible(c.early()), early.FEATURES, "h2_seasonality_score")


QUERIES["spearman_importance"] = QUERIES.pop("spearman_importance_query")


@query("roc_auc f1 accuracy")
def auc_rank_sum(c):
    scored = early.early_warning_scorecard(c.early())
    return binary_scores(scored, "is_h2_seasonal", "early_warning_score")


@query("threshold fpr tpr", "roc_curve")
def roc_points(c):
    scored = early.early_warning_scorecard(c.early())
    return roc_curve(scored, "is_h2_seasonal", "early_warning_score")


@query("roc_auc f1 accuracy n_train:i n_test:i target_threshold")
def predictability(c):
    first, _ = prediction.predictability(c.labelled())
    second, _ = prediction.early_predictability(c.early())
    return first.unionByName(second)


@query("importance")
def feature_importance(c):
    _, first = prediction.predictability(c.labelled())
    _, second = prediction.early_predictability(c.early())
    tagged = lambda df, m: df.withColumn("model", F.lit(m))
    return tagged(first, "seasonality").unionByName(tagged(second, "h1_to_h2"))


def _clusters(c) -> DataFrame:
    return prediction.seasonality_clusters(seasonality.seasonal_index_matrix(c.profile(), c.monthly(), None))


@query("cluster:i " + " ".join(_MONTHS))
def seasonality_clusters(c):
    return _clusters(c)


@query("rows:i clusters:i misplaced:i")
def seasonality_clusters_check(c):
    return models.misplaced(_clusters(c), _MONTHS)


@query("cluster:i " + " ".join(_MONTHS))
def cluster_profiles(c):
    return prediction.cluster_profiles(_clusters(c))


@query("y")
def weekly_series(c):
    return c.weekly()


@query("actual last_4_week_mean seasonal_naive_or_8w_mean")
def forecast_holdout(c):
    return c.holdout()


@query("mae mape")
def forecast_comparison(c):
    return forecast.forecast_comparison(c.holdout())


# --- geography -----------------------------------------------------------------------------

_LEVELS = " ".join(f"geolocation_zip_code_prefix_{n}_digits:i" for n in (1, 2, 3, 4)) + " geolocation_zip_code_prefix_int:i"


@query(_LEVELS + " rows:i")
def zip_prefix_levels(c):
    levels = geo.zip_prefix_levels(c.t["geolocation"])
    keys = [col for col in levels.columns if col.startswith("geolocation_zip_code_prefix")]
    return levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


@query("geolocation_lat geolocation_lng")
def geo_clip(c):
    return geo.geo_clip(c.t["geolocation"])


@query("x:2 y:2 geolocation_lat geolocation_lng")
def geo_mercator(c):
    return c.points().select("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "x", "y")


@query("cell_x:i cell_y:i points:i mean_value min_value:i")
def geo_grid(c):
    return geo.geo_grid(c.points(), 50_000, "geolocation_zip_code_prefix_int")


@query("x:2 y:2")
def geo_trim(c):
    trimmed = geo.geo_trim(c.points(), "geolocation_state")
    return trimmed.select("geolocation_state", "geolocation_zip_code_prefix", "x", "y")


@query("geolocation_lat geolocation_lng")
def geo_first(c):
    return logistics.geo_first(c.t["geolocation"])


@query("revenue:2 geolocation_lat geolocation_lng")
def zip3_revenue(c):
    joined = geo.points_with_metric(c.points(), c.zip3(), ["revenue"]).withColumn("revenue", F.col("revenue") / 1000)
    return joined.select("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "revenue")


def _zip3(column):
    return lambda c: c.zip3().select("zip3", column)


for _name, _column, _digits in (
    ("zip3_ticket", "avg_ticket", ":2"), ("zip3_freight_ratio", "freight_ratio", ""), ("zip3_delivery", "avg_delivery_time", ""),
    ("zip3_review", "avg_score", ""), ("delay_rate_by_zip3", "delayed", ""), ("zip3_items", "avg_qty", ""),
):
    query(f"zip3:i {_column}{_digits}", _name)(_zip3(_column))


# --- logistics -----------------------------------------------------------------------------

@query("order_id:i distance:2 product_size_cm3:i product_weight_g:i wait_time:i count:i")
def seller_customer_distance(c):
    return c.delivery().select(
        "order_id", "geolocation_state_customer", "geolocation_state_seller", "distance", "product_size_cm3",
        "product_weight_g", "wait_time", "count",
    )


@query("order_id:i seller_id:i items_count:i")
def mono_seller_orders(c):
    return logistics.mono_seller_orders(c.t["items"])


@query("order_id:i product_size_cm3:i product_weight_g:i")
def order_package(c):
    return logistics.order_package(c.t["items"], c.t["products"])


@query("count:i dow:i mean_wait_time")
def daily_resample(c):
    return logistics.daily_resample(c.delivery())


@query("directed_error rows:i")
def directed_error(c):
    return logistics.directed_error(c.delivery())


@query("geolocation_lat_seller geolocation_lng_seller count:i")
def seller_heat(c):
    return logistics.seller_heat(c.delivery())


@query("day_to_delivery:i freq:i")
def delivery_hist(c):
    return logistics.delivery_hist(c.t["orders"], c.t["items"])


_FLOW = ("order_status", "customer_state", "seller_state", "customer_zip_code_prefix", "seller_zip_code_prefix")


@query("items_count:i same_zip_count:i")
def state_flow(c):
    return logistics.state_flow(c.enriched(_FLOW))


@query("items_count:i same_zip_share")
def same_zip_share(c):
    return logistics.same_zip_share(c.enriched(_FLOW))


@query(" ".join(f"avg_{n}" for n in logistics.LEAD_TIMES))
def lead_time_by_quarter(c):
    return logistics.lead_time_by_quarter(c.t["orders"])


# --- reviews -------------------------------------------------------------------------------

@query("review_score:i rows:i")
def review_sql_join(c):
    joined = reviews.review_sql_join(c.t)
    return joined.groupBy("order_status", "customer_state", "review_score").agg(F.sum("item_rows").alias("rows"))


@query("review_id:i score:i")
def review_clean(c):
    return c.review_rows()


@query("review_id:i score:i days_raw days_to_delivery")
def review_delivery_imputed(c):
    return reviews.review_delivery(c.review_rows()).select(
        "review_id", "product_category", "customer_state", "score", "order_approved", "days_raw", "days_to_delivery"
    )


@query("score:i reviews_count:i")
def slow_scores(c):
    return reviews.slow_scores(reviews.review_delivery(c.review_rows()), 3)


@query("score:i min_value q1 median q3 max_value")
def box_stats_score(c):
    return sales.box_stats(reviews.review_delivery(c.review_rows()), "days_to_delivery", "score")


@query("total:i percent:2")
def top_category_share(c):
    return reviews.top_category_share(c.review_rows())


@query("score:i total:i percent:2 place:i")
def category_share_by_score(c):
    return reviews.category_share_by_score(c.review_rows())


@query("total:i percent:2")
def state_share(c):
    return reviews.share_of_total(c.review_rows(), "customer_state", "score")


@query("count:i mean")
def category_review_score(c):
    return sales.category_review_score(c.enriched([CATEGORY, "review_score"]))


# --- sales ---------------------------------------------------------------------------------

@query("rows:i", "full_outer_base")
def merged_rows(c):
    return sales.merged_rows(c.merge())


@query("total:i percent:2")
def merged_payment_share(c):
    return sales.merged_payment_share(c.merge())


@query("payments:i avg_payment_value_log_1p5 avg_payment_value_log_p1 avg_payment_value_log_then_1")
def payment_logs(c):
    return sales.payment_logs(c.t["payments"])


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query(" ".join(r.lower().replace(" ", "_") for r in _REGIONS))
def freight_by_region(c):
    wide = sales.freight_by_region(c.merge(), c.t["regions"], _REGIONS)
    return wide.select("seller_state", *[F.col(f"`{n}`").alias(n.lower().replace(" ", "_")) for n in wide.columns[1:]])


@query("order_item_id:i " + " ".join(f"score_{s}:2" for s in range(1, 6)))
def items_score_crosstab(c):
    return sales.items_score_crosstab(c.merge())


@query("total:i percent:2")
def payment_share(c):
    return reviews.share_of_total(c.t["payments"], "payment_type", "order_id")


@query("qty:i percent_qty review_score:i")
def class_share(c):
    frame = c.enriched(["product_category_name", "order_id"]).where("product_category_name IS NOT NULL")
    counted = frame.groupBy("order_id", "product_category_name").agg(F.count(F.lit(1)).alias("_n"))
    scores = c.t["reviews"].where("review_score IS NOT NULL").select("order_id", "review_score")
    return sales.class_share(counted.join(scores, "order_id"), "product_category_name", "review_score")


@query("total:i percent:2")
def item_count_buckets(c):
    return sales.item_count_buckets(c.merge())


@query("year:i min_value:2 q1:2 median:2 q3:2 max_value:2")
def box_stats(c):
    return sales.box_stats(c.enriched(["year", "price"]), "price", "year")


@query("min_value q1 median q3 max_value")
def box_stats_state(c):
    logged = c.enriched(["customer_state", "price"]).withColumn("price_log", F.log(F.col("price") + 1.5))
    return sales.box_stats(logged, "price_log", "customer_state")


@query("avg_value:2 p01:2 p25:2 p50:2 p75:2 p99:2")
def payment_quantiles(c):
    return sales.payment_quantiles(c.t["payments"])


@query("products_value:2")
def sales_by_day(c):
    return sales.sales_by_day(c.enriched(["order_date", "price"]))


@query("products_value:2 avg_review_score")
def score_by_week(c):
    return sales.sales_by_week(c.enriched(["week", "price", "review_score"]))


def _trend(grain):
    return lambda c: sales.trend(c.hours(), grain)


for _grain in ("year", "month", "weekday", "hour"):
    query(f"{_grain}:i total_value:2 mean_transaction:2 order_count:i", f"trend_{_grain}")(_trend(_grain))


@query("mean_transaction:2 order_count:i weekday:i")
def weekday_value_vs_freq(c):
    return sales.trend(c.hours(), "weekday").select("weekday", "weekday_name", "mean_transaction", "order_count")


@query("position:i " + " ".join(f"h{h:02d}:i" for h in range(24)))
def weekday_hour(c):
    return sales.weekday_hour(c.hours())


@query("year:i month:i customers_count:i categories_count:i sellers_count:i")
def actives_by_month(c):
    return sales.actives_by_month(c.t)


@query("year:i month:i n:i")
def category_volume_bands(c):
    return sales.category_volume_bands(c.t)


@query("avg_trans:2")
def value_by_state(c):
    return sales.value_by_place(c.enriched(["customer_state", "price"]), "customer_state")


@query("avg_trans:2")
def value_by_city(c):
    return sales.value_by_place(c.enriched(["customer_city", "price"]), "customer_city", 10)


@query("order_id:i products_value:2 freight_value:2 items_qty:i")
def top_orders(c):
    return sales.top_orders(c.t["items"])


@query("items_qty:i orders_count:i")
def items_per_order_hist(c):
    return sales.items_per_order_hist(c.t["items"])


@query("order_count:i")
def category_orders(c):
    return sales.category_orders(c.enriched([CATEGORY, "order_id"]))


@query("seller_id:i items_count:i product_count:i")
def seller_portfolio(c):
    lines = c.enriched(["order_id", "product_id", CATEGORY]).groupBy("order_id", "product_id", CATEGORY).agg(F.count(F.lit(1)).alias("_n"))
    sold = c.t["items"].groupBy("order_id", "product_id", "seller_id").agg(F.count(F.lit(1)).alias("_m"))
    joined = sales.attach_sellers(lines, sold)
    out = sales.seller_portfolio(joined).drop("items_count")
    volume = joined.groupBy("seller_id").agg(F.sum("_m").alias("items_count"))
    return out.join(volume, "seller_id").withColumn("products", F.concat_ws("; ", "products"))


@query("seller_id:i items_count:i")
def top_sellers(c):
    return sales.top_sellers(c.t["items"])


@query("total_sales:2 items_sold:i orders_count:i products_count:i avg_rating")
def filtered_kpis(c):
    columns = [CATEGORY, "order_status", "customer_state", "seller_id", "payment_type", "year", "month", "price", "order_id", "product_id", "review_score"]
    chosen = sales.slice_items(c.enriched(columns), status="delivered", payment_type=["credit_card", "boleto"], year=YEAR)
    return sales.sales_cards(chosen)


@query("value:2")
def dashboard_kpis(c):
    return sales.dashboard_kpis(c.t)


@query("review_score:i orders_count:i")
def review_score_distribution(c):
    return sales.review_score_distribution(c.t)


@query("avg_order_price:2 avg_delivery_days")
def price_vs_delivery(c):
    return sales.price_vs_delivery(c.t)


# --- order-grain models --------------------------------------------------------------------

def _matrix(c) -> DataFrame:
    return models.delivery_matrix(c.delivery(), bucket=F.col("order_id") % models.POSITION_BUCKETS)


@query("rows:i directed_error")
def delivery_lr_cv(c):
    return models.cv_report(models.delivery_lr_cv(_matrix(c)), "linear_regression")


@query("fold:i rows:i worst")
def delivery_lr_normal(c):
    return models.delivery_lr_normal(_matrix(c))


def _knn(c) -> DataFrame:
    return models.delivery_knn(c.delivery(), bucket=F.col("order_id") % models.POSITION_BUCKETS)


@query("order_id:i fold:i count:i wait_time:i prediction")
def delivery_knn(c):
    return _knn(c)


@query("rows:i directed_error")
def delivery_knn_error(c):
    return models.cv_report(_knn(c), "nearest_3")


@query("cluster:i rows:i " + " ".join(f"avg_{f}" for f in models.FACTORS))
def order_clusters(c):
    return models.cluster_summary(models.order_clusters(models.operational_factors(c.t)))


@query("rows:i clusters:i misplaced:i")
def order_clusters_check(c):
    return models.misplaced(models.order_clusters(models.operational_factors(c.t)))


@query("cluster:i " + " ".join(models.FACTORS))
def cluster_quarter_medians(c):
    return models.cluster_quarter_medians(models.order_clusters(models.operational_factors(c.t)))


@query(" ".join(models.FACTORS))
def status_quarter_medians(c):
    return models.group_medians(models.operational_factors(c.t), ["order_status", "year_quarter"])


@query("intercept slope dispersion rows:i")
def freight_glm(c):
    return models.freight_glm(c.t["items"])


@query("x:i n:i mean fitted")
def freight_poly(c):
    return models.freight_poly(c.t["items"])


@query("x:i n:i mean fitted")
def freight_parabola(c):
    return models.freight_poly(c.t["items"], 2)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}
