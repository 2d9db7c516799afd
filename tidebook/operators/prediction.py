"""Category features, seasonality labels, clusters and the random-forest predictors.

All frames here have one row per category; only the feature aggregation reads item rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidebook.functions.quantiles import percentile_columns
from tidebook.functions.scalar import sum0
from tidebook.functions.stats import binary_scores, spearman_importance
from tidebook.operators.early import FEATURES as H1_FEATURES
from tidebook.operators.early import early_eligible, mean_of, share_of_items, state_sums
from tidebook.operators.enrich import CATEGORY, delivered
from tidebook.operators.impact import seasonal_threshold
from tidebook.operators.seasonality import distinct_states, eligible
from tidebook.sources.settle import settle

FEATURE_SOURCE = (
    CATEGORY, "is_delivered", "order_id", "price", "freight_value", "freight_share", "payment_installments",
    "review_score", "is_low_review", "delivery_time_days", "product_weight_g", "product_volume_cm3",
    "product_photos_qty", "product_name_lenght", "product_description_lenght", "customer_state", "seller_state",
)
# The states only keep the joins of customers and sellers, in which an item with a repeated key counts repeatedly.
PRICE_SOURCE = (CATEGORY, "is_delivered", "price", "customer_state", "seller_state")
FEATURES = (
    "avg_price", "median_price", "avg_freight_value", "freight_share", "avg_payment_installments",
    "share_installments_6_plus", "avg_review_score", "share_low_reviews", "avg_delivery_time_days",
    "avg_product_weight_g", "avg_product_volume_cm3", "avg_product_photos_qty", "avg_product_name_length",
    "avg_product_description_length", "customer_state_nunique", "seller_state_nunique", "total_orders", "total_revenue",
)
SEED = 42


def category_features(enriched: DataFrame, daily: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Eighteen aggregates per category over all delivered items; distinct orders from the daily table.

    With the ``sums`` of the same items given, only the prices of ``enriched`` are read, for their median.
    """
    sums = state_sums(enriched) if sums is None else sums
    measured = sums.where(F.col("category").isNotNull()).groupBy("category").agg(
        mean_of("price").alias("avg_price"),
        mean_of("freight_value").alias("avg_freight_value"),
        mean_of("freight_share").alias("freight_share"),
        mean_of("payment_installments").alias("avg_payment_installments"),
        share_of_items("installments_6_plus").alias("share_installments_6_plus"),
        mean_of("review_score").alias("avg_review_score"),
        share_of_items("low_reviews").alias("share_low_reviews"),
        mean_of("delivery_time_days").alias("avg_delivery_time_days"),
        mean_of("product_weight_g").alias("avg_product_weight_g"),
        mean_of("product_volume_cm3").alias("avg_product_volume_cm3"),
        mean_of("product_photos_qty").alias("avg_product_photos_qty"),
        mean_of("product_name_lenght").alias("avg_product_name_length"),
        mean_of("product_description_lenght").alias("avg_product_description_length"),
        distinct_states("customer_state").alias("customer_state_nunique"),
        distinct_states("seller_state").alias("seller_state_nunique"),
        sum0("sum_price").alias("total_revenue"),
    )
    items = delivered(enriched).where(F.col(CATEGORY).isNotNull()).withColumn("category", F.col(CATEGORY))
    medians = percentile_columns(items, "price", {"median_price": 0.5}, ["category"])
    orders = daily.where(F.col("category").isNotNull()).groupBy("category").agg(F.sum("orders_count").alias("total_orders"))
    return measured.join(medians, "category", "left").join(orders, "category").select("category", *FEATURES)


def prediction_features(enriched: DataFrame, ranking: DataFrame, daily: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Features joined with the ranking and labelled: score at or above the eligible P75."""
    scores = ranking.select("category", "seasonality_score", "confidence_level", "seasonality_type")
    label = F.coalesce((F.col("seasonality_score") >= seasonal_threshold(ranking)).cast("int"), F.lit(0))
    return category_features(enriched, daily, sums).join(scores, "category", "inner").withColumn("is_seasonal", label)


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.35, seed: int = SEED) -> DataFrame:
    """Add is_test: ceil(rows x share) test rows, chosen by a seeded hash of the key.

    They are spread over the classes in proportion; what is left after rounding down goes to the
    classes with the largest remainders, the larger class first among equals.
    """
    order = W.partitionBy(label).orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key)
    place = F.row_number().over(order)
    sizes = df.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))  # one row per class
    whole = W.partitionBy()
    exact = F.ceil(F.round(F.sum("_n").over(whole) * F.lit(test_share), 9)) * F.col("_n") / F.sum("_n").over(whole)
    sizes = sizes.withColumn("_exact", exact).withColumn("_rest", F.round(F.col("_exact") - F.floor("_exact"), 9))
    left = F.round(F.sum("_rest").over(whole))
    turn = F.row_number().over(W.orderBy(F.desc("_rest"), F.desc("_n"), "_class"))
    quotas = sizes.select("_class", (F.floor("_exact") + (turn <= left).cast("long")).alias("_quota"))
    return df.join(quotas, F.col(label).eqNullSafe(F.col("_class"))).withColumn("is_test", place <= F.col("_quota")).drop("_class", "_quota")


def _fit_forest(data: DataFrame, features: Sequence[str], label: str, trees: int, scale: bool) -> tuple[DataFrame, list[float]]:
    """Scored test rows (label, score) and feature importances of a balanced forest."""
    parts = stratified_split(data, label, "category").select(
        "category", F.col(label).cast("double").alias("label"), "is_test", *[F.col(f).cast("double").alias(f) for f in features]
    )
    size = F.count(F.lit(1)).over(W.partitionBy("is_test"))
    per_class = F.count(F.lit(1)).over(W.partitionBy("is_test", "label"))
    parts = settle(parts.withColumn("weight", size / (2.0 * per_class)))
    train, test = parts.where("NOT is_test"), parts.where("is_test")
    filled = [f"_f_{f}" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
    ]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features" if scale else "raw_features", weightCol="weight",
        numTrees=trees, minInstancesPerNode=2, seed=SEED, featureSubsetStrategy="sqrt",
    )
    model = Pipeline(stages=[*stages, forest]).fit(train)
    scored = settle(model.transform(test).select("category", "label", vector_to_array("probability")[1].alias("score")))
    return scored, list(model.stages[-1].featureImportances.toArray())


def _enough(data: DataFrame, label: str, min_rows: int) -> bool:
    sizes = [r["n"] for r in data.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()]  # two classes at most
    return sum(sizes) >= min_rows and len(sizes) == 2 and min(sizes) >= 3


def _predict(data, features, label, target, name, trees, min_rows, scale) -> tuple[DataFrame, DataFrame]:
    spark = data.sparkSession
    threshold = data.agg(F.percentile(target, 0.75).alias("target_threshold"))
    if not _enough(data, label, min_rows):
        result = threshold.select(
            F.lit("not_enough_data").alias("model"), *[F.lit(None).cast("double").alias(c) for c in ("roc_auc", "f1", "accuracy")],
            F.lit(0).cast("long").alias("n_train"), F.lit(data.count()).cast("long").alias("n_test"), "target_threshold",
        )
        return result, spearman_importance(data, features, target)
    scored, importances = _fit_forest(data, features, label, trees, scale)
    sizes = stratified_split(data, label, "category").agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test")
    )
    result = binary_scores(scored, "label", "score").select(
        F.lit(name).alias("model"), "roc_auc", "f1", "accuracy",
        sizes.select("n_train").scalar().alias("n_train"),
        sizes.select("n_test").scalar().alias("n_test"),
        threshold.scalar().alias("target_threshold"),
    )
    importance = spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, importances)], "feature string, importance double"
    )
    return result, importance


def predictability(features: DataFrame, trees: int = 400, min_rows: int = 20) -> tuple[DataFrame, DataFrame]:
    """(scores, feature importances) of predicting seasonal categories from their features."""
    data = settle(eligible(features))
    return _predict(data, FEATURES, "is_seasonal", "seasonality_score", "random_forest", trees, min_rows, True)


def early_predictability(features: DataFrame, trees: int = 500, min_rows: int = 18) -> tuple[DataFrame, DataFrame]:
    """(scores, feature importances) of predicting second-half seasonality from the first half."""
    data = settle(early_eligible(features))
    return _predict(
        data, H1_FEATURES, "is_h2_seasonal", "h2_seasonality_score", "h1_to_h2_random_forest", trees, min_rows, False
    )


def seasonality_clusters(index_matrix: DataFrame, seed: int = SEED, restarts: int = 20) -> DataFrame:
    """KMeans over twelve-month index profiles; the restart with the lowest cost wins.

    k is a fifth of the categories, between 2 and 6.
    """
    months = [c for c in index_matrix.columns if c != "category"]
    data = VectorAssembler(inputCols=months, outputCol="features").transform(settle(index_matrix.na.fill(0.0)))
    n = data.count()
    if n < 2:
        return data.select("category", *months, F.lit(0).alias("cluster"))
    k = min(6, max(2, n // 5))
    fits = (KMeans(k=k, seed=seed + i, initMode="k-means||", maxIter=300, tol=1e-8).fit(data) for i in range(restarts))
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select("category", *months, F.col("prediction").alias("cluster"))


def cluster_profiles(clusters: DataFrame) -> DataFrame:
    """Mean profile per cluster."""
    months = [c for c in clusters.columns if c not in ("category", "cluster")]
    return clusters.groupBy("cluster").agg(*[F.avg(m).alias(m) for m in months])
