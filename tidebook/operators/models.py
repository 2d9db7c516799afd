"""Order-grain models: delivery-time regression, operational clusters, freight regressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import MinMaxScaler, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidebook.functions.quantiles import percentile_columns
from tidebook.functions.scalar import safe_div, time_between, whole_days
from tidebook.operators import neighbours
from tidebook.sources.settle import settle

FOLDS = 10
POSITION_BUCKETS = 4096
#: Rows that one task of the clustering reads, about.
CLUSTER_ROWS = 250_000
CATEGORICAL = ("geolocation_state_customer", "geolocation_state_seller", "year", "purchase_month", "purchase_dow")
NUMERIC = ("distance", "product_size_cm3", "product_weight_g")


def with_folds(data: DataFrame, day: str, key: str, folds: int = FOLDS, bucket: Column | None = None) -> DataFrame:
    """Contiguous folds of equal size in the order (day, bucket, key); the bucket is a hash of the key unless given.

    The global position is the offset of a small (day, hash bucket) group plus the position
    inside it. A busy day spreads over 4096 buckets, so no window partition grows with the
    data of one day, and the offsets come from the group counts alone.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(POSITION_BUCKETS)) if bucket is None else bucket
    parts = data.withColumns({"_d": F.to_date(day), "_b": bucket.cast("int")})
    sizes = parts.groupBy("_d", "_b").agg(F.count(F.lit(1)).alias("_n"))
    days = sizes.groupBy("_d").agg(F.sum("_n").alias("_dn"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    day_offset = days.select(
        "_d",
        F.coalesce(F.sum("_dn").over(before(W.partitionBy().orderBy("_d"))), F.lit(0)).alias("_day0"),
        F.sum("_dn").over(W.partitionBy()).alias("_total"),
    )
    offsets = sizes.withColumn(
        "_in_day", F.coalesce(F.sum("_n").over(before(W.partitionBy("_d").orderBy("_b"))), F.lit(0))
    ).join(day_offset, "_d").select("_d", "_b", (F.col("_day0") + F.col("_in_day")).alias("_start"), "_total")
    place = F.row_number().over(W.partitionBy("_d", "_b").orderBy(key)) - 1
    return parts.withColumn("_p", place).join(offsets, ["_d", "_b"]).withColumn(
        "fold", F.floor((F.col("_start") + F.col("_p")) * folds / F.col("_total")).cast("int")
    ).drop("_d", "_b", "_p", "_start", "_total")


def _delivery_vectors() -> Pipeline:
    text = [f"_s_{c}" for c in CATEGORICAL]
    index = StringIndexer(inputCols=text, outputCols=[f"_i_{c}" for c in CATEGORICAL], handleInvalid="keep", stringOrderType="alphabetAsc")
    onehot = OneHotEncoder(inputCols=[f"_i_{c}" for c in CATEGORICAL], outputCols=[f"_o_{c}" for c in CATEGORICAL])
    raw = VectorAssembler(inputCols=list(NUMERIC), outputCol="_numeric")
    scaled = MinMaxScaler(inputCol="_numeric", outputCol="_scaled")
    features = VectorAssembler(inputCols=["_scaled", *[f"_o_{c}" for c in CATEGORICAL]], outputCol="features")
    return Pipeline(stages=[index, onehot, raw, scaled, features])


def delivery_matrix(data: DataFrame, folds: int = FOLDS, bucket: Column | None = None) -> DataFrame:
    """(order_id, wait_time, count, fold, features): one-hot places and dates, min-max sizes."""
    ready = with_folds(data, "order_purchase_timestamp", "order_id", folds, bucket).withColumns(
        {f"_s_{c}": F.col(c).cast("string") for c in CATEGORICAL}
    )
    model = _delivery_vectors().fit(ready)
    return model.transform(ready).select("order_id", F.col("wait_time").cast("double").alias("wait_time"), "count", "fold", vector_to_array("features").alias("features"))


def _design(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(1, features), value, weight and fold of each row."""
    x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
    y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("wait_time", "count"))
    return np.hstack([np.ones((len(x), 1)), x]), y, w, batch.column("fold").to_numpy()


def _summed(matrix: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """Sums over all rows: each task adds up its own, one row a task is added up to one array.

    ``shape`` depends on the number of features and folds only.
    """
    schema = pa.schema([("sums", pa.list_(pa.float64()))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            add(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], schema=schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape).ravel()
        for batch in batches:
            for row in batch.column(0):
                total += row.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], schema=schema)

    ddl = "sums array<double>"
    return np.array(matrix.mapInArrow(part, ddl).repartition(1).mapInArrow(whole, ddl).first()["sums"]).reshape(shape)


def fold_coefficients(matrix: DataFrame, size: int, folds: int = FOLDS) -> np.ndarray:
    """Intercept and coefficients of the least-squares fit without each fold, a row a fold.

    One pass sums the products of all features and the value for each fold; the rows outside a fold
    are the total minus its own. Of the solutions that fit equally well (one-hot features add up to
    the intercept) the one with the shortest coefficients is taken.
    """

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        x, y, w, fold = _design(batch, size)
        z = np.hstack([x, y[:, None]])
        for f in np.unique(fold):
            mine = z[fold == f]
            total[f] += (mine * w[fold == f, None]).T @ mine

    moments = _summed(matrix, (folds, size + 2, size + 2), add)
    out = np.zeros((folds, size + 1))
    for f in range(folds):
        m = moments.sum(0) - moments[f]
        n = m[0, 0]
        if n <= 0:
            out[f] = np.nan
            continue
        mean = m[0, 1:] / n
        spread = m[1:, 1:] - n * np.outer(mean, mean)
        slope = np.linalg.lstsq(spread[:-1, :-1], spread[:-1, -1], rcond=1e-10)[0]
        out[f] = np.concatenate([[mean[-1] - mean[:-1] @ slope], slope])
    return out


def _size(matrix: DataFrame) -> int | None:
    first = matrix.select(F.size("features")).first()
    return first[0] if first else None


def delivery_lr_cv(matrix: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Cross-validated linear-regression predictions, one fit per contiguous fold, all fits from one pass."""
    matrix = settle(matrix)
    columns = ("order_id", "wait_time", "count", "fold")
    size = _size(matrix)
    if size is None:
        return matrix.select(*columns, F.lit(None).cast("double").alias("prediction"))
    fits = fold_coefficients(matrix, size, folds)
    ddl = ", ".join(f"{c} {matrix.schema[c].dataType.simpleString()}" for c in columns) + ", prediction double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, _, fold = _design(batch, size)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array((x * fits[fold]).sum(1))], names=[*columns, "prediction"])

    return matrix.mapInArrow(run, ddl)


def delivery_lr_normal(matrix: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(fold, rows, worst): rows that each fit learns from, and its largest mean product of residual and feature.

    A least-squares fit is one whose residuals are orthogonal to every feature and to 1, so ``worst``
    is 0 but for rounding.
    """
    matrix = settle(matrix)
    size = _size(matrix)
    fits = fold_coefficients(matrix, size, folds)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        x, y, w, fold = _design(batch, size)
        for f in range(folds):
            used = fold != f
            rest = y[used] - x[used] @ fits[f]
            total[f, 0] += w[used].sum()
            total[f, 1:] += (x[used] * (w[used] * rest)[:, None]).sum(0)

    sums = _summed(matrix, (folds, size + 2), add)
    rows = [(f, int(sums[f, 0]), float(np.abs(sums[f, 1:]).max() / sums[f, 0])) for f in range(folds)]
    return matrix.sparkSession.createDataFrame(rows, "fold int, rows long, worst double")  # a row a fold


def cv_report(predictions: DataFrame, model: str) -> DataFrame:
    """One row: rows and mean of predicted - actual."""
    error = (F.col("prediction") - F.col("wait_time")) * F.col("count")
    return predictions.agg(
        F.lit(model).alias("model"), F.sum("count").alias("rows"), (F.sum(error) / F.sum("count")).alias("directed_error")
    )


def delivery_knn(data: DataFrame, folds: int = FOLDS, k: int = 3, bucket: Column | None = None) -> DataFrame:
    """Cross-validated predictions by the k nearest deliveries of the other folds.

    (order_id, fold, count, wait_time, prediction); an order of n items is n equal rows, all in one
    fold. Distance, size and weight are scaled to 0..1, places and dates are compared as one-hot
    vectors.
    """
    ready = with_folds(data, "order_purchase_timestamp", "order_id", folds, bucket)
    rows = settle(neighbours.points(ready, "order_id", "fold", "count", "wait_time", NUMERIC, CATEGORICAL))
    found = neighbours.nearest_mean(rows, len(NUMERIC), len(CATEGORICAL), folds, k)
    return found.select(F.col("key").alias("order_id"), "fold", F.col("weight").alias("count"), F.col("value").alias("wait_time"), "prediction")


FACTORS = ("act_lead_days", "approval_mins", "order_item_id", "price", "freight_value", "product_weight_g")


def operational_factors(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Complete item rows with the six clustering factors, status and purchase quarter.

    A row counts if nothing is missing in its order, item, product with English category, seller
    and customer.
    """
    ts = "order_purchase_timestamp"
    orders = tables["orders"].dropna().select(
        "order_id", "order_status", "customer_id",
        F.concat(F.year(ts).cast("string"), F.lit("."), F.quarter(ts).cast("string")).alias("year_quarter"),
        whole_days(ts, "order_delivered_customer_date").alias("act_lead_days"),
        time_between("MINUTE", ts, "order_approved_at").alias("approval_mins"),
    )
    named = tables["translations"].dropna().select("product_category_name")
    products = tables["products"].dropna().join(named, "product_category_name", "left_semi").select("product_id", "product_weight_g")
    items = tables["items"].dropna().select("order_id", "product_id", "seller_id", "order_item_id", "price", "freight_value")
    orders = orders.join(tables["customers"].dropna(), "customer_id", "left_semi")
    joined = items.join(products, "product_id").join(tables["sellers"].dropna(), "seller_id", "left_semi").join(orders, "order_id")
    return joined.select("order_id", "order_status", "year_quarter", *[F.col(c).cast("double").alias(c) for c in FACTORS])


def in_parts(stored: DataFrame, rows: int) -> DataFrame:
    """A stored frame, stored again in more partitions where its own hold more than ``rows`` rows on average."""
    total = stored.count()
    if total <= rows * stored.rdd.getNumPartitions():
        return stored
    return settle(stored.repartition(-(-total // rows)))


def order_clusters(factors: DataFrame, k: int = 6, seed: int = 32123, scale: bool = False) -> DataFrame:
    """KMeans labels on the six factors; raw values unless ``scale``.

    Rows with equal factors are merged into one weighted row, which every iteration reads from
    storage, in parts of so many rows that no task's share grows with the input. Iterations go on until no
    centre moves.
    """
    distinct = in_parts(settle(factors.groupBy(*FACTORS).agg(F.count(F.lit(1)).cast("double").alias("_weight"))), CLUSTER_ROWS)
    stages = [VectorAssembler(inputCols=list(FACTORS), outputCol="_raw")]
    if scale:
        stages.append(MinMaxScaler(inputCol="_raw", outputCol="_scaled"))
    vectors = "_scaled" if scale else "_raw"
    stages.append(KMeans(k=k, seed=seed, maxIter=1000, tol=1e-8, featuresCol=vectors, predictionCol="cluster", weightCol="_weight"))
    return Pipeline(stages=stages).fit(distinct).transform(factors).drop("_raw", "_scaled")


def misplaced(clusters: DataFrame, columns: Sequence[str] = FACTORS) -> DataFrame:
    """One row: rows, clusters, and rows that lie nearer to another cluster's mean than to their own.

    None does where the iterations have come to rest, whatever they began with. A row per cluster
    reaches the driver.
    """
    clusters = settle(clusters)
    means = clusters.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns]).orderBy("cluster").collect()
    to = lambda m: sum(((F.col(c) - F.lit(m[c])) * (F.col(c) - F.lit(m[c])) for c in columns), F.lit(0.0))
    nearest = F.array_min(F.array(*[to(m) for m in means])) if means else F.lit(0.0)
    own = F.coalesce(*[F.when(F.col("cluster") == m["cluster"], to(m)) for m in means], F.lit(0.0)) if means else F.lit(0.0)
    return clusters.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("cluster").alias("clusters"), F.count_if(own > nearest * (1 + 1e-9) + 1e-9).alias("misplaced"))


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """Rows and mean factors per cluster."""
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(f"avg_{c}") for c in FACTORS])


def group_medians(df: DataFrame, by: Sequence[str], columns: Sequence[str] = FACTORS) -> DataFrame:
    """Exact medians of several columns per group, in one pass over the long form."""
    tall = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), list(columns), "_column", "_value")
    medians = percentile_columns(tall, "_value", {"median": 0.5}, [*by, "_column"])
    return medians.groupBy(*by).pivot("_column", list(columns)).agg(F.first("median"))


def cluster_quarter_medians(clusters: DataFrame) -> DataFrame:
    """Median factors of delivered items per cluster and purchase quarter."""
    return group_medians(clusters.where("order_status = 'delivered'"), ["cluster", "year_quarter"])


def _by_position(items: DataFrame) -> DataFrame:
    """Freight moments per item position: sufficient for a regression on the position."""
    y = F.col("freight_value")
    return items.where(y.isNotNull() & F.col("order_item_id").isNotNull()).groupBy(F.col("order_item_id").cast("double").alias("x")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(y).alias("mean"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")
    )


def freight_glm(items: DataFrame) -> DataFrame:
    """Quasi-Poisson regression (log link) of freight on the item position.

    The fit runs on one weighted row per position, which has the same likelihood equations as
    the items; the dispersion is Pearson's chi-square over the residual degrees of freedom.
    """
    moments = settle(_by_position(items))
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(moments)
    model = GeneralizedLinearRegression(
        family="poisson", link="log", labelCol="mean", weightCol="n", maxIter=50, tol=1e-10
    ).fit(vectors)
    slope, intercept = float(model.coefficients[0]), float(model.intercept)
    mu = F.exp(F.lit(intercept) + F.lit(slope) * F.col("x"))
    chi = F.sum((F.col("syy") - 2 * mu * F.col("sy") + F.col("n") * mu * mu) / mu)
    return moments.agg(
        F.lit(intercept).alias("intercept"), F.lit(slope).alias("slope"),
        safe_div(chi, F.sum("n") - 2).alias("dispersion"), F.sum("n").cast("long").alias("rows"),
    )


def freight_poly(items: DataFrame, degree: int = 6) -> DataFrame:
    """Polynomial regression of freight on the item position: fitted value per position.

    Positions are mapped to [-1, 1] and expanded in Legendre polynomials, which spans the same
    functions as raw powers but stays well conditioned.
    """
    moments = settle(_by_position(items))
    ends = moments.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    low, high, distinct = ends
    if not 1 <= degree < distinct:
        raise ValueError(f"a polynomial of degree {degree} needs more than {degree} item positions, there are {distinct}")
    t = (F.col("x") - F.lit(low)) * 2 / F.lit(high - low) - 1
    terms = [F.lit(1.0), t]
    for k in range(1, degree):
        terms.append(((2 * k + 1) * t * terms[k] - k * terms[k - 1]) / (k + 1))
    expanded = moments.withColumn("features", array_to_vector(F.array(*terms[1:])))
    fit = LinearRegression(labelCol="mean", weightCol="n", solver="normal").fit(expanded)
    return fit.transform(expanded).select("x", "n", "mean", F.col("prediction").alias("fitted"))
