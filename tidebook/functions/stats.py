"""Rank statistics on category-grain tables (bounded by the number of categories)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def average_rank(value: str, partition: Sequence[str] = ()) -> Column:
    """Rank in which ties share their mean position; rows must be non-null in ``value``."""
    first = F.rank().over(W.partitionBy(*partition).orderBy(value))
    ties = F.count(F.lit(1)).over(W.partitionBy(*partition, value))
    return first + (ties - 1) / 2.0


def percent_rank_avg(value: str) -> Column:
    """Average rank over the non-null count; NULL stays NULL; 0 for all rows if not rankable."""
    everything = W.partitionBy()
    n = F.count(value).over(everything)
    spread = (F.max(value).over(everything) != F.min(value).over(everything)) & (n > 1)
    first = F.rank().over(W.partitionBy().orderBy(F.col(value).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(W.partitionBy(value))
    ranked = F.when(F.col(value).isNotNull(), (first + (ties - 1) / 2.0) / n)
    return F.when(spread, ranked).otherwise(F.lit(0.0))


def row_mean(columns: Sequence[str]) -> Column:
    """Mean over the non-null columns of a row."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, present.cast("double"))


def spearman_importance(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, importance): |Spearman correlation| of each feature with the target."""
    tall = df.select(F.col(target).cast("double").alias("_t"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        ["_t"], list(features), "feature", "_f"
    )
    pairs = tall.where(F.col("_t").isNotNull() & F.col("_f").isNotNull())
    ranked = pairs.select(
        "feature", average_rank("_f", ["feature"]).alias("_rf"), average_rank("_t", ["feature"]).alias("_rt")
    )
    # A constant column has no correlation: NULL, not a division error.
    spread = F.stddev_pop("_rf") * F.stddev_pop("_rt")
    corr = ranked.groupBy("feature").agg(F.abs(F.try_divide(F.covar_pop("_rf", "_rt"), spread)).alias("importance"))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(corr, "feature", "left")


def binary_scores(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: roc_auc (rank sum), f1 and accuracy of a score against a 0/1 label."""
    ranked = df.where(F.col(score).isNotNull()).select(
        F.col(label).cast("int").alias("_y"),
        (F.col(score) >= F.lit(threshold)).cast("int").alias("_p"),
        average_rank(score).alias("_r"),
    )
    y, p = F.col("_y"), F.col("_p")
    agg = ranked.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("pos"),
        F.sum(F.when(y == 1, F.col("_r"))).alias("ranksum"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if(y == p).alias("hit"),
    )
    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    return agg.select(
        F.try_divide(F.col("ranksum") - pos * (pos + 1) / 2, pos * neg).alias("roc_auc"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0)).alias("f1"),
        F.try_divide(F.col("hit").cast("double"), F.col("n").cast("double")).alias("accuracy"),
    )


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, by descending threshold."""
    per_score = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n")
    )
    down = W.partitionBy().orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy()
    share = lambda c: F.try_divide(F.sum(c).over(down).cast("double"), F.sum(c).over(whole).cast("double"))
    return per_score.select("threshold", share("_n").alias("fpr"), share("_p").alias("tpr"))
