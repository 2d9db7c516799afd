"""Exact interpolating percentiles that never gather the data in one task.

The built-in ``percentile`` merges a map of all distinct values of a group into a single
task. Here the values are counted per (group, bucket, value) with a map-side combine; the
small bucket histogram tells which bucket holds a wanted rank, and only those buckets are
looked into. A bucket spans 1/4096 of a natural-log unit, so their number is bounded by the
range of a double, not by the row count. A wanted bucket is split again into equal parts of its own
range, so that values close to each other still spread, and only the wanted parts are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUCKETS_PER_UNIT = 4096
PARTS = 1024


def _bucket(x: Column) -> Column:
    """Order-preserving integer bucket of a double."""
    magnitude = F.floor(F.log1p(F.abs(x)) * F.lit(float(BUCKETS_PER_UNIT)))
    # Never NULL for the non-null inputs kept below; declaring it so spares the join a
    # not-null filter on one branch, and both branches share one counted exchange.
    return F.coalesce(F.when(x < 0, -magnitude - 1).otherwise(magnitude), F.lit(0))


def exact_percentiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows (*by, q, value): the linearly interpolated q-quantile of the non-null values.

    Groups without any value are absent. Without ``by`` there are at most len(qs) rows.
    """
    by = list(by)
    qs = sorted(set(float(q) for q in qs))
    keys = [f"_k{i}" for i in range(len(by))]
    # NULL group keys are legal groups: carry a flag so that the joins below stay equi joins.
    named = [F.col(b).alias(k) for b, k in zip(by, keys)]
    x = F.col(value).cast("double") + F.lit(0.0)
    counts = (
        df.where(F.col(value).isNotNull())
        .select(*named, _bucket(x).alias("_b"), x.alias("_x"))
        .groupBy(*keys, "_b", "_x")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    upto = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    hist = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_bn"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        .withColumn("_end", F.sum("_bn").over(upto))
        .withColumn("_total", F.sum("_bn").over(W.partitionBy(*keys)))
    )
    wanted = hist.select(
        *keys, "_b", (F.col("_end") - F.col("_bn")).alias("_before"), "_end", "_total", "_low", "_high",
        F.explode(F.array(*[F.lit(q) for q in qs])).alias("q"),
    ).withColumn("_pos", F.col("q") * (F.col("_total") - 1))
    lower = F.floor("_pos")
    upper = F.ceil("_pos")
    holds = lambda rank: (rank >= F.col("_before")) & (rank < F.col("_end"))
    wanted = wanted.where(holds(lower) | holds(upper)).select(
        *keys, "_b", "_before", "_low", "_high", "q", "_pos", lower.alias("_lo"), upper.alias("_hi")
    )
    if not by:
        wanted = F.broadcast(wanted)  # at most two rows per requested quantile
    left, right = counts.alias("c"), wanted.alias("w")
    on = F.col("c._b") == F.col("w._b")
    for k in keys:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}"))
    near = left.join(right, on).select(
        *[F.col(f"w.{k}").alias(k) for k in keys], F.col("w._b").alias("_b"), "q", "_x", "_n", "_before", "_pos", "_lo", "_hi",
        F.coalesce(F.floor(F.try_divide((F.col("_x") - F.col("_low")) * PARTS, F.col("_high") - F.col("_low"))), F.lit(0)).alias("_s"),
    )
    # the parts of a bucket in order, and those of them that hold a wanted rank
    group = [*keys, "q", "_b"]
    upto = W.partitionBy(*group).orderBy("_s").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = near.groupBy(*group, "_s").agg(F.sum("_n").alias("_sn"), *[F.first(c).alias(c) for c in ("_before", "_lo", "_hi")])
    parts = parts.withColumn("_end", F.col("_before") + F.sum("_sn").over(upto)).withColumn("_before", F.col("_end") - F.col("_sn"))
    parts = parts.where(holds(F.col("_lo")) | holds(F.col("_hi"))).select(*group, "_s", "_before")
    if not by:
        parts = F.broadcast(parts)  # as few
    left, right = near.drop("_before").alias("n"), parts.alias("p")
    on = (F.col("n.q") == F.col("p.q")) & (F.col("n._b") == F.col("p._b")) & (F.col("n._s") == F.col("p._s"))
    for k in keys:
        on = on & F.col(f"n.{k}").eqNullSafe(F.col(f"p.{k}"))
    inside = W.partitionBy(*group, "_s").orderBy("_x").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = left.join(right, on).select("n.*", "p._before").withColumn("_stop", F.col("_before") + F.sum("_n").over(inside)).withColumn(
        "_start", F.col("_stop") - F.col("_n")
    )
    at = lambda rank: F.max(F.when((F.col(rank) >= F.col("_start")) & (F.col(rank) < F.col("_stop")), F.col("_x")))
    picked = ranked.groupBy(*keys, "q").agg(at("_lo").alias("_a"), at("_hi").alias("_z"), F.first("_pos").alias("_pos"))
    fraction = F.col("_pos") - F.floor("_pos")
    return picked.select(
        *[F.col(k).alias(b) for b, k in zip(by, keys)],
        "q",
        (F.col("_a") + (F.col("_z") - F.col("_a")) * fraction).alias("value"),
    )


def percentile_columns(
    df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Like exact_percentiles, but one row per group with one column per named quantile."""
    tall = exact_percentiles(df, value, list(named.values()), by)
    wide = [F.max(F.when(F.col("q") == F.lit(float(q)), F.col("value"))).alias(name) for name, q in named.items()]
    return tall.groupBy(*by).agg(*wide)


def percentile_scalar(df: DataFrame, value: str, q: float) -> Column:
    """The global q-quantile as a scalar subquery."""
    return percentile_columns(df, value, {"value": q}).scalar()


def percentiles_struct(df: DataFrame, value: str, named: dict[str, float]) -> Column:
    """Several global quantiles as one scalar subquery of struct type."""
    return percentile_columns(df, value, named).select(F.struct(*named).alias("s")).scalar()
