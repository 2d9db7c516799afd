"""Review analysis over the SQL join of reviews, orders, customers, items and products."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidebook.functions.scalar import guarded_days, percent, safe_div
from tidebook.sources.settle import small_side

# Items only decide which categories an order holds. They are counted per order and category
# before the join, and item_rows carries how many rows of the plain join a row stands for. An order
# gets its customer first and its categories as one list, so that reviews are shuffled by order only.
REVIEW_QUERY = """
SELECT r.order_id, r.review_id, r.review_score, r.review_comment_title, r.review_comment_message,
       r.review_creation_date, o.order_status, o.order_approved_at, o.order_delivered_carrier_date,
       o.order_estimated_delivery_date, o.customer_state, p.categories
FROM {reviews} r
JOIN (SELECT s.order_id, s.order_status, s.order_approved_at, s.order_delivered_carrier_date,
             s.order_estimated_delivery_date, c.customer_state
      FROM {orders} s JOIN {customers} c ON c.customer_id = s.customer_id) o ON r.order_id = o.order_id
JOIN {categories} p ON o.order_id = p.order_id
"""

# Column names after cleaning, in their order.
CLEAN_NAMES = {
    "review_id": "review_id",
    "review_creation_date": "review_date",
    "order_approved_at": "order_approved",
    "order_delivered_carrier_date": "delivered_carrier",
    "order_estimated_delivery_date": "estimated_delivery",
    "product_category_name": "product_category",
    "order_status": "order_status",
    "review_comment_title": "review_title",
    "review_comment_message": "review_message",
    "customer_state": "customer_state",
    "review_score": "score",
}


def review_sql_join(tables: Mapping[str, DataFrame], by_order: bool = False) -> DataFrame:
    """The five-way inner join as SQL over the given tables; ``item_rows`` is each row's multiplicity.

    ``by_order``: a row for every review and order only, with the order's id, and its distinct categories as
    ``categories``. Nothing counts their items, so they meet in one shuffle by order.
    """
    products = tables["products"].select("product_id", "product_category_name")
    items = tables["items"].where("order_id is not null").select("order_id", "product_id").join(products, "product_id")
    if by_order:
        categories = items.groupBy("order_id").agg(F.collect_set(F.struct("product_category_name")).alias("categories"))
    else:
        counted = items.groupBy("order_id", "product_category_name").agg(F.count(F.lit(1)).alias("item_rows"))
        categories = counted.groupBy("order_id").agg(F.collect_list(F.struct("product_category_name", "item_rows")).alias("categories"))
    joined = items.sparkSession.sql(REVIEW_QUERY, categories=categories, **{n: tables[n] for n in ("reviews", "orders", "customers")})
    return joined if by_order else joined.select("*", F.inline("categories")).drop("order_id", "categories")


def shared_reviews(reviews: DataFrame) -> DataFrame:
    """(shared_id): reviews of several orders, and null if there are reviews without an id. Stored."""
    ends = reviews.groupBy(F.col("review_id").alias("shared_id")).agg(F.min("order_id").alias("a"), F.max("order_id").alias("z"))
    return small_side(ends.where("shared_id is null or a <> z").select("shared_id"))


def review_clean(joined: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Distinct rows, renamed and reordered, integer score, empty text as NULL.

    Rows by order come with the ``shared`` reviews. Equal rows have the same review, and the rows of an order are
    in one task, so only those of shared reviews are compared over all tasks.
    """
    text = {f.name for f in joined.schema.fields if f.dataType.simpleString() == "string"} | {"product_category_name"}
    if shared is None:
        rows = joined.drop("item_rows").dropDuplicates()
    else:
        names = F.transform("categories", lambda c: c["product_category_name"]).alias("_names")
        own = [c for c in joined.columns if c not in ("order_id", "categories")]
        each = joined.select("order_id", *own, names).dropDuplicates()
        flat = lambda d: d.select(*own, F.explode("_names").alias("product_category_name"))
        if shared.isEmpty():
            rows = flat(each)
        else:
            same = F.col("review_id").eqNullSafe(F.col("shared_id"))
            rows = flat(each.join(shared, same, "left_anti")).union(flat(each.join(shared, same, "left_semi")).dropDuplicates())
    out = rows.withColumn("review_score", F.col("review_score").cast("int"))
    return out.select(
        *[(F.nullif(F.col(c), F.lit("")) if c in text else F.col(c)).alias(n) for c, n in CLEAN_NAMES.items()]
    )


def drop_matching_columns(df: DataFrame, part: str) -> DataFrame:
    """Drop every column whose name contains ``part``."""
    return df.drop(*[c for c in df.columns if part in c])


def share_of_total(df: DataFrame, key: str, counted: str, name: str = "total") -> DataFrame:
    """Non-null rows per key and their share of all in percent, two digits."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(counted).alias(name))
    whole = F.sum(name).over(W.partitionBy())  # one row per key
    return counts.withColumn("percent", percent(safe_div(name, whole)))


def top_category_share(clean: DataFrame, n: int = 3) -> DataFrame:
    """Categories with most reviewed rows."""
    return share_of_total(clean, "product_category", "customer_state").orderBy(F.desc("total"), "product_category").limit(n)


def category_share_by_score(clean: DataFrame, n: int = 10) -> DataFrame:
    """Per score, the n most frequent categories with their share of that score."""
    counts = (
        clean.where(F.col("product_category").isNotNull() & F.col("score").isNotNull())
        .groupBy("score", "product_category")
        .agg(F.count("customer_state").alias("total"))
    )
    by_score = W.partitionBy("score")
    place = F.row_number().over(by_score.orderBy(F.desc("total"), "product_category"))
    share = percent(safe_div("total", F.sum("total").over(by_score)))
    return counts.withColumns({"percent": share, "place": place}).where(F.col("place") <= n)


def _complete(df: DataFrame) -> DataFrame:
    """Rows without a missing value, as ``dropna``, in one condition per column, so that each is met before the joins."""
    for f in df.schema.fields:
        df = df.where(F.col(f.name).isNotNull())
        if f.dataType.simpleString() in ("double", "float"):
            df = df.where(~F.isnan(f.name))
    return df


def review_delivery(clean: DataFrame) -> DataFrame:
    """Complete rows with days from approval to carrier, missing or reversed ones imputed.

    The substitute is the absolute mean of the customer's state.
    """
    days = guarded_days("order_approved", "delivered_carrier").cast("double")
    complete = _complete(clean).withColumn("days_raw", days)
    # The mean per state comes from a small aggregate: a window would gather a hot state in one task.
    means = small_side(complete.groupBy("customer_state").agg(F.abs(F.avg("days_raw")).alias("_mean")))
    return complete.join(means, "customer_state", "left").withColumn(
        "days_to_delivery", F.coalesce("days_raw", "_mean")
    ).drop("_mean")


def slow_scores(with_days: DataFrame, more_than: float = 10) -> DataFrame:
    """Rows per score among slow deliveries."""
    return with_days.where(F.col("days_to_delivery") > more_than).groupBy("score").agg(F.count(F.lit(1)).alias("reviews_count"))
