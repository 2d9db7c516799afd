"""The full outer merge of seven tables as weights: how many merged rows each source row stands in.

The merge pairs every item, payment and review of an order and then adds products, customers and
sellers, those that match nothing too. Its rows are never formed: per order the three
multiplicities are stored once, and a row's weight is the product of the others. Any statistic of one
column of the merge, or of columns of one table, is a weighted statistic of that table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.sources.settle import settle

Tables = Mapping[str, DataFrame]
#: Columns that one side of the merge shares with others, and the sides that supply them.
SHARED = {"order_id": ("items", "payments", "reviews"), "product_id": ("products",), "customer_id": ("customers",), "seller_id": ("sellers",)}
SIDES = ("orders", "items", "payments", "reviews", "products", "customers", "sellers")


def _times(*names: str) -> Column:
    product: Column = F.lit(1).cast("long")
    for name in names:
        product = product * F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(1))
    return product


class Merge:
    """The merge of ``tables``; ids are unique in orders, products, customers and sellers.

    A null key matches nothing. Items whose order is missing are not in the merge.
    """

    def __init__(self, tables: Tables):
        self.tables = tables
        self._sums: dict[str, DataFrame] = {}

    @cached_property
    def sizes(self) -> DataFrame:
        """Per order id of orders, payments or reviews: how many rows each table holds for it. Stored."""
        n = lambda name, alias: self.tables[name].where(F.col("order_id").isNotNull()).groupBy("order_id").agg(F.count(F.lit(1)).alias(alias))
        orders = self.tables["orders"].select("order_id", "customer_id", F.lit(1).alias("in_orders"))
        kept = orders.join(n("items", "n_items"), "order_id", "left")
        return settle(kept.join(n("payments", "n_pay"), "order_id", "full_outer").join(n("reviews", "n_rev"), "order_id", "full_outer"))

    def weighted(self, side: str) -> DataFrame:
        """The rows of one table with their ``weight`` in the merge; rows outside the merge are left out."""
        return {
            "orders": lambda: self._of_order("orders", ("n_items", "n_pay", "n_rev"), "inner"),
            "items": lambda: self._of_order("items", ("n_pay", "n_rev"), "inner"),
            "payments": lambda: self._of_order("payments", ("n_items", "n_rev"), "left"),
            "reviews": lambda: self._of_order("reviews", ("n_items", "n_pay"), "left"),
            "products": lambda: self._dimension("products", "product_id", self._item_sums),
            "sellers": lambda: self._dimension("sellers", "seller_id", self._item_sums),
            "customers": lambda: self._dimension("customers", "customer_id", self._order_sums),
        }[side]()

    def _of_order(self, side: str, others: Sequence[str], how: str) -> DataFrame:
        sizes = self.sizes if how == "left" else self.sizes.where("in_orders = 1")
        per_order = sizes.where(F.col("order_id").isNotNull()).select("order_id", _times(*others).alias("weight"))
        return self.tables[side].join(per_order, "order_id", how).withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))

    def _item_sums(self, key: str) -> DataFrame:
        """Merged rows that hold an item, per value of an item's column."""
        return self.weighted("items").where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("weight").alias("weight"))

    def _order_sums(self, key: str) -> DataFrame:
        whole = self.sizes.where(F.col(key).isNotNull()).select(key, _times("n_items", "n_pay", "n_rev").alias("w"))
        return whole.groupBy(key).agg(F.sum("w").alias("weight"))

    def _dimension(self, side: str, key: str, sums) -> DataFrame:
        """A dimension's rows; one that matches nothing stands in one row, and is ``lone``."""
        if key not in self._sums:
            self._sums[key] = settle(sums(key))  # a row for each key; several steps read it
        joined = self.tables[side].join(self._sums[key], key, "left")
        return joined.withColumn("lone", F.col("weight").isNull()).withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))

    def _lone(self, side: str) -> DataFrame:
        return self.weighted(side).where("lone").drop("lone")

    def order_ids(self) -> DataFrame:
        """(order_id, weight): merged rows of every order id."""
        return self.sizes.select("order_id", _times("n_items", "n_pay", "n_rev").alias("weight"))

    def total(self) -> DataFrame:
        """(weight): parts that add up to the number of merged rows."""
        parts = [self.order_ids().select("weight")]
        parts += [self.weighted(s).where(F.col("order_id").isNull()).select("weight") for s in ("payments", "reviews")]
        parts += [self._lone(s).select("weight") for s in ("products", "customers", "sellers")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def rows(self) -> Column:
        """Number of merged rows, as a scalar."""
        return self.total().agg(F.sum("weight")).scalar()

    def columns(self) -> dict[str, str]:
        """Column name to type, in the order of the merge."""
        return {f.name: f.dataType.simpleString() for side in SIDES for f in self.tables[side].schema.fields}

    def value_counts(self) -> DataFrame:
        """(name, value, n): merged rows of every value, as text, of every column; nulls are left out.

        Each table is read once, its columns as rows; values combine before the shuffle.
        """
        keyed = {
            "order_id": self.order_ids(),
            "customer_id": self.weighted("orders").select("customer_id", "weight").unionByName(self._lone("customers").select("customer_id", "weight")),
        }
        for side, key in (("products", "product_id"), ("sellers", "seller_id")):
            lone = self._lone(side).select(key, "weight")
            keyed[key] = self._sums[key].select(key, "weight").unionByName(lone)
        tall = [frame.select(F.lit(name).alias("name"), F.col(name).cast("string").alias("value"), "weight") for name, frame in keyed.items()]
        for side in SIDES:
            own = [c for c in self.tables[side].columns if c not in keyed]
            if own:
                frame = self.weighted(side).select("weight", *[F.col(c).cast("string").alias(c) for c in own])
                tall.append(frame.unpivot(["weight"], own, "name", "value").select("name", "value", "weight"))
        out = tall[0]
        for t in tall[1:]:
            out = out.unionByName(t)
        return out.where(F.col("value").isNotNull()).groupBy("name", "value").agg(F.sum("weight").alias("n"))

    def first_rows(self, n: int) -> DataFrame:
        """The first merged rows in the order of order, item, payment and review, missing ones last.

        They lie among the first rows of each table for the lowest order ids.
        """
        order = {"items": "order_item_id", "payments": "payment_sequential", "reviews": "review_id"}
        ids = F.broadcast(self.sizes.where(F.col("order_id").isNotNull()).select("order_id").orderBy("order_id").limit(n))  # n rows
        out = ids.join(self.tables["orders"], "order_id", "left")
        kept = ids.join(self.tables["orders"].select("order_id"), "order_id", "left_semi")
        for side, by in order.items():
            rows = self.tables[side].join(kept if side == "items" else ids, "order_id")
            place = F.row_number().over(_window("order_id").orderBy(F.col(by).asc_nulls_last(), *[c for c in rows.columns if c not in ("order_id", by)]))
            out = out.join(rows.withColumn("_r", place).where(F.col("_r") <= n).drop("_r"), "order_id", "left")
        for side, key in (("products", "product_id"), ("customers", "customer_id"), ("sellers", "seller_id")):
            out = out.join(self.tables[side], key, "left")
        return out.orderBy("order_id", *[F.col(by).asc_nulls_last() for by in order.values()]).limit(n)


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def profile(merge: Merge, order_by: Sequence[str] = ("order_id", "order_item_id", "payment_sequential", "review_id")) -> DataFrame:
    """Per column of the merge: dtype, missing, distinct values, first three values, base-2 entropy."""
    types = merge.columns()
    n = F.col("n").cast("double")
    whole = F.sum(n)
    counted = merge.value_counts().groupBy("name").agg(
        F.sum("n").alias("present"), F.count(F.lit(1)).alias("uniques"), (F.log2(whole) - F.sum(n * F.log2(n)) / whole).alias("entropy")
    )
    names = merge.tables["orders"].sparkSession.createDataFrame(list(types.items()), "name string, dtype string")  # a row for each column
    head = settle(merge.first_rows(3))
    by = [F.col(c).asc_nulls_last() for c in order_by]
    numbered = head.withColumn("_p", F.row_number().over(_window().orderBy(*by)))  # three rows
    texts = numbered.select("_p", *[F.col(c).cast("string").alias(c) for c in types])
    firsts = texts.unpivot(["_p"], list(types), "name", "value").groupBy("name").agg(
        *[F.max(F.when(F.col("_p") == i, F.col("value"))).alias(f"{word}_value") for i, word in enumerate(("first", "second", "third"), 1)]
    )
    rows = F.coalesce(merge.rows(), F.lit(0))
    return names.join(counted, "name", "left").join(firsts, "name", "left").select(
        "name", "dtype", (rows - F.coalesce("present", F.lit(0))).alias("missing"), F.coalesce("uniques", F.lit(0)).alias("uniques"),
        "first_value", "second_value", "third_value", "entropy",
    )


def kinds(merge: Merge, ids: Sequence[str], categorical_max: int = 27) -> DataFrame:
    """Every column of the merge as binary, categorical (few values), id or numeric, by its distinct values."""
    uniques = merge.value_counts().groupBy("name").agg(F.count(F.lit(1)).alias("uniques"))
    names = merge.tables["orders"].sparkSession.createDataFrame([(n,) for n in merge.columns()], "name string")  # a row for each column
    found = names.join(uniques, "name", "left").withColumn("uniques", F.coalesce("uniques", F.lit(0)))
    kind = (
        F.when(F.col("uniques") == 2, "binary")
        .when(F.col("uniques") <= categorical_max, "categorical")
        .when(F.col("name").isin(list(ids)), "id")
        .otherwise("numeric")
    )
    return found.withColumn("kind", kind)
