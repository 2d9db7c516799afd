"""Adapter: the TPC-H-like star schema expressed as the nine canonical tables.

Narrow column expressions over the given Parquet tables, one row per source row; nothing is
shuffled except the distinct brand list behind the translations. Missing values are derived
by rule so that the null semantics of the operators are exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR = 1999  # last year but one with all twelve months


def _shift(unit: str, amount, ts):
    return F.timestamp_add(unit, amount.cast("int"), ts)


class StarTables:
    """Lazily adapted tables; each attribute is built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}
        self._built: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._raw[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = getattr(self, name)()
        return self._built[name]

    def keys(self):
        return (
            "orders", "items", "products", "translations", "payments", "reviews", "customers", "sellers", "geolocation",
        )

    def items_of(self):
        return {name: self[name] for name in self.keys()}

    def orders(self) -> DataFrame:
        key, cust, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
        bought = F.timestamp_add("SECOND", (key * 7919 % 86400).cast("int"), F.col("o_orderdate"))
        shipped = _shift("HOUR", key * 17 % 120 + 1, F.col("order_purchase_timestamp"))
        received = _shift("HOUR", (cust * 13 + key) % 30 * 24 + key * 11 % 24, F.col("order_delivered_carrier_date"))
        return (
            self.raw("orders")
            .withColumn("order_purchase_timestamp", bought)
            .withColumn("order_delivered_carrier_date", shipped)
            .select(
                key.alias("order_id"),
                cust.alias("customer_id"),
                F.when(status == "F", "delivered").when(status == "O", "shipped").otherwise("processing").alias("order_status"),
                "order_purchase_timestamp",
                F.when(cust % 23 != 0, _shift("MINUTE", key * 31 % 2880, F.col("order_purchase_timestamp"))).alias("order_approved_at"),
                "order_delivered_carrier_date",
                F.when((status != "P") & (key % 41 != 0), received).alias("order_delivered_customer_date"),
                _shift("DAY", F.lit(20), F.col("o_orderdate")).alias("order_estimated_delivery_date"),
            )
        )

    def items(self) -> DataFrame:
        freight = F.col("l_quantity") * 2.5 * (1 + F.col("l_suppkey") % 12) + F.col("l_linenumber") * F.lit(0.25).cast("double")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").alias("price"),
            freight.cast("double").alias("freight_value"),
        )

    def products(self) -> DataFrame:
        size = F.col("p_size")
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(size != 50, F.col("p_brand")).alias("product_category_name"),
            F.length("p_name").cast("double").alias("product_name_lenght"),
            F.when(size % 9 != 0, F.length("p_name") * 10 + size).cast("double").alias("product_description_lenght"),
            F.nullif(size % 7, F.lit(0)).cast("double").alias("product_photos_qty"),
            (size * 100).cast("double").alias("product_weight_g"),
            (size + 10).cast("double").alias("product_length_cm"),
            (size % 13 + 2).cast("double").alias("product_height_cm"),
            (size % 17 + 5).cast("double").alias("product_width_cm"),
        )

    def translations(self) -> DataFrame:
        brand = F.col("p_brand")
        english = F.when(brand != "Brand#25", F.lower(F.replace(brand, F.lit("#"), F.lit("_"))))
        return self.raw("part").select("p_brand").distinct().select(
            brand.alias("product_category_name"), english.alias("product_category_name_english")
        )

    def payments(self) -> DataFrame:
        flag = F.col("l_returnflag")
        kind = F.when(flag == "A", "credit_card").when(flag == "N", "boleto").otherwise("voucher")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("payment_sequential"),
            kind.alias("payment_type"),
            F.nullif(F.col("l_quantity").cast("int") % 13, F.lit(0)).alias("payment_installments"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("payment_value"),
        )

    def reviews(self) -> DataFrame:
        line = F.col("l_linenumber")
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 8 + line).alias("review_id"),
            F.col("l_orderkey").alias("order_id"),
            F.nullif((F.col("l_suppkey") + line) % 6, F.lit(0)).cast("int").alias("review_score"),
            F.when(line % 3 == 0, F.lit("")).otherwise(F.col("l_returnflag")).alias("review_comment_title"),
            F.when(line % 2 == 1, F.col("l_linestatus")).alias("review_comment_message"),
            F.col("l_shipdate").alias("review_creation_date"),
            _shift("HOUR", F.col("l_partkey") % 72, F.col("l_shipdate")).alias("review_answer_timestamp"),
        )

    def nations(self) -> DataFrame:
        """Fixed-size dimension: 25 nations in 5 regions."""
        return (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("region"))
        )

    def regions(self) -> DataFrame:
        return self.nations().select("state", "region")

    @staticmethod
    def _zip(nation, key):
        return F.lpad((nation * 3989 + key % 400).cast("string"), 5, "0")

    def customers(self) -> DataFrame:
        key, nation = F.col("c_custkey"), F.col("c_nationkey")
        return self.raw("customer").join(self.nations(), nation == F.col("n_nationkey"), "left").select(
            key.alias("customer_id"),
            F.col("c_name").alias("customer_unique_id"),
            self._zip(nation, key).alias("customer_zip_code_prefix"),
            F.concat(F.lower("state"), F.lit("-"), (key % 5).cast("string")).alias("customer_city"),
            F.col("state").alias("customer_state"),
        )

    def sellers(self) -> DataFrame:
        key, nation = F.col("s_suppkey"), F.col("s_nationkey")
        return self.raw("supplier").join(self.nations(), nation == F.col("n_nationkey"), "left").select(
            key.alias("seller_id"),
            self._zip(nation, key).alias("seller_zip_code_prefix"),
            F.concat(F.lower("state"), F.lit("-"), (key % 5).cast("string")).alias("seller_city"),
            F.col("state").alias("seller_state"),
        )

    def geolocation(self) -> DataFrame:
        def points(table, key, nation):
            return self.raw(table).join(self.nations(), F.col(nation) == F.col("n_nationkey"), "left").select(
                self._zip(F.col(nation), F.col(key)).alias("geolocation_zip_code_prefix"),
                (F.lit(-36.0).cast("double") + F.col(nation) * 1.75 + (F.col(key) % 64) / 64.0).alias("geolocation_lat"),
                (F.lit(-70.0).cast("double") + F.col(nation) * 1.375 + (F.col(key) % 32) / 32.0).alias("geolocation_lng"),
                F.concat(F.lower("state"), F.lit("-"), (F.col(key) % 5).cast("string")).alias("geolocation_city"),
                F.col("state").alias("geolocation_state"),
            )

        return points("customer", "c_custkey", "c_nationkey").unionByName(points("supplier", "s_suppkey", "s_nationkey"))
