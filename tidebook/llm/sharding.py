"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidebook.llm.common import unit


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, counted from 0, whose weighted draw for the key is the highest.

    A shard's draw is ``-weight / ln(u)`` with u hashed from key and shard number, so a key goes to
    a shard with probability proportional to its weight, and adding a shard moves only the keys
    that the new shard wins. A weight of 0 takes nothing. Null is a key like any other.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one at least must be positive")
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    draws = [F.struct((F.lit(float(w)) / -F.log(unit(text, F.lit(i)))).alias("draw"), F.lit(-i).alias("order")) for i, w in enumerate(weights) if w > 0]
    best = draws[0] if len(draws) == 1 else F.greatest(*draws)
    return (-best["order"]).cast("int")


def slots(frame: DataFrame, shard: str, order: Sequence[str], slot: str, buckets: int = 256) -> DataFrame:
    """Number each shard's rows from 0 without a gap, in the order of a hash of ``order``.

    A shard may hold any share of the rows: rows are numbered within hash buckets of the shard, and
    a bucket begins where the counts of those before it end. Rows that agree in all of ``order``
    are numbered in any order among themselves.
    """
    keyed = frame.withColumn("_h", F.xxhash64(*order)).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(buckets)).cast("int"))
    counted = keyed.groupBy(F.col(shard).alias("_s"), F.col("_b").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("_s", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_b").orderBy("_h", *order)
    numbered = keyed.withColumn("_i", F.row_number().over(within))
    joined = numbered.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn(slot, (F.col("_start") + F.col("_i") - 1).cast("long")).drop("_h", "_b", "_s", "_c", "_n", "_start", "_i")


def shard_plan(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the key and the shard weights decide alone. ``grown_shard`` is the shard
    with one more shard of mean weight. Size is the text's UTF-8 bytes plus 1; a null text has no
    bytes (size 1) and the checksum of the empty text. Null keys share one shard. Repeated rows all
    stay, each with a slot of its own. An empty table gives no rows; other columns are not read.
    """
    mean = sum(weights) / len(weights)
    narrow = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text) + 1, F.lit(1)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, mean]).alias("grown_shard"),
    )
    out = slots(narrow, "shard", ("doc_id", "text_crc32", "size"), "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def with_shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", column: str = "shard") -> DataFrame:
    """The documents as they are with their shard added; clashing columns of that name go."""
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    return docs.select(*kept, rendezvous(F.col(key), weights).alias(column))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id", files: int = 1) -> None:
    """Write whole documents as Parquet, a folder ``shard=N`` for each shard of ``files`` files.

    The files of a shard are dealt by a hash of the key, so a large shard needs no single task.
    """
    placed = with_shard(docs, weights, key)
    dealt = placed.withColumn("_f", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("file")), F.lit(files)))
    dealt.repartition(len(weights) * files, "shard", "_f").drop("_f").write.mode("overwrite").partitionBy("shard").parquet(path)


def moved(plan: DataFrame) -> Column:
    """True where the grown layout takes the row elsewhere."""
    return reduce(lambda a, b: a & b, [plan["grown_shard"].isNotNull(), plan["grown_shard"] != plan["shard"]])


SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("size", T.LongType()), ("text_crc32", T.LongType()), ("law", T.StringType()), ("shard", T.IntegerType()), ("slot", T.LongType()), ("grown_shard", T.IntegerType()))]
)
