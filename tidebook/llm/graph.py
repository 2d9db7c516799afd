"""Connected components of a link table by alternating neighbourhood minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import cut, release


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is its smallest reachable node.

    Each round links every larger neighbour of a node, then every smaller one, to the smallest
    node of its neighbourhood, until nothing changes; the number of rounds grows with the
    logarithm of the longest path. Every table is a set of links no larger than the input, minima
    are combined before the shuffle, and each round is cut off in shared storage. Null ends and
    self links are ignored; an empty table gives no rows.
    """
    links = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a != b")
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # larger neighbours of every node meet the smallest of its neighbourhood
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("n"), "m")
        large = links.join(least, links["b"] == least["n"]).select("a", F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # smaller neighbours of every node meet the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, large["a"] == least["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("n", "m")).where("a != b").distinct()
        following = cut(small)
        mark = lambda x: x.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark(following) == mark(links):
            return following.select(F.col("a").alias("node"), F.col("b").alias("component")).union(following.select(F.col("b"), F.col("b")).distinct())
        links = following
        del both, least, large, small, following
        release(links.sparkSession)
