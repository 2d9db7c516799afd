"""Exact nearest-neighbour regression by a tree of pivot cells.

Points have numeric features, compared by their difference, and categories, compared as one-hot
vectors: two different values are sqrt(2) apart. Points that agree in a set of categories form a
group, and a search looks first at the groups of all categories, then at those of all but one, and so on, as
long as a point that differs in so many can still be among the nearest. Inside a group only the numeric
features tell points apart. They are a metric, so a cell of points around a pivot can be passed over
by the triangle inequality. Groups and cells are split until they are small, each search is one
cell against the points that must see it, and no pair is formed that the inequality excludes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidebook.sources.settle import settle, small_side

LEAF_ROWS = 1024
FAN = 32
#: Points that one task holds against one cell; more of them are dealt over several copies of the cell.
VISITS = 20_000
ROOT = "0"


def points(data: DataFrame, key: str, fold: str, weight: str, value: str, numeric: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(key, fold, weight, value, x, c): numeric features scaled to 0..1, categories as hashes of their text.

    Rows with a missing feature, value or fold are left out. A constant feature is 0.
    """
    used = data.dropna(subset=[key, fold, weight, value, *numeric, *categories])
    ends = used.agg(F.struct(*[F.min(F.col(c).cast("double")).alias(f"l{i}") for i, c in enumerate(numeric)], *[F.max(F.col(c).cast("double")).alias(f"h{i}") for i, c in enumerate(numeric)]).alias("e"))
    framed = used.withColumn("_e", ends.scalar())
    low, high = (lambda i: F.col(f"_e.l{i}")), (lambda i: F.col(f"_e.h{i}"))
    scaled = [F.when(high(i) > low(i), (F.col(c).cast("double") - low(i)) / (high(i) - low(i))).otherwise(0.0) for i, c in enumerate(numeric)]
    return framed.select(
        F.col(key).alias("key"), F.col(fold).cast("int").alias("fold"), F.col(weight).cast("long").alias("weight"), F.col(value).cast("double").alias("value"),
        F.array(*scaled).cast("array<double>").alias("x"),
        F.array(*[F.xxhash64(F.col(c).cast("string")) for c in categories]).cast("array<long>").alias("c"),
    )


def _distance(x: Column, c: Column, px: Column, pc: Column, dims: int, categories: int) -> Column:
    total: Column = F.lit(0.0)
    for j in range(dims):
        total = total + (x[j] - px[j]) * (x[j] - px[j])
    for j in range(categories):
        total = total + F.when(c[j] != pc[j], F.lit(2.0)).otherwise(F.lit(0.0))
    return F.sqrt(total)


class CellTree:
    """Reference points in leaves of at most ``leaf_rows``, and for each level the children of its cells.

    A child has its pivot, the least and greatest distance of its points to it, and their weight in
    each fold. Points may come with the cell they begin in, else it is one for all. Without
    ``categories`` only the numeric features count. Points that are equal in all features share a leaf;
    with ``first`` only so many of each fold by key are kept in a cell that is split, since no search
    can need more, so a leaf that can't be split is small.
    """

    def __init__(self, refs: DataFrame, dims: int, categories: int, folds: int, leaf_rows: int, fan: int, first: int | None = None):
        self.dims, self.categories = dims, categories
        self.levels: list[DataFrame] = []
        leaves = []
        cells = refs if "cell" in refs.columns else refs.withColumn("cell", F.lit(ROOT))
        while True:
            large = small_side(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows).select("cell"))
            if large.isEmpty():
                leaves.append(cells)
                break
            leaves.append(cells.join(large, "cell", "left_anti"))
            split = cells.join(large, "cell", "left_semi")
            if first is not None and not self.levels:
                equal = W.partitionBy("cell", "x", "fold").orderBy("key", "value", "weight")
                split = split.withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= first).drop("_n")
            placed = settle(self._placed(split, fan))
            self.levels.append(settle(self._children(placed, folds)))
            cells = placed.withColumn("cell", F.col("child")).drop("child", "d", "px", "pc")
        whole = leaves[0]
        for part in leaves[1:]:
            whole = whole.unionByName(part)
        self.leaves = whole

    def _placed(self, split: DataFrame, fan: int) -> DataFrame:
        """The points with their nearest pivot's cell; pivots are the vectors of a cell with the smallest hashes."""
        order = W.partitionBy("cell").orderBy(F.xxhash64("x", "c"), "x", "c")
        vector = "c" if self.categories else F.lit(None).cast("array<long>").alias("c")
        chosen = split.select("cell", "x", vector).distinct().withColumn("p", F.row_number().over(order)).where(F.col("p") <= fan)
        pivots = chosen.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("p", "x", "c"))).alias("pivots"))
        measure = lambda p: F.struct(_distance(F.col("x"), F.col("c"), p["x"], p["c"], self.dims, self.categories).alias("d"), p["p"].alias("p"), p["x"].alias("px"), p["c"].alias("pc"))
        near = split.join(small_side(pivots), "cell").withColumn("_n", F.array_min(F.transform("pivots", measure)))
        return near.select(*split.columns, F.concat("cell", F.lit("."), F.col("_n.p")).alias("child"), F.col("_n.d").alias("d"), F.col("_n.px").alias("px"), F.col("_n.pc").alias("pc"))

    def _children(self, placed: DataFrame, folds: int) -> DataFrame:
        """(cell, children): at most ``fan`` children of every split cell."""
        weights = F.array(*[F.sum(F.when(F.col("fold") == f, F.col("weight")).otherwise(0)) for f in range(folds)])
        one = placed.groupBy(F.col("cell").alias("parent"), "child").agg(
            F.any_value("px").alias("x"), F.any_value("pc").alias("c"), F.min("d").alias("low"), F.max("d").alias("high"), weights.alias("weights")
        )
        return one.groupBy("parent").agg(F.collect_list(F.struct("child", "x", "c", "low", "high", "weights")).alias("children"))

    def _to(self, child: Column) -> Column:
        return _distance(F.col("x"), F.col("c"), child["x"], child["c"], self.dims, self.categories)

    @staticmethod
    def _outside(child: Column) -> Column:
        """Weight of a child's points in other folds than the row's."""
        return F.aggregate(child["weights"], F.lit(0).cast("long"), lambda a, w: a + w) - F.get(child["weights"], F.col("fold"))

    def home(self, queries: DataFrame, k: int) -> DataFrame:
        """The queries with a cell and a distance within which k points of other folds surely lie.

        Each begins in its ``group``, if it has one, and goes down to the nearest child that holds so many.
        The cell is its leaf, or null where no child of the last one does. A smaller ``reach`` of its own stays.
        """
        own = [c for c in queries.columns if c != "reach"]
        front = queries.withColumns({"cell": self._start(queries), "reach": F.col("reach") if "reach" in queries.columns else F.lit(float("inf"))})
        for level in self.levels:
            met = front.join(small_side(level), F.col("cell") == F.col("parent"), "left")
            known = lambda ch: F.struct(self._to(ch).alias("d"), ch["child"].alias("child"), ch["high"].alias("high"))
            best = F.array_min(F.transform(F.filter("children", lambda ch: self._outside(ch) >= k), known))
            met = met.withColumn("_b", best)
            cell = F.when(F.col("parent").isNull(), F.col("cell")).otherwise(F.col("_b.child"))
            reach = F.when(F.col("_b").isNull(), F.col("reach")).otherwise(F.least("reach", F.col("_b.d") + F.col("_b.high")))
            front = met.select(*own, cell.alias("cell"), reach.alias("reach"))
        return front

    @staticmethod
    def _start(queries: DataFrame) -> Column:
        return F.col("group") if "group" in queries.columns else F.lit(ROOT)

    def visits(self, queries: DataFrame) -> DataFrame:
        """A row for every query and leaf that may hold a point within its ``reach``, but for its ``home`` leaf."""
        front = queries.withColumn("cell", self._start(queries))
        slack = F.col("reach") * (1 + 1e-9) + 1e-9
        for level in self.levels:
            met = front.join(small_side(level), F.col("cell") == F.col("parent"), "left")
            near = lambda ch: (self._to(ch) - ch["high"] <= slack) & (ch["low"] - self._to(ch) <= slack) & (self._outside(ch) > 0)
            cells = F.when(F.col("parent").isNull(), F.array("cell")).otherwise(F.transform(F.filter("children", near), lambda ch: ch["child"]))
            front = met.select(*queries.columns, F.explode(cells).alias("cell"))
        return front.where(F.col("home").isNull() | (F.col("cell") != F.col("home")))


def _search(k: int, dims: int, categories: int, schema: pa.Schema):
    """Each cell's points, then its queries, as they come sorted: the first k points of other folds by distance and key.

    A query's points agree with it in the categories whose bits ``agree`` has, and in no other. Its
    ``reach`` is numeric.
    """

    def matrix(batch: pa.RecordBatch, name: str, width: int, kind) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        refs: tuple | None = None
        current = None
        for data in batches:
            names = list(zip(data.column("cell").to_pylist(), data.column("copy").to_pylist(), data.column("asks").to_pylist(), strict=True))
            at = 0
            while at < len(names):
                end = at
                while end < len(names) and names[end] == names[at]:
                    end += 1
                part = data.slice(at, end - at)
                cell, copy, asks = names[at]
                at = end
                if (cell, copy) != current:
                    current, held, refs = (cell, copy), [], None
                x, c = matrix(part, "x", dims, float), matrix(part, "c", categories, np.int64)
                fold = part.column("fold").to_numpy()
                if not asks:
                    held.append((part.column("key"), fold, part.column("weight").to_numpy(), part.column("value").to_numpy(), x, c))
                    continue
                if not held:
                    continue
                if refs is None:
                    keys = pa.concat_arrays([h[0] for h in held])
                    order = np.asarray(pa.compute.sort_indices(keys))
                    refs = (keys.take(pa.array(order)), *[np.concatenate([h[i] for h in held])[order] for i in range(1, 6)])
                yield from found(refs, part, fold, x, c)

    def found(refs: tuple, part: pa.RecordBatch, fold: np.ndarray, x: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, folds, weights, values, rx, rc = refs
        reach = part.column("reach").to_numpy() * (1 + 1e-9) + 1e-9
        asked = part.column("q").to_numpy()
        agree = part.column("agree").to_numpy()
        for at in range(0, len(x), 1024):
            some = slice(at, at + 1024)
            d = np.zeros((len(x[some]), len(rx)))
            for j in range(dims):
                apart = x[some, j, None] - rx[None, :, j]
                d += apart * apart
            out = (fold[some, None] == folds[None, :]) | (d > (reach[some] * reach[some])[:, None])
            missed = np.zeros(len(d))
            for j in range(categories):
                same = (agree[some] >> j & 1).astype(bool)
                out |= (c[some, j, None] == rc[None, :, j]) != same[:, None]
                missed += ~same
            d += 2.0 * missed[:, None]
            d[out] = np.inf
            most = min(k, len(rx))
            limit = np.partition(d, most - 1, axis=1)[:, most - 1]
            rows, cols = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
            order = np.lexsort((cols, d[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cols = rows[place < k], cols[place < k]
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked[some][rows]), pa.array(d[rows, cols]), keys.take(pa.array(cols)), pa.array(weights[cols]), pa.array(values[cols])], schema=schema
                )

    return run


def _meet(tree: CellTree, asks: DataFrame, k: int, categories: int) -> DataFrame:
    """(q, d, key, weight, value): of each visited leaf the first k points within reach, d squared, all features counted.

    Where many queries visit one leaf, the leaf is copied and the queries are dealt over the copies.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = asks.sparkSession
    copies = small_side(asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("copies")))
    columns = ("cell", "copy", "asks", "q", "agree", "reach", "key", "fold", "weight", "value", "x", "c")
    types = {f.name: f.dataType for f in tree.leaves.schema.fields}
    refs = tree.leaves.join(copies, "cell").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    refs = refs.withColumns({"asks": F.lit(False), "q": F.lit(None).cast("long"), "agree": F.lit(None).cast("int"), "reach": F.lit(None).cast("double")}).select(*columns)
    asked = asks.join(copies, "cell").withColumn("copy", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int"))
    asked = asked.withColumns({"asks": F.lit(True), "key": F.lit(None).cast(types["key"]), "weight": F.lit(None).cast("long"), "value": F.lit(None).cast("double")}).select(*columns)
    ddl = f"q long, d double, key {types['key'].simpleString()}, weight long, value double"
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    dealt = refs.union(asked).repartition("cell", "copy").sortWithinPartitions("cell", "copy", "asks")
    return dealt.mapInArrow(_search(k, tree.dims, categories, schema), ddl)


def _grouped(frame: DataFrame, categories: int, missing: int, name: str) -> DataFrame:
    """A row for every choice of all categories but ``missing``: its bits as ``agree``, its values' group as ``name``."""
    some = [(sum(1 << j for j in kept), kept) for kept in combinations(range(categories), categories - missing)]
    choices = [F.struct(F.lit(bits).alias("agree"), F.concat(F.lit(f"{bits}:"), F.xxhash64(F.lit(bits), *[F.col("c")[j] for j in kept]).cast("string")).alias(name)) for bits, kept in some]
    return frame.withColumn("_g", F.explode(F.array(*choices))).select(*frame.columns, "_g.*")


def nearest_mean(data: DataFrame, dims: int, categories: int, folds: int, k: int = 3, leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> DataFrame:
    """``points`` rows with their prediction: the mean value of the k nearest rows of other folds.

    A point of weight w is w equal rows. Nearer points come first, of equally near ones the lower
    key; the last one counts as often as rows are missing up to k. Without any point of another fold
    the prediction is null. Exact: a round finds the points that differ in ``missing`` categories, each
    in the one group of those it shares with the query, for all queries whose k-th row so far is
    as far as such a point can be near. In a group a first search in a near cell bounds the distance of
    the k-th row, and every cell that the triangle inequality does not exclude is searched.
    ``folds`` is their number, counted from 0.
    """
    first = W.partitionBy("x", "c", "fold").orderBy("key", "value", "weight")
    refs = settle(data.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n"))
    queries = settle(data.select("x", "c", "fold").distinct().withColumn("q", F.monotonically_increasing_id()))
    before = lambda *order: F.coalesce(F.sum("weight").over(W.partitionBy("q").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nearest = lambda found: found.withColumn("_b", before("d", "key")).where(F.col("_b") < k)
    third = lambda found: nearest(found).groupBy("q").agg(F.when(F.sum("weight") >= k, F.max("d")).alias("third"))
    every, open_ = None, queries.withColumn("third", F.lit(None).cast("double"))
    for missing in range(categories + 1):
        least = 2.0 * missing
        within = F.sqrt(F.greatest(F.coalesce("third", F.lit(float("inf"))) - least, F.lit(0.0)))
        asks = _grouped(open_.withColumn("reach", within).drop("third"), categories, missing, "group")
        around = _grouped(refs, categories, missing, "cell").drop("agree")
        if missing > 1:  # few queries are left, and their groups
            around = around.join(small_side(asks.select(F.col("group").alias("cell")).distinct()), "cell", "left_semi")
        tree = CellTree(around, dims, 0, folds, leaf_rows, fan, k)
        home = settle(tree.home(asks, k))
        near = settle(_meet(tree, home.where(F.col("cell").isNotNull()), k, categories))
        every = near if every is None else every.union(near)
        if tree.levels:
            bounded = home.withColumnRenamed("cell", "home").join(third(every), "q", "left")
            closer = F.sqrt(F.greatest(F.coalesce("third", F.lit(float("inf"))) - least, F.lit(0.0)))
            bounded = settle(bounded.withColumn("reach", F.least("reach", closer)).drop("third"))
            every = every.union(_meet(tree, settle(tree.visits(bounded)), k, categories))
        every = settle(nearest(every).drop("_b"))
        open_ = settle(queries.join(third(every), "q", "left").where(F.col("third").isNull() | (F.col("third") >= least + 2)))
        if open_.isEmpty():
            break
    taken = F.least(F.col("weight"), F.lit(k) - F.col("_b"))
    means = nearest(every).groupBy("q").agg((F.sum(F.col("value") * taken) / F.sum(taken)).alias("prediction"))
    known = queries.join(means, "q", "left").drop("q")
    return data.join(known, ["x", "c", "fold"], "left").select("key", "fold", "weight", "value", "prediction")
