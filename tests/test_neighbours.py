"""Nearest-neighbour regression against all pairs."""

import random

import pytest

from tidebook.operators import neighbours

SCHEMA = "key long, fold int, weight long, value double, x array<double>, c array<long>"


def by_hand(rows, k):
    out = {}
    for key, fold, weight, value, x, c in rows:
        near = sorted(
            (sum((a - b) * (a - b) for a, b in zip(x, r[4], strict=True)) + 2.0 * sum(a != b for a, b in zip(c, r[5], strict=True)), r[0], r[2], r[3])
            for r in rows
            if r[1] != fold
        )
        total, taken = 0.0, 0
        for _, _, w, v in near:
            n = min(w, k - taken)
            total, taken = total + n * v, taken + n
            if taken == k:
                break
        out[key] = total / taken if taken else None
    return out


def clouds(n, folds, seed):
    """Clustered points, some alone, some equal in all features."""
    rng = random.Random(seed)
    rows = []
    for key in range(n):
        kind = rng.random()
        if kind < 0.2:
            x, c = [0.5, 0.5], [1, 1]
        elif kind < 0.9:
            at = rng.randrange(6)
            x, c = [at / 6 + rng.random() / 50, rng.random() / 9], [at % 3, rng.randrange(3)]
        else:
            x, c = [rng.random(), rng.random()], [rng.randrange(9), rng.randrange(9)]
        # folds follow the clusters, so that near cells often hold the own fold only
        fold = int(x[0] * folds) % folds if rng.random() < 0.8 else rng.randrange(folds)
        rows.append((key, fold, rng.choice([1, 1, 2, 5]), float(rng.randrange(40)), x, c))
    return rows


@pytest.mark.parametrize("leaf_rows, fan, k, n", [(16, 3, 3, 600), (40, 8, 5, 600), (1024, 32, 3, 60), (4, 2, 1, 80)])
def test_equal_to_all_pairs(spark, leaf_rows, fan, k, n):
    rows = clouds(n, 4, leaf_rows)
    data = spark.createDataFrame(rows, SCHEMA)
    found = {r["key"]: r["prediction"] for r in neighbours.nearest_mean(data, 2, 2, 4, k, leaf_rows, fan).collect()}
    assert found == pytest.approx(by_hand(rows, k))


def test_cells_are_split_and_pruned(spark):
    rows = [(i, i % 2, 1, 1.0, [i / 3000, 0.0], [0]) for i in range(3000)]
    refs = spark.createDataFrame(rows, SCHEMA)
    tree = neighbours.CellTree(refs, 2, 1, 2, 100, 8)
    assert tree.levels and max(r["count"] for r in tree.leaves.groupBy("cell").count().collect()) <= 100
    queries = refs.selectExpr("key AS q", "x", "c", "fold")
    home = tree.home(queries, 3).withColumnRenamed("cell", "home")
    seen = tree.visits(home.withColumn("reach", neighbours.F.lit(0.002))).count()
    assert seen < 3000 * 2  # of some 60 leaves


def test_few_and_missing(spark):
    one_fold = spark.createDataFrame([(1, 0, 1, 2.0, [0.1], [1]), (2, 0, 1, 4.0, [0.2], [1])], SCHEMA)
    assert {r["prediction"] for r in neighbours.nearest_mean(one_fold, 1, 1, 2).collect()} == {None}
    two = one_fold.union(spark.createDataFrame([(3, 1, 1, 6.0, [0.2], [1])], SCHEMA))
    assert {r["key"]: r["prediction"] for r in neighbours.nearest_mean(two, 1, 1, 2).collect()} == {1: 6.0, 2: 6.0, 3: 3.0}
    assert neighbours.nearest_mean(two.limit(0), 1, 1, 2).count() == 0
    raw = spark.createDataFrame([(1, 0, 1, 2.0, 5.0, "a"), (2, 1, 1, 3.0, None, "a"), (3, 1, 1, 4.0, 9.0, "b")], "k long, f int, w int, v double, size double, place string")
    made = {r["key"]: r["x"] for r in neighbours.points(raw, "k", "f", "w", "v", ["size"], ["place"]).collect()}
    assert made == {1: [0.0], 3: [1.0]}


def test_only_groups_in_reach_are_searched(spark, monkeypatch):
    """Points that share their categories with others at hand meet those, not all cells of the tree."""
    rng = random.Random(5)
    rows = [(i, i % 4, 1, float(i % 7), [rng.random() / 2], [i // 4 % 40, i // 160 % 30]) for i in range(4800)]
    met = []
    inner = neighbours._search

    def counted(k, dims, categories, schema):
        met.append(categories)
        return inner(k, dims, categories, schema)

    monkeypatch.setattr(neighbours, "_search", counted)
    data = spark.createDataFrame(rows, SCHEMA)
    found = {r["key"]: r["prediction"] for r in neighbours.nearest_mean(data, 1, 2, 4, 3, 64, 8).collect()}
    assert len(met) == 1  # one round, no second search
    few = rows[:160] + [r for r in rows[160:] if r[5][0] == 0]
    want = by_hand(few, 3)
    assert all(found[r[0]] == pytest.approx(want[r[0]]) for r in rows[:160])
