"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import cut
from tidebook.llm.graph import components
from tidebook.llm.grouped import forest, runs_of

#: Vectors that the cluster centres are fitted on, and centres, at most.
SAMPLE_ROWS, MOST_CENTRES = 20_000, 1024
#: Mean number of vectors per centre, and rows of a shard that form one block of the index.
PER_CENTRE, BLOCK = 500, 2048
#: Neighbours kept by pruning, candidates that are pruned, and how much nearer a neighbour must be to stand for another.
DEGREE, POOL, ALPHA = 16, 48, 1.2
#: Queries that are searched side by side.
SIDE = 256


def unit_rows(lists: pa.Array) -> np.ndarray:
    """Vectors as rows of length 1, in double precision."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def centres_of(sample: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _assign(centres, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = unit_rows(batch.column(1)) @ centres.value.T
            homes = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :overlap], axis=1).astype(np.int32)
            offsets = pa.array(np.arange(0, homes.size + 1, homes.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(homes.reshape(-1)))], names=["rep", "embedding", "copies", "homes"])

    return run


def pruned(near: np.ndarray) -> list[np.ndarray]:
    """Neighbours of every row of a cosine matrix: robust pruning of the nearest POOL, both ways.

    A neighbour goes if one kept before it is ALPHA times nearer to it than the row itself is.
    Then every row is made reachable from the medoid, over the nearest pair of what is reached and
    what is not.
    """
    n = len(near)
    if n == 1:
        return [np.zeros(0, np.int64)]
    work = near.copy()
    np.fill_diagonal(work, -2)
    pool = min(POOL, n - 1)
    nearest = np.argpartition(-work, pool - 1, axis=1)[:, :pool]
    nearest = np.take_along_axis(nearest, np.argsort(-np.take_along_axis(work, nearest, 1), axis=1, kind="stable"), 1)
    away = 1 - np.take_along_axis(near, nearest, 1)
    alive, rows = np.ones(nearest.shape, bool), np.arange(n)
    picked = np.full((n, DEGREE), -1)
    for k in range(DEGREE):
        some = alive.any(1)
        first = alive.argmax(1)
        chosen = nearest[rows, first]
        picked[some, k] = chosen[some]
        alive &= ~(ALPHA * (1 - near[chosen[:, None], nearest]) <= away)
        alive[rows, first] = False
    source, place = np.nonzero(picked >= 0)
    goal = picked[source, place]
    back = np.lexsort((-near[source, goal], goal))
    turn = np.arange(len(back)) - np.searchsorted(goal[back], goal[back])
    back = back[turn < DEGREE]
    links = {*zip(source.tolist(), goal.tolist(), strict=True), *zip(goal[back].tolist(), source[back].tolist(), strict=True)}
    out: list[set[int]] = [set() for _ in range(n)]
    for a, b in links:
        out[a].add(b)
    reached = np.zeros(n, bool)

    def walk(start: int) -> None:
        stack = [start]
        reached[start] = True
        while stack:
            for b in out[stack.pop()]:
                if not reached[b]:
                    reached[b] = True
                    stack.append(b)

    walk(medoid(near))
    while not reached.all():
        far = np.flatnonzero(~reached)[0]
        close = np.where(reached, near[far], -2).argmax()
        out[close].add(int(far))
        walk(int(far))
    return [np.fromiter(x, np.int64, len(x)) for x in out]


def medoid(near: np.ndarray) -> int:
    """The row with the largest sum of cosines."""
    return int(near.sum(1).argmax())


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacency lists of each (shard, block)."""
    for block in runs_of(batches, 2):
        reps, vectors = block.column(2).to_numpy(), unit_rows(block.column(3)).astype(np.float32)
        lists = [reps[x] for x in pruned(vectors @ vectors.T)]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists), pa.int64()))], names=["rep", "near"])


class FlatGraph:
    """Vectors with adjacency lists, searched greedily from the medoid and then by range."""

    def __init__(self, vectors: np.ndarray, lists: list[np.ndarray]) -> None:
        self.vectors = vectors
        self.lists = np.full((len(lists), max(1, max(map(len, lists)))), -1)
        for i, x in enumerate(lists):
            self.lists[i, : len(x)] = x
        mean = vectors.mean(0)
        self.entry = int((vectors @ mean).argmax())

    def search(self, queries: np.ndarray, least: float, beam: int) -> np.ndarray:
        """For each query the rows found with cosine of ``least`` or more.

        The best unexpanded of a beam is expanded until the whole beam is; then every row within
        the range, and every row newly found within it, is expanded too.
        """
        count, n = len(queries), len(self.vectors)
        seen, found = np.zeros((count, n), bool), np.zeros((count, n), bool)
        ids, near = np.full((count, beam), -1), np.full((count, beam), -2, np.float32)
        done = np.ones((count, beam), bool)
        ids[:, 0], done[:, 0], seen[:, self.entry] = self.entry, False, True
        near[:, 0] = queries @ self.vectors[self.entry]
        found[:, self.entry] = near[:, 0] >= least
        expanded = np.zeros((count, n), bool)
        while True:
            open_rows = np.flatnonzero(~done.all(1))
            if not len(open_rows):
                break
            best = np.where(done[open_rows], -3, near[open_rows]).argmax(1)
            done[open_rows, best] = True
            node = ids[open_rows, best]
            expanded[open_rows, node] = True
            fresh = self.lists[node]
            new = (fresh >= 0) & ~seen[open_rows[:, None], fresh]
            row, place = np.nonzero(new)
            goal, query = fresh[row, place], open_rows[row]
            seen[query, goal] = True
            value = np.full(fresh.shape, -2, np.float32)
            value[row, place] = np.einsum("ij,ij->i", queries[query], self.vectors[goal])
            found[query, goal] = value[row, place] >= least
            all_ids, all_near = np.hstack([ids[open_rows], np.where(new, fresh, -1)]), np.hstack([near[open_rows], value])
            all_done = np.hstack([done[open_rows], ~new])
            top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            ids[open_rows], near[open_rows], done[open_rows] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_near, all_done))
        while True:
            query, node = np.nonzero(found & ~expanded)
            if not len(query):
                return found
            expanded[query, node] = True
            for at in range(0, len(query), 1 << 14):
                q, goal = query[at : at + (1 << 14), None], self.lists[node[at : at + (1 << 14)]]
                new = (goal >= 0) & ~seen[q, goal]
                row, place = np.nonzero(new)
                pair = np.unique(q[row, 0] * n + goal[row, place])
                one, other = pair // n, pair % n
                seen[one, other] = True
                found[one, other] = np.einsum("ij,ij->i", queries[one], self.vectors[other]) >= least


def _search(least: float, beam: int):
    """Of each (shard, i, j), block i's vectors looked for in block j: links, verified and counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, links, towards = [], [], []
        for block in runs_of(batches, 3):
            shard, i, j = (block.column(c)[0].as_py() for c in range(3))
            reps, own, copies = (block.column(c).to_numpy() for c in (3, 4, 5))
            homes = np.stack(block.column(6).combine_chunks().to_numpy(zero_copy_only=False))
            exact = unit_rows(block.column(7))
            vectors = exact.astype(np.float32)
            index, asking = np.flatnonzero(own == j), np.flatnonzero(own == i)
            if not len(index) or not len(asking):
                continue
            place = {r: k for k, r in enumerate(reps[index].tolist())}
            lists = [np.array([place[x] for x in block.column(8)[int(k)].as_py() if x in place], np.int64) for k in index]
            graph = FlatGraph(vectors[index], lists)
            linked = np.zeros((len(reps), len(reps)), bool)
            for at in range(0, len(asking), SIDE):
                some = asking[at : at + SIDE]
                q, x = np.nonzero(graph.search(vectors[some], least - 1e-4, beam))
                linked[some[q], index[x]] = True
            linked |= linked.T
            a, b = np.nonzero(np.triu(linked, 1))
            cosine = np.concatenate([np.einsum("ij,ij->i", exact[a[k : k + 65536]], exact[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)])
            linked[a[cosine < least], b[cosine < least]] = linked[b[cosine < least], a[cosine < least]] = False
            a, b = a[cosine >= least], b[cosine >= least]
            # a pair that meets in several shards counts in the first of them
            counted = np.zeros(len(a), bool)
            for k in range(0, len(a), 65536):
                both = (homes[a[k : k + 65536], :, None] == homes[b[k : k + 65536], None, :]).any(2)
                counted[k : k + 65536] = np.where(both, homes[a[k : k + 65536]], np.iinfo(np.int32).max).min(1) == shard
            total = np.zeros(len(reps), np.int64)
            np.add.at(total, a[counted], copies[b[counted]])
            np.add.at(total, b[counted], copies[a[counted]])
            joined = np.flatnonzero(linked.any(1))
            root = joined[forest(linked[np.ix_(joined, joined)])] if len(joined) else joined
            nodes += reps[joined].tolist()
            links += total[joined].tolist()
            towards += reps[root].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, links, towards)], names=["rep", "links", "towards"])

    return run


def _brute(sample, least: float):
    """For each sampled vector, how many rows are within the range, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sample.value), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += ((sample.value @ unit_rows(batch.column(0)).T) >= least) @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["number", "within"])

    return run


def _graph_links(vectors: DataFrame, sample: np.ndarray, rows: int, least: float, overlap: int, beam: int, seed: int) -> DataFrame:
    """(rep, links, towards) for one dimension of vectors: build, union, search, verify."""
    spark = vectors.sparkSession
    k = max(1, min(math.ceil(rows / PER_CENTRE), MOST_CENTRES, len(sample)))
    centres = spark.sparkContext.broadcast(centres_of(sample, k, seed))
    kind = "rep long, embedding array<float>, copies long, homes array<int>"
    assigned = vectors.select("rep", "embedding", "copies").mapInArrow(_assign(centres, min(overlap, k)), kind)
    placed = assigned.withColumn("shard", F.explode("homes"))
    sizes = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = cut(placed.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    blocks = placed.select("shard", "block", "rep", "embedding").repartition("shard", "block").sortWithinPartitions("shard", "block", "rep")
    lists = blocks.mapInArrow(_build, "rep long, near array<long>")
    union = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    known = placed.join(union, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    known = known.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "block", "copies", "homes", "embedding", "near")
    dealt = known.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "rep")
    return cut(dealt.mapInArrow(_search(least, beam), "rep long, links long, towards long"))


def near_vectors(
    table: DataFrame, least: float = 0.9, overlap: int = 3, beam: int = 32, audit_rows: int = 400, least_recall: float = 0.9, attempts: int = 3, seed: int = 3
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are merged. Cluster centres, fitted on SAMPLE_ROWS vectors at most, put every
    vector into its ``overlap`` nearest shards; each block of a shard gets a graph by robust
    pruning of nearest neighbours, and the adjacency lists of all blocks are united per vector.
    Every vector is then looked for in its shards: greedily from the medoid, then expanding all
    that is in range. What is found is verified by cosine in double precision, so no link is false.
    A shard beyond BLOCK rows is several blocks and each pair of them is searched, so a crowd of near
    copies meets whole without meeting in one task. At last ``audit_rows`` vectors, those with the
    smallest hashes, are compared with all vectors; if less than ``least_recall`` of their links were
    found, overlap and beam are doubled, at most ``attempts`` times, and then it is an error.

    Vectors that are null or zero or hold null or non-finite components are linked with nothing and
    kept, as are rows without vec_id; vectors of different lengths are never linked. Repeated rows are
    links of each other. An empty table gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    vector = F.col("embedding").cast("array<float>")
    fine = F.col("vec_id").isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    read = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
    read = read.withColumn("key", F.when(F.col("fine"), F.xxhash64("embedding")))
    merged = read.where("fine").groupBy("embedding", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    merged = cut(merged.withColumn("dim", F.size("embedding")))
    links = None
    for r in merged.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        same = merged.where(F.col("dim") == r["dim"])
        first = same.select("rep", "embedding").orderBy(F.xxhash64(F.lit(seed), "rep"), "rep")
        rows = first.limit(SAMPLE_ROWS).toArrow()
        sample = unit_rows(rows.column(1))
        asked, ids = sample[:audit_rows], rows.column(0).to_pylist()[:audit_rows]
        counts = same.select("embedding", "copies").mapInArrow(_brute(spark.sparkContext.broadcast(asked), least), "number long, within long")
        truth = {x["number"]: x["within"] for x in counts.groupBy("number").agg(F.sum("within").alias("within")).collect()}
        for attempt in range(attempts):
            found = _graph_links(same, sample, r["n"], least, overlap << attempt, beam << attempt, seed)
            named = spark.createDataFrame(list(enumerate(ids)), "number long, rep long")
            got = named.join(same.select("rep", "copies"), "rep").join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
            own, links_found = got.agg(F.sum("copies"), F.sum(F.coalesce("links", F.lit(0)))).first()
            true_links = sum(truth.values()) - own
            recall = links_found / true_links if true_links else 1.0
            if recall >= least_recall:
                break
        else:
            raise ValueError(f"the graph finds {recall:.3f} of the links, less than {least_recall}")
        links = found if links is None else links.union(found)
    if links is None:
        alone = F.lit(0).cast("long").alias("n_links")
        return read.select("vec_id", alone, F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(links, "rep", "towards")
    of_vector = merged.select("embedding", "key", "rep", "copies").join(counted, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    of_vector = of_vector.select(
        F.col("embedding").alias("_v"), F.col("key").alias("_k"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    out = read.join(of_vector, (F.col("key") == F.col("_k")) & (F.col("embedding") == F.col("_v")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
