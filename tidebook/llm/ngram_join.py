"""Similarity join of documents on word shingles: chosen paths find candidates, exact sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import cut, free_name, release
from tidebook.llm.graph import components
from tidebook.llm.grouped import forest, runs_of

#: Tokens drawn from each set by as many hash functions; a path is a sequence of such draws.
DRAWS = 64
#: Buckets up to this size are compared pair by pair, larger ones split on.
BUCKET = 128
#: Paths end after so many draws; who is still together then is compared exactly.
LONGEST_PATH = 8
#: A candidate's share of equal draws may lie so far below the threshold (five deviations).
SLACK = 0.25
#: Members of a candidate component are compared in blocks of about this size, and of about so many shingles.
BLOCK, BLOCK_SHINGLES = 1000, 1 << 19
#: Columns of a block's membership matrix that are held at once.
COLUMNS = 1 << 13
#: Up to so many rows of ids go to every executor, at 32 bytes each; more are shuffled.
BROADCAST_ROWS = 50_000

_U = np.uint64
_rng = np.random.default_rng(20)
_MULTIPLY, _ADD = _rng.integers(0, 2**63, DRAWS, dtype=_U) * _U(2) + _U(1), _rng.integers(0, 2**63, DRAWS, dtype=_U)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables = {"up": _powers(_BASE, 1 << 14), "down": _powers(_INVERSE, 1 << 14)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def normalised(text: str) -> bytes:
    """Words between single spaces."""
    return b" ".join(text.encode("utf-8", "replace").split())


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words; a shorter text is one run."""
    if not text:
        return np.zeros(0, _U)
    letters = np.frombuffer(text, np.uint8)
    if len(letters) >= len(_tables["up"]):
        size = 1 << (len(letters) + 1).bit_length()
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    gaps = np.flatnonzero(letters == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(letters)]))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((letters.astype(_U) + _U(1)) * _tables["up"][: len(letters)], dtype=_U)))
    word = _mix((sums[ends] - sums[starts]) * _tables["down"][starts] + (ends - starts).astype(_U))
    n = min(words, len(word))
    total = np.zeros(len(word) - n + 1, _U)
    for k in range(n):
        total += word[k : len(word) - n + 1 + k] * _tables["up"][k + 1]
    return np.unique(_mix(total + _U(n)))


def draws(hashes: np.ndarray) -> np.ndarray:
    """For each hash function the smallest hash of the set, its upper half."""
    least = np.full(DRAWS, ~_U(0), _U)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * _MULTIPLY + _ADD).min(0))
    return (least >> _U(32)).astype(np.uint32).view(np.int32)


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts, drawn = [], [], np.zeros((batch.num_rows, DRAWS), np.int32)
            for i, text in enumerate(batch.column(2)):
                plain = normalised(text.as_py())
                hashes = shingles(plain, words)
                digests.append(xxhash.xxh3_128_digest(plain))
                counts.append(len(hashes))
                if len(hashes):
                    drawn[i] = draws(hashes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, drawn.size + 1, DRAWS), pa.int32()), pa.array(drawn.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), lists], names=["doc_id", "text_hash", "digest", "n", "draws"])

    return run


def _compare_buckets(least: float):
    """Links within each bucket, one for each row but the first of a connected part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for bucket in runs_of(batches, 1):
            nodes = bucket.column(1).to_numpy()
            drawn = np.stack(bucket.column(2).combine_chunks().to_numpy(zero_copy_only=False))
            root = forest((drawn[:, None, :] == drawn[None, :, :]).mean(2) >= least)
            far = np.flatnonzero(root != np.arange(len(root)))
            left += nodes[far].tolist()
            right += nodes[root[far]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def candidate_links(sets: DataFrame, threshold: float, recall: float, seed: int) -> DataFrame:
    """(a, b): links that join all sets which may be similar enough, by chosen paths.

    ``sets`` is (rep, draws). In every run each set follows paths: a path is extended by one draw
    position, or by two in one case of four, the same for all sets that are on it, and goes on to the
    token drawn there; so the sets on a path share all its tokens, and the expected number of paths that two
    sets at the threshold share does not fall. A path with one set ends. One with up to
    BUCKET sets is compared pair by pair on all draws; one with more is split further. The number of
    runs is such that two sets at the threshold meet with probability ``recall`` even if all
    their paths take three draws.
    """
    meet = 0.75 * threshold + 0.25 * (1 - (1 - threshold) ** 2)
    runs = math.ceil(math.log(1 - recall) / math.log(1 - meet**3))

    def extended(rows: DataFrame) -> DataFrame:
        first = F.pmod(F.xxhash64("path", F.lit("first")), F.lit(DRAWS)).cast("int")
        second = F.pmod(F.xxhash64("path", F.lit("second")), F.lit(DRAWS)).cast("int")
        two = F.pmod(F.xxhash64("path", F.lit("two")), F.lit(4)) == 0
        at = F.explode(F.when(two, F.array_distinct(F.array(first, second))).otherwise(F.array(first)))
        on = rows.select("path", "rep", "draws", at.alias("at"))
        return on.select(F.xxhash64("path", "at", F.element_at("draws", F.col("at") + 1)).alias("path"), "rep")

    start = F.explode(F.transform(F.sequence(F.lit(1), F.lit(runs)), lambda r: F.xxhash64(F.lit(seed), r)))
    frontier = extended(sets.select(start.alias("path"), "rep", "draws"))
    small, links = None, None
    for length in range(1, LONGEST_PATH + 1):
        frontier = cut(frontier)
        # stored, so that the join may split a path that many sets are on
        sizes = cut(frontier.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        placed = cut(frontier.join(sizes, "path"))
        here = placed.where(F.col("size") <= BUCKET).select("path", "rep")
        small = here if small is None else small.union(here)
        large = placed.where(F.col("size") > BUCKET).select("path", "rep")
        if large.isEmpty():
            break
        if length == LONGEST_PATH:
            heads = large.groupBy("path").agg(F.min("rep").alias("b"))
            links = large.join(heads, "path").select(F.col("rep").alias("a"), "b")
        else:
            frontier = extended(large.join(sets, "rep"))
            del sizes, placed, here, large
            release(sets.sparkSession)
    buckets = small.join(sets, "rep").select("path", "rep", "draws").repartition("path").sortWithinPartitions("path", "rep")
    found = buckets.mapInArrow(_compare_buckets(threshold - SLACK), "a long, b long")
    return found if links is None else found.union(links)


def intersections(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sorted sets, one matrix product at a time."""
    both = one + other
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    values, column, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = counts > 1
    renumbered = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], renumbered[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(one), len(other)), np.float32)
    edges = np.searchsorted(column, np.arange(0, shared.sum() + COLUMNS, COLUMNS))
    for k, (at, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        member = np.zeros((len(both), COLUMNS), np.float32)
        member[owner[at:end], column[at:end] - k * COLUMNS] = 1
        total += member[: len(one)] @ member[len(one) :].T
    return total


def _verify(words: int, threshold: float):
    """Of each pair of blocks (component, i, j): for every set its links there and a linked set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, links, towards = [], [], []
        for block in runs_of(batches, 3):
            reps, sides = block.column(3).to_numpy(), block.column(4).to_numpy()
            keep = np.concatenate(([True], reps[1:] != reps[:-1]))  # repeated rows
            sets = [shingles(normalised(x.as_py()), words) if k else None for x, k in zip(block.column(5), keep, strict=True)]
            sets = [x for x in sets if x is not None]
            reps, sides = reps[keep], sides[keep]
            within = block.column(1)[0].as_py() == block.column(2)[0].as_py()
            rows = np.arange(len(reps)) if within else np.flatnonzero(sides == sides.min())
            columns = rows if within else np.flatnonzero(sides != sides.min())
            if not len(columns):
                continue
            common = intersections([sets[i] for i in rows], [sets[i] for i in columns])
            size = np.array([len(x) for x in sets])
            linked = np.zeros((len(reps), len(reps)), bool)
            linked[np.ix_(rows, columns)] = common >= threshold * (size[rows][:, None] + size[columns][None, :] - common) - 1e-6
            linked |= linked.T
            np.fill_diagonal(linked, False)
            root = forest(linked)
            nodes += reps.tolist()
            links += linked.sum(1).tolist()
            towards += reps[root].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64()), pa.array(towards, pa.int64())], names=["rep", "links", "towards"])

    return run


def similar_documents(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.999, seed: int = 8) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, component_id, kept, digest.

    Texts in lower case with the same words in the same order are one class, named by its smallest
    doc_id and the digest of its words, as an id may stand for several texts. Two classes are linked if their sets of runs of ``words`` words (a shorter text is one
    run) have Jaccard similarity ``threshold`` or more; ``n_links`` counts the classes linked to
    that of the document, ``component_id`` is the smallest doc_id reachable by links, and kept is
    true for its text there (of several texts of that id in one component, for that of the smallest digest). Chosen paths find what may be linked, joining two classes at the threshold with
    probability ``recall`` or more; what they join into a component is then compared exactly, all
    pairs, block by block. So no link is false, and no cap is set on classes, buckets or components.

    Null texts, and texts without words, are linked with nothing and kept; so are rows without a
    doc_id, which get null ids. Repeated rows get equal rows; each text of an id is compared and
    linked for itself. An empty table gives no rows; other columns are not read.
    """
    return _similar(docs, words, threshold, recall, seed).drop("text_hash")


def _similar(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.999, seed: int = 8) -> DataFrame:
    """The same with text_hash, the hash of the row's text in lower case."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(F.col("text")).alias("text_hash"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    described = cut(read.mapInArrow(_describe(words), "doc_id long, text_hash long, digest binary, n int, draws array<int>"))
    usable = described.where("doc_id is not null and n > 0")
    classes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("draws").alias("draws"), F.first("n").alias("n"))
    # numbers of the classes within this run; stored, so that every use reads the same
    classes = cut(classes.select("digest", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash"), "draws", "n", F.monotonically_increasing_id().alias("node")))
    sets = classes.select(F.col("node").alias("rep"), "draws")
    near = components(candidate_links(sets, threshold, recall, seed))
    members = cut(near.join(classes.select("node", "n", F.col("rep").alias("_id"), F.col("rep_hash").alias("_h")), "node"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = cut(members.groupBy("component").agg(blocks.alias("blocks")))
    if sizes.count() <= BROADCAST_ROWS:  # or a large component would meet in one task
        sizes = F.broadcast(sizes)
    members = members.join(sizes, "component")
    members = cut(members.select(F.col("node").alias("rep"), "component", "blocks", "_id", "_h"))
    some = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = read.join(some, (F.col("doc_id") == F.col("_id")) & (F.col("text_hash") == F.col("_h"))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    sent = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "own", "text")
    dealt = sent.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "rep")
    checked = cut(dealt.mapInArrow(_verify(words, threshold), "rep long, links long, towards long"))
    links = checked.groupBy("rep").agg(F.sum("links").alias("n_links")).select(F.col("rep").alias("_node"), "n_links")
    groups = components(checked.where("links > 0"), "rep", "towards")
    named = classes.select("node", F.struct("rep", "digest").alias("name"))
    heads = groups.join(named, "node").groupBy("component").agg(F.min("name").alias("head"))
    heads = cut(heads)
    if heads.count() <= BROADCAST_ROWS:  # or a large component would meet in one task
        heads = F.broadcast(heads)
    groups = groups.join(heads, "component").select(F.col("node").alias("_member"), "head")
    of_class = classes.join(links, F.col("node") == F.col("_node"), "left").join(groups, F.col("node") == F.col("_member"), "left")
    of_class = of_class.select(F.col("digest").alias("_d"), F.col("rep"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("head", F.struct("rep", "digest")).alias("head"))
    out = described.join(of_class, (F.col("digest") == F.col("_d")) & F.col("doc_id").isNotNull() & (F.col("n") > 0), "left")
    kept = F.coalesce((F.col("doc_id") == F.col("head.rep")) & (F.col("digest") == F.col("head.digest")), F.lit(True))
    return out.select(
        "doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("head.rep", "doc_id").alias("component_id"), kept.alias("kept"), F.lower(F.hex("digest")).alias("digest"), "text_hash"
    )


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, as it is; repeated rows of one id and text leave one of them."""
    found = _similar(docs, **options)
    name, text, rows = free_name(docs.columns, "_id"), free_name(docs.columns, "_text"), free_name(docs.columns, "_rows")
    found = found.where("kept and doc_id is not null").groupBy("doc_id", "digest", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    # the texts of an id that differ in blanks only are one
    found = found.groupBy("doc_id", "digest").agg(F.min(F.struct("text_hash", "rows")).alias("x"))
    kept = cut(found.select(F.col("doc_id").alias(name), F.col("x.text_hash").alias(text), F.col("x.rows").alias(rows)))
    staying = docs.join(kept, (docs["doc_id"].cast("long") == kept[name]) & (_text_hash(docs["text"]) == kept[text]))
    single = staying.where(F.col(rows) == 1).drop(name, text, rows)
    repeated = staying.where(F.col(rows) > 1).dropDuplicates([name, text]).drop(name, text, rows)
    return single.union(repeated).union(docs.where("doc_id is null"))
