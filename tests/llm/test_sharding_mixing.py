"""Sharding and mixing against plain Python, with odd rows."""

import collections
import zlib

import corpus_pipeline

from tidebook.llm import mixing, sharding

ODD = [(1, "a b c", "x", 0), (1, "a b c", "x", 0), (2, None, "y", 1), (3, "", None, 2), (None, "d e", None, 3), (4, "w " * 3000, "x", 4)]
SCHEMA = "doc_id long, text string, source string, shard int"


def test_shards(frame):
    docs = frame(ODD + [(i, f"t{i}", "z", 0) for i in range(5, 800)], SCHEMA)
    rows = sharding.shard_plan(docs, [1.0] * 16).collect()
    assert len(rows) == len(ODD) + 795
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and len(by) == 16
    found = {r.doc_id: r for r in rows}
    assert (found[2].size, found[2].text_crc32, found[3].size) == (1, 0, 1)
    assert (found[1].size, found[1].text_crc32) == (6, zlib.crc32(b"a b c"))
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1


def test_weights_and_clashes(frame):
    docs = frame([(i, "t", "z", 99) for i in range(4000)], SCHEMA)
    placed = sharding.with_shard(docs, [3.0, 1.0, 0.0])
    assert placed.columns == ["doc_id", "text", "source", "shard"]
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    assert set(counts) == {0, 1} and abs(counts[0] - 3000) < 150


def test_empty_tables(frame):
    docs = frame([], SCHEMA)
    assert sharding.shard_plan(docs, [1.0, 1.0]).count() == 0
    assert mixing.mix(docs).count() == 0


def test_mix(frame):
    docs = frame(ODD + [(i, "u v " * (i % 7), f"s{i % 4}", 0) for i in range(10, 300)], SCHEMA)
    rows = mixing.mix(docs, shards=5, block_words=3).collect()
    assert len(rows) == docs.count()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    blocks = collections.defaultdict(set)
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.pieces)
        for p in r.pieces:
            blocks[r.source, p.block].add(p.shard)
    assert all(len(x) == 1 for x in blocks.values())  # shards draw disjoint blocks
    for s in size:
        assert abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * size[s] + 1e-9
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(3), shards=5, block_words=3).collect()))


def test_split_tree_deals_every_block_once(spark):
    quotas = [(1, 1000), (2, 0), (3, 37), (4, 5000)]
    ends = {r.i: r.ends for r in mixing.split_tree(spark.createDataFrame(quotas, "i int, n long"), 6).collect()}
    assert all(ends[i][-1] == n and ends[i] == sorted(ends[i]) for i, n in quotas)
    totals = [sum(ends[i][j] - (ends[i][j - 1] if j else 0) for i, _ in quotas) for j in range(6)]
    assert max(totals) - min(totals) <= 1


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5
