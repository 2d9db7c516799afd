"""Joins and searches against all pairs, with odd rows."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tables import DIR
from tidebook.llm import decontamination, embedding_dedup, graph, mixing, ngram_join


def test_components(frame):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    rows = {r.node: r.component for r in graph.components(frame(links, "a long, b long")).collect()}
    assert rows == {i: 1 for i in range(1, 61)} | {100: 100, 150: 100, 200: 100}
    assert graph.components(frame([], "a long, b long")).count() == 0


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, nxt = [], 10
    common = [rng.choice(words) for _ in range(40)]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.4:
            base += common
        for _ in range(rng.choice([1, 1, 2, 5])):
            text = [w if rng.random() > 0.01 else rng.choice(words) for w in base]
            rows.append((nxt, "  ".join(text)))
            nxt += 1
    big = [rng.choice(words) for _ in range(200)]
    for _ in range(300):  # more near copies than a bucket or a block holds
        text = list(big)
        text[rng.randrange(200)] = rng.choice(words)
        rows.append((nxt, " ".join(text)))
        nxt += 1
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "short"), (5, "SHORT"), (5, "SHORT"), (None, "short"), (6, "y " * 20000)]


def test_similar_documents(frame):
    rows = corpus()
    docs = frame([(i, t, "x") for i, t in rows], "doc_id long, text string, draws string")
    found = ngram_join.similar_documents(docs).collect()
    assert len(found) == len(rows)
    sets, ids = {}, {}
    for i, t in rows:
        w = tuple((t or "").lower().split())
        if w and i is not None:
            ids[w] = min(i, ids.get(w, i))
            sets[w] = {w[k : k + 5] for k in range(max(1, len(w) - 4))}
    links = {ids[w]: 0 for w in sets}
    root = {i: i for i in links}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(sets)
    for a in range(len(keys)):
        for b in range(a):
            one, other = sets[keys[a]], sets[keys[b]]
            both = len(one & other)
            if both and both >= 0.8 * (len(one) + len(other) - both) - 1e-9:
                x, y = ids[keys[a]], ids[keys[b]]
                links[x] += 1
                links[y] += 1
                x, y = sorted((top(x), top(y)))
                root[y] = x
    for r in found:
        if r.doc_id is None or r.doc_id in (1, 2, 3):
            assert (r.n_links, r.kept, r.component_id) == (0, True, r.doc_id)
        else:
            assert (r.n_links, r.component_id, r.kept) == (links[r.class_id], top(r.class_id), r.doc_id == top(r.class_id))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {top(i) for i in links}
    assert sorted(x for x in (r.doc_id for r in kept.collect()) if x) == sorted(groups | {1, 2, 3})
    assert ngram_join.similar_documents(docs.limit(0)).count() == 0


def test_near_vectors(frame):
    rng = np.random.default_rng(2)
    far = rng.normal(size=(1200, 16))
    crowd = far[:1] + 0.02 * rng.normal(size=(2500, 16))
    pairs = far[1:200] + 0.05 * rng.normal(size=(199, 16))
    vectors = np.vstack([far, crowd, pairs]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(9000, vectors[5].tolist(), 0), (9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [1.0, None], 0), (9005, [1.0, 0.0], 0), (None, vectors[5].tolist(), 0), (9006, [], 0)]
    found = embedding_dedup.near_vectors(frame(rows, "vec_id long, embedding array<float>, n_links int")).collect()
    assert len(found) == len(rows)
    whole = np.vstack([vectors, vectors[5:6]]).astype(float)
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    truth = ((whole @ whole.T) >= 0.9).sum(1) - 1
    got = {r.vec_id: r for r in found}
    counts = np.array([got[i].n_links for i in [*range(len(vectors)), 9000]])
    assert (counts <= truth).all() and counts.sum() >= 0.97 * truth.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in (9001, 9002, 9003, 9004, 9005, 9006, None))
    assert got[9000].component_id == 5 and not got[9000].kept
    assert embedding_dedup.near_vectors(frame([], "vec_id long, embedding array<float>")).count() == 0


def test_decontamination(frame):
    item = "If Anna buys 3 apples for 5 dollars each in Paris and then sells 3 apples to Bob how much money is left over"
    same = item.replace("Anna", "Carl").replace("3", "7").replace("5", "9").replace("Paris", "Rome")
    torn = "If Carl buys 7 apples for 9 dollars in Rome and sells 8 apples to Tim"
    docs = frame([(1, f"x y z. {same} ok", 0), (2, torn, 0), (3, None, 0), (4, "", 0), (5, item.upper(), 0), (5, item.upper(), 0), (None, item, 0), (6, "un " * 50000, 0)], "doc_id long, text string, item_id int")
    bench = frame([(10, item), (11, "too short"), (12, None), (None, "")], "item_id long, text string")
    rows = decontamination.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 10), (None, 10)}  | {(r.doc_id, 10) for r in rows if r.doc_id == 5}
    assert next(r for r in rows if r.doc_id == 1).changed_slots >= 4
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and {2, 3, 4, 6} <= {r.doc_id for r in clean.collect()}
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == [*docs.columns, "shard"] and out.count() > 0
    assert out.select("doc_id").distinct().join(docs, "doc_id").count() == out.select("doc_id").distinct().count()


def held(frame, texts, items):
    docs, bench = frame(list(enumerate(texts)), "doc_id long, text string"), frame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}


def test_decontamination_holds_short_and_unspaced_items(frame):
    items = ["the quick brown fox jumps over lazy dogs", "every green bottle stands upon some old wooden wall", "which planet is largest", "地球は太陽の周りを回っている", "有几个"]
    texts = [f"{'so ' * k}{item} end" for item in items[:3] for k in range(3)] + ["また、地球は太陽の周りを回っている。", "你有几个苹果", "which planet is the largest", "", None]
    assert held(frame, texts, items) == {(3 * i + k, i) for i in range(3) for k in range(3)} | {(9, 3), (10, 4)}


def test_decontamination_holds_slot_dense_items(frame):
    dense = "Tom has 12 apples, Mary has 7 pears, Bob has 3"
    sums = "12 + 7 = 19 and 30 - 4 = 26 so 5 * 6 = 30"
    two = "3 of 4 red 5 or 6 by 7 to 8 he saw 9 birds while she went home and slept all night long"
    texts = [f"so {dense} ok", "so Kim has 5 apples, Ann has 9 pears, Jim has 4 ok", sums, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", f"then {two} ok"]
    # the first, longer run has too few literals, the second enough
    texts.append("1 2 3 4 5 6 7 8 9 10 11 12 a " + " ".join("one two three four five six seven eight nine ten".split()))
    runs = "21 22 23 24 25 26 27 28 29 30 31 32 b one two three four five six seven eight nine ten"
    assert held(frame, texts, [dense, sums, two, runs]) == {(0, 0), (1, 0), (2, 1), (4, 2), (5, 3)}


def test_decontamination_holds_copies_in_other_case_and_blanks(frame):
    item = "If Anna buys 3 apples for 5 dollars each in Paris and then sells 3 apples to Bob how much money is left over"
    names = "we saw Anna and then Bob and later Carl with Dora near Erik and also Fred by Gina then Hans"
    texts = [t for x in (item, names) for t in (x.upper(), x.lower(), x.replace(" ", "\n"), x.replace(" ", "  "), x.replace(" ", "\u00a0"))]
    texts.append(item.lower().replace("3", "7").replace("5", "9"))
    docs = frame([(5, item.upper()), (5, item.upper())], "doc_id long, text string")
    assert held(frame, texts, [item, names]) == {(i, i // 5) for i in range(10)} | {(10, 0)}
    assert [(r.doc_id, r.run) for r in decontamination.contaminated(docs, frame([(10, item)], "item_id long, text string")).collect()] == [(5, 24)]


def test_texts_of_one_id_are_linked_and_kept_each(frame):
    one, two, three = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(7, one), (7, two), (7, two), (7, two.upper().replace(" ", "\n")), (7, three), (8, one), (9, two + " end"), (3, three + " end"), (7, None), (7, "")]
    docs = frame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.class_id, r.n_links, r.component_id, r.kept) for r in ngram_join.similar_documents(docs).collect()]
    assert sorted(found) == sorted([(7, 7, 0, 7, True), *[(7, 7, 1, 7, True)] * 3, (7, 7, 1, 3, False), (8, 7, 0, 7, False), (9, 9, 1, 7, False), (3, 3, 1, 3, True), *[(7, 7, 0, 7, True)] * 2])
    kept = [(r.doc_id, (r.text or "").lower().split()) for r in ngram_join.keep_one(docs).collect()]
    assert sorted(kept) == sorted([(7, one.split()), (7, two.split()), (3, rows[7][1].split()), (7, [])])


def test_anchors_meet_what_windows_meet(spark, frame):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").limit(60)
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text")
    more = [(900, "so Anna Bob Carl Dora Erik Fred Gina Hans"), (901, "1 2 3 4 5 6 7 8 9"), (902, "red 5 km"), (903, "7"), (904, "which planet is largest")]
    bench = bench.union(frame(more, "item_id long, text string"))
    texts = [(10_000, "we saw Tina Rob Karl Nora Emil Finn Gita Hugo there"), (10_001, "0 9 8 7 6 5 4 3 2 1"), (10_002, "a red 5 km b"), (10_003, "Which Planet is largest 7"), (None, "so Anna Bob Carl Dora Erik Fred Gina Hans.")]
    docs = docs.union(frame(texts, "doc_id long, text string"))
    items = decontamination.cut(bench.select("item_id", decontamination.marked_tokens(F.col("text")).alias("item")).where(F.size("item") > 0).withColumn("number", F.xxhash64("item_id", "item")))
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), decontamination.marked_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    one = {tuple(r) for r in decontamination._by_anchor(named, decontamination._anchored(items, 8)).collect()}
    other = {tuple(r) for r in decontamination._by_window(named, items, 8).collect()}
    assert one == other and {r[0] for r in one} >= {None, 10_000, 10_001, 10_002, 10_003}


def test_mix_carries_any_column(frame):
    rows = [(i, f"word {i} a b c", f"s{i % 2}", 7, 8, 9, 10, 11, 12, 3) for i in range(12)]
    names = ["size", "pieces", "target", "taken", "source_size", "mix_shard", "n_chars"]
    docs = frame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.mixed_documents(docs, docs.columns).select(*docs.columns)
    got = out.collect()
    assert out.columns == docs.columns and got
    assert {(r["size"], r["pieces"], r["target"], r["taken"], r["source_size"], r["mix_shard"]) for r in got} == {(7, 8, 9, 10, 11, 12)}
    assert all(r.n_chars == len(r.text) for r in got)


def test_drifting_crowd_keeps_its_links(frame):
    """A crowd that drifts away from its first text, and a second one beside it: all links, none false."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    rows, text = [], [rng.choice(words) for _ in range(120)]
    for i in range(450):
        if i == 300:  # the second crowd shares half of the words only
            text = text[:60] + [rng.choice(words) for _ in range(60)]
        text = list(text)
        text[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                root[y] = x
    found = {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.similar_documents(frame(rows, "doc_id long, text string")).collect()}
    assert found == {i: (links[i], top(i)) for i, _ in rows}
