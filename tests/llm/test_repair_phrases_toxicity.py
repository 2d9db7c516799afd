"""Conversation repair, phrase mining and toxicity against brute force, with odd rows."""

import hashlib
import heapq
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tables import DIR
from tidebook.llm import collocations, conversation, queries, toxicity

FOLLOW = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows, entry="", goal=None):
    """Least (cost, edits) by uniform-cost search over all edits; the entry and goal are last roles."""
    heap, done = [(0, "", 0, entry)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and (q in ("", "a") if goal is None else q == goal):
            return cost, audit
        if (i, q) in done or cost > 7 * len(rows) + 20:
            continue
        done.add((i, q))
        if i < len(rows) or goal is None:
            heapq.heappush(heap, (cost + 3, audit + "I", i, FOLLOW[q]))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
        c = rows[i]
        if c != "x":
            more, low = 3 * c.isupper(), c.lower()
            if (low == "s" and q == "") or (low == "u" and q != "u") or (low == "a" and q == "u"):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, low))
            heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, FOLLOW[q]))
    return None


def test_search_finds_the_least_of_the_cheapest():
    rng = random.Random(5)
    for _ in range(1500):
        rows = "".join(rng.choice("xsuaoSUAOuaua") for _ in range(rng.randrange(0, 9)))
        assert conversation.search(rows, conversation.START, None) == cheapest(rows)
        for e, entry in enumerate(("", "s", "u", "a")):
            goal = rng.choice(("", "s", "u", "a"))
            assert conversation.search(rows, e, ("", "s", "u", "a").index(goal)) == cheapest(rows, entry, goal), (rows, entry, goal)


def test_estimates_never_exceed_the_cost():
    rng = random.Random(6)
    for _ in range(400):
        rows = "".join(rng.choice("xsuaoSUAOuaua") for _ in range(8))
        estimates = conversation.Search(rows, 0, None).estimates
        for i in range(9):
            for q, state in enumerate(("", "s", "u", "a")):
                assert estimates[i][q] <= cheapest(rows[i:], state)[0]
        for goal, name in enumerate(("", "s")):
            estimates = conversation.Search(rows, 0, goal).estimates
            for i in range(9):
                for q, state in enumerate(("", "s", "u", "a")):
                    best = cheapest(rows[i:], state, name)
                    assert estimates[i][q] == best[0] if best else estimates[i][q] >= conversation.NEVER


def test_chained_pieces_equal_one_search():
    rng = random.Random(7)
    for _ in range(60):
        rows = "".join(rng.choice("xsuaoUAuauauaua") for _ in range(40))
        chain = conversation.Chain()
        for at in range(0, 40, 8):
            part = rows[at : at + 8]
            entries = range(4) if at else (0,)
            found = [(e, x, conversation.search(part, e, x)) for e in entries for x in range(4)]
            chain.add(None, None, 0, [0] * 4, ["u", "a"], [f"{e}{x}{r[0]}:{r[1]}" for e, x, r in found if r])
        gaps, *_, cost, audit = chain.summary()
        assert (cost, audit) == cheapest(rows)


def repaired_by_hand(conv, rows):
    """The contract's counts, edits and digest of one damaged conversation, in plain Python."""
    kept = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    named = "n" if conv is None else f"v{conv}"
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{named}:{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    kept.sort(key=key)
    seen, looks, counts = set(), "", Counter()
    for _, role, text in kept:
        solid = re.findall("[^\x20\x09-\x0d]", text)
        low = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not solid:
            counts["blank"] += 1
            looks += "x"
        elif (role, text) in seen:
            counts["duplicate"] += 1
            looks += "x"
        elif solid[-1] not in ".!?":
            counts["truncated"] += 1
            looks += low.upper()
        else:
            looks += low
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
    turns = {r[0] for r in kept if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = cheapest(looks)
    out, at, state = [], 0, ""
    for letter in audit:
        if letter == "I":
            state = FOLLOW[state]
            out.append({"u": "user", "a": "assistant"}[state] + ":")
            continue
        _, role, text = kept[at]
        at += 1
        if letter != "D":
            state = role[0] if letter == "K" else FOLLOW[state]
            out.append((role if letter == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + text)
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)


def report(rows, frame):
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(row)
    table = frame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, audit int")
    got = {tuple(r) for r in conversation.repair_report(table, conversation.damaged(table)).collect()}
    return got, {repaired_by_hand(c, x) for c, x in by.items()}


def test_repair_of_odd_rows(frame, monkeypatch):
    rng = random.Random(8)
    texts = [None, "", " \n", "Yes.", "Yes. ", "no end", "Why?", "é!\n", "x" * 30000 + "."]
    roles = [None, "", "user", "assistant", "system", "USER", "agent"]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(40)] for _ in range(rng.randrange(1, 7))]
    rows += [(77, t % 90, roles[2 + t % 2], f"Turn {t % 50}.") for t in range(300)]
    rows += [(99, 3, "user", "Same.")] * 70
    rows += [(c, 0, "user", "Alone.") for c in range(500, 560)]
    got, want = report(rows, frame)
    assert got == want
    assert any(r[7] == "" and r[8] == conversation.NO_DIGEST for r in got)
    monkeypatch.setattr(conversation, "PIECE_ROWS", 5)
    assert report(rows, frame)[0] == want
    empty, _ = report([], frame)
    assert not empty


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(row)
    got = {tuple(r) for r in queries.op12_conversation_repair(spark, DIR).collect()}
    assert got == {repaired_by_hand(c, x) for c, x in by.items()}


def test_repaired_rows(frame):
    rows = frame([(1, 0, "user", "Hi."), (1, 1, "user", "You?"), (1, 2, "assistant", "Well."), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    found = conversation.summaries(rows)
    assert {(r.conv_id, r.cost, r.audit) for r in found.collect()} == {(1, 3, "KIKK"), (2, 4, "D")}
    out = sorted(tuple(r) for r in conversation.repaired(rows, found).collect())
    assert out == [(1, 0, "K", "user", "Hi."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "You?"), (1, 3, "K", "assistant", "Well.")]


def mined_by_hand(docs, support, most):
    """The contract's rows by counting everything."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        often = {p: f for p, f in found.items() if len(p) > 1 and f >= support}
        rows = []
        for p, a in often.items():
            score, k = min((1000 * a * n[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            if any(len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in often.items()):
                continue
            rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


ODD_TEXTS = [
    ("en", "New York is New York, new york is big. The the the the the the"),
    ("en", "the quick brown fox\tjumps; The QUICK brown fox jumps: a\x00b a\x00b"),
    ("en", None),
    (None, "ÉCOLE Été École été, été"),
    ("und", "École été \x0b École été   \t École été"),
    ("de", ""),
    ("fr", "...,;"),
    ("en", "a b " * 3000),
]


@pytest.mark.parametrize("bounds", [(1 << 25, 16, 500_000, 1 << 22), (60, 16, 500_000, 20), (300, 3, 500_000, 100), (300, 3, 1, 100)])
def test_phrases_of_odd_texts(frame, monkeypatch, bounds):
    for name, value in zip(("SHARD_BYTES", "LEAST_SHARDS", "SENT_ROWS", "READ_BYTES"), bounds, strict=True):
        monkeypatch.setattr(collocations, name, value)
    rng = random.Random(9)
    rows = ODD_TEXTS * 3 + [("en", " ".join(rng.choice("abcde") for _ in range(40))) for _ in range(30)]
    docs = frame([(x, t, 1) for x, t in rows], "lang string, text string, rank int").repartition(3)
    for support, most in ((2, 50), (5, 2000)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, support, most).collect())
        assert got == mined_by_hand(rows, support, most)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("text is null")).count() == 0


def test_local_mining_is_complete():
    rng = random.Random(10)
    texts = [" ".join(rng.choice("abcd") for _ in range(30)).encode() + b"." for _ in range(20)]
    shard = collocations.Shard()
    for t in texts:
        shard.add(t)
    ids = shard.ids()
    names = list(shard.words)
    got = {b" ".join(names[w] for w in row): n for p, c in collocations.frequent(ids, len(names), 4) for row, n in zip(p.tolist(), c.tolist(), strict=True)}
    want = Counter()
    for t in texts:
        w = t.rstrip(b".").split()
        for k in range(1, 6):
            want.update(b" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    assert got == {p: n for p, n in want.items() if n >= 4}


@pytest.mark.parametrize("bounds", [(1, 1 << 25, 16, 500_000), (1, 300, 3, 500_000), (1, 60, 16, 1)])
def test_phrases_by_candidates(frame, monkeypatch, bounds):
    for name, value in zip(("LEAST_LOCAL", "SHARD_BYTES", "LEAST_SHARDS", "SENT_ROWS"), bounds, strict=True):
        monkeypatch.setattr(collocations, name, value)
    rng = random.Random(14)
    rows = ODD_TEXTS * 3 + [("en", " ".join(rng.choice("abcde") for _ in range(40))) for _ in range(30)]
    docs = frame(rows, "lang string, text string").repartition(3)
    for support in (2, 40):
        assert sorted(tuple(r) for r in collocations.collocations(docs, support, 2000).collect()) == mined_by_hand(rows, support, 2000)


def many_words(seed, n):
    rng = random.Random(seed)
    some = ["a", "a\x00", "A", "é", "ab", "zz", "b;", "c."]
    return [("en" if i % 3 else "de", " ".join(rng.choice(some) if rng.random() < 0.7 else f"w{rng.randrange(900)}" for _ in range(60))) for i in range(n)]


@pytest.mark.parametrize("bounds", [(1 << 25, 1 << 20, 1 << 21, 1 << 17), (500, 1 << 20, 300, 7), (1 << 25, 50, 40, 1), (2000, 1 << 20, 5, 1 << 17)])
def test_phrases_of_many_parts(frame, monkeypatch, bounds):
    for name, value in zip(("RUN_BYTES", "RUN_WORDS", "PART_RUNS", "ROW_RUNS"), bounds, strict=True):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations, "READ_BYTES", 300)
    rows = many_words(15, 60) + [("en", "of the " * 200), ("en", "x" * 3000), ("fr", "one")]
    docs = frame(rows, "lang string, text string").repartition(3)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 3, 2000).collect()) == mined_by_hand(rows, 3, 2000)


def test_many_shards_store_no_rare_phrases(frame, monkeypatch):
    stored = []

    def counting(table):
        kept = cut(table)
        stored.append(kept.count())
        return kept

    cut = collocations.cut
    monkeypatch.setattr(collocations, "cut", counting)
    monkeypatch.setattr(collocations, "SHARD_BYTES", 200)
    rows = many_words(16, 80)
    docs = frame(rows, "lang string, text string").repartition(3)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 10, 2000).collect()) == mined_by_hand(rows, 10, 2000)
    words = sum(len(text.split()) for _, text in rows)
    assert max(stored) < words / 4  # nearly all of some 5 phrases a word are rare


def test_runs_of_a_shard_are_small():
    rng = random.Random(17)
    texts = [" ".join(f"word{int(rng.paretovariate(0.6)) % 5000}" for _ in range(500)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 200), pa.array([t.encode() for t in texts])], names=["lang", "text"])
    sent = type("Sent", (), {"value": collocations._written(pa.table([pa.array(["en"] * 3), pa.array([b"word11 ", b"word2 ", b"word9 "])], schema=collocations.LOOKED_SCHEMA))})
    found = [r for part in collocations._runs(sent)(iter([batch.slice(0, 90), batch.slice(90)])) for r in part.to_pylist()]
    assert [r["part"] for r in found] == [0, 1, 2, 3] and sum(len(r["runs"]) for r in found) < 2 * sum(map(len, texts))
    got = Counter()
    for r in found:
        rows, counts, names = collocations.unpacked(r["n"], r["size"], r["runs"])
        for row, n in zip(rows.tolist(), counts.tolist(), strict=True):
            got[tuple(names[w - 1] for w in row if w)] += n
    want = Counter(tuple(t.encode().split()[i : i + 5]) for t in texts for i in range(500))
    assert got == want


def test_phrases_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("lang", "text").collect()]
    got = sorted(tuple(r) for r in queries.op13_phrase_collocations(spark, DIR).collect())
    assert got and got == mined_by_hand(rows, 100, 2000)


def insults(frame):
    rng = random.Random(11)
    calm = ["sun", "rain", "tree", "river", "stone", "light", "house", "cloud"]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(calm) for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for w in rng.sample(["moron", "scum", "filthkin", "filthful", "filthox"], 2):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words), "z"))
        if i % 3:
            labels.append((i, int(toxic), 1))
    docs += [(900, None, "z"), (901, "", "z"), (None, "you scum", "z"), (5, "sun " * 20000, "z"), (902, "filthnew words", "z"), (902, "filthnew words", "z")]
    labels += [(1, 0, 1), (None, 1, 1), (5000, 1, 1), (7, None, 1)]
    return frame(docs, "doc_id long, text string, score string"), frame(labels, "doc_id long, toxic int, score int")


def test_toxicity(frame):
    docs, labels = insults(frame)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 606 and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3 == 0 and r.doc_id % 5:
            assert r.score < 0.3
        if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 5 == 0 and r.score < 0.3:
            assert r.doc_id == 5  # its repeat without an insult
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r.score)
    assert by[900] == by[901] and by[900][0] < 0.3
    assert by[902][0] == by[902][1] >= 0.3 and by[None][0] >= 0.3
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs.limit(9), labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(docs.limit(9), labels.where("toxic = 0")).collect()} == {0.0}


def test_term_counts_hold_few_terms(monkeypatch):
    rng = random.Random(13)
    rows = [(" ".join(f"{rng.choice('abcd')}{rng.choice(('oken', 'okens', 'ord'))}" for _ in range(20)), i % 2) for i in range(50)]
    want = Counter((t, v) for text, v in rows for t in toxicity.terms_of(Counter(text.split())))
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([v for _, v in rows], pa.int32())], names=["text", "toxic"])
    for held in (1, 40, 1 << 16):
        monkeypatch.setattr(toxicity, "HELD_TERMS", held)
        got = Counter()
        for part in toxicity.term_counts(iter([batch.slice(0, 30), batch.slice(0, 0), batch.slice(30)])):
            for r in part.to_pylist():
                got[r["term"], r["toxic"]] += r["n"]
        assert got == want
    assert list(toxicity.term_counts(iter([batch.slice(0, 0)]))) == []
    # one batch of 300 texts of 1,000 words, all different
    name = lambda n: "".join(chr(97 + int(d)) for d in f"{n:09d}"[::-1])
    texts = pa.array([" ".join(name(1000 * i + j) for j in range(1000)) for i in range(300)])
    batch = pa.RecordBatch.from_arrays([texts, pa.array([0] * 300, pa.int32())], names=["text", "toxic"])
    tracemalloc.start()
    try:
        total = sum(part.num_rows for part in toxicity.term_counts(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total >= 300_000 and peak < 40e6


def test_label_model_learns_rates_and_correlations(frame):
    rng = np.random.default_rng(12)
    y = rng.random(20000) < 0.2
    rates = [(0.7, 0.05), (0.6, 0.1), (0.5, 0.02), (0.4, 0.1)]
    votes = np.array([rng.random(20000) < np.where(y, a, b) for a, b in rates])
    votes = np.vstack([votes, votes[0]])  # the last voter repeats the first
    masks = (votes * (1 << np.arange(5))[:, None]).sum(0)
    known = [(int(m), int(t) if i < 400 else None) for i, (m, t) in enumerate(zip(masks, y, strict=True))]
    seen = Counter(known)
    sizes = Counter(t for _, t in known)
    rows = [(m, t, n / (sizes[None] if t is None else 400)) for (m, t), n in seen.items()]
    model = toxicity.label_model(frame(rows, "mask long, toxic int, mass double"), 5)
    for j, (a, b) in enumerate([*rates, rates[0]]):
        assert abs(model.toxic[j] - a) < 0.05 and abs(model.other[j] - b) < 0.05
    assert abs(model.prior - 0.2) < 0.03
    assert model.weight[0] < 0.6 and model.weight[4] < 0.6 and min(model.weight[1:4]) > 0.9
    guess = model.posterior(toxicity.bits_of(masks, 5)) > 0.5
    assert (guess == y).mean() > 0.88


def test_toxicity_of_held_out_labels(spark):
    sf = DIR.replace("0.001", "0.1")
    got = queries.op11_weak_toxicity(spark, sf)
    truth = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("_id"), "toxic")
    rows = got.join(truth, F.col("doc_id") == F.col("_id")).where("held_out").collect()
    right = Counter((r.toxic, r.predicted) for r in rows)
    assert right[0, 0] >= 0.97 * (right[0, 0] + right[0, 1])
    assert right[1, 1] >= 0.85 * (right[1, 0] + right[1, 1])
