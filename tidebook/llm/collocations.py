"""Phrase collocation mining by partitions: local mining at lowered support, then exact global counts."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.llm.common import cut

LONGEST = 5
#: Characters that end a piece, and those that separate words in it.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: A byte that no UTF-8 text holds stands for the end of a piece.
END = b"\xff"
_AS = bytes.maketrans(ENDS + BLANKS, END * len(ENDS) + b" " * len(BLANKS))
WORD = "[^\\x20\\x09.,;:!?\\x0A-\\x0D]+"
#: Bytes of text in one shard at most, candidates that are sent to every task at most.
SHARD_BYTES, SENT_ROWS = 64 << 20, 500_000
#: Shards of a small corpus, bytes of text that are split into words at once.
LEAST_SHARDS, READ_BYTES = 16, 4 << 20
#: Below this local support a shard passes on runs of words instead of phrases.
LEAST_LOCAL = 4
#: Bytes of text and different words whose runs are sorted together, runs in one part and in one row about.
RUN_BYTES, RUN_WORDS, PART_RUNS, ROW_RUNS = 32 << 20, 1 << 20, 1 << 21, 1 << 17
#: Places of the texts that are looked at for the bounds of one part.
LOOKS = 64


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of the texts with an END wherever a piece ends; A to Z in lower case."""
    return END.join(texts).lower().translate(_AS).replace(END, b" " + END + b" ").split()


class Words(dict):
    """Numbers of words in the order of their first sight; 0 is the END."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Shard:
    """Word numbers of one language's texts, 0 between pieces; texts are read in parts, not as one list of words."""

    def __init__(self):
        self.words, self.parts, self.waiting, self.size = Words(), [], [], 0

    def add(self, text: bytes) -> None:
        self.waiting.append(text)
        self.size += len(text)
        if self.size >= READ_BYTES:
            self._read()

    def _read(self) -> None:
        if self.waiting:
            found = tokens([*self.waiting, b""])
            self.parts.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
            self.waiting, self.size = [], 0

    def ids(self) -> np.ndarray:
        self._read()
        return np.concatenate(self.parts)


def frequent(ids: np.ndarray, n_words: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All phrases of 1 to LONGEST words that occur ``least`` times: their words (a row each) and counts.

    Level by level: a phrase is counted only where the phrase without its last word and that without
    its first one are frequent. Exact, since a phrase is numbered by its first words' number and its
    last word.
    """
    counts = np.bincount(ids, minlength=n_words)
    counts[0] = 0
    kept = np.flatnonzero(counts >= least)
    yield kept[:, None], counts[kept]
    place = np.full(n_words, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    word = place[ids]
    level, phrases = word, kept[:, None]
    for _ in range(1, LONGEST):
        # a phrase at i is followed by the phrase at i + 1, which ends with the new last word
        level, after = level[:-1], level[1:]
        last = word[len(word) - len(level) :]
        at = np.flatnonzero((level >= 0) & (after >= 0) & (last >= 0))
        if not len(at):
            return
        keys = level[at].astype(np.int64) * len(kept) + last[at]
        ordered = np.sort(keys)
        edges = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))
        counts = np.diff(edges)
        often = counts >= least
        known, counts = ordered[edges[:-1][often]], counts[often]
        if not len(known):
            return
        del ordered, edges
        number = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[number] == keys
        level = np.full(len(level), -1, np.int32)
        level[at[hit]] = number[hit]
        phrases = np.hstack([phrases[known // len(kept)], kept[known % len(kept)][:, None]])
        yield phrases, counts


LOCAL = "lang string, phrase binary, part long"
LOCAL_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("part", pa.int64())])


def _mine(support: int):
    """Each run of rows up to the bound is a shard, each of its languages mined completely.

    A shard with the share s of a language's words has the local support ceil(support x s), 1 at
    least: a phrase with the global support reaches that in some shard. For each local phrase its
    count above what an unreported phrase may have (support - 1) is returned, and that number itself
    once for every shard, under a null phrase.
    """

    def mined(lang: str, held: Shard, total: int) -> Iterator[pa.RecordBatch]:
        ids = held.ids()
        share = int(np.count_nonzero(ids))
        least = max(1, -(-support * share // total))
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.binary()), pa.array([least - 1], pa.int64())], schema=LOCAL_SCHEMA)
        names = list(held.words)
        for phrases, counts in frequent(ids, len(names), least):
            for a in range(0, len(phrases), 65536):
                some = [b" ".join([names[w] for w in row]) for row in phrases[a : a + 65536].tolist()]
                above = counts[a : a + 65536] - (least - 1)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.binary()), pa.array(above, pa.int64())], schema=LOCAL_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}
        totals: dict[str, int] = {}
        size = 0
        for data in batches:
            for lang, text, total in zip(data.column(0).to_pylist(), data.column(1), data.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                held.setdefault(lang, Shard()).add(raw)
                totals[lang] = total
                size += len(raw)
                if size >= SHARD_BYTES:
                    while held:
                        name, one = held.popitem()
                        yield from mined(name, one, totals[name])
                    size = 0
        while held:
            name, one = held.popitem()
            yield from mined(name, one, totals[name])

    return run


class Candidates:
    """Candidate phrases of one language, numbered level by level, and how often they were seen."""

    def __init__(self, phrases: list[bytes]):
        split = sorted((tuple(p.split(b" ")), i) for i, p in enumerate(phrases))
        self.words = {END: 0} | {w: k + 1 for k, w in enumerate(sorted({w for p, _ in split for w in p}))}
        self.width = len(self.words)
        self.levels = []
        before = {(): 0}
        for k in range(1, LONGEST + 1):
            rows = [(before[p[:-1]] * self.width + self.words[p[-1]], p, i) for p, i in split if len(p) == k]
            rows.sort()
            before = {p: at for at, (_, p, _) in enumerate(rows)}
            keys = np.array([key for key, _, _ in rows], np.int64)
            self.levels.append((keys, np.array([i for _, _, i in rows], np.int64), np.zeros(len(rows), np.int64)))

    def count(self, texts: list[bytes]) -> None:
        """Add the occurrences in these texts. The prefix of a candidate is one too."""
        found = tokens(texts)
        get = self.words.get
        ids = np.fromiter((get(t, -1) for t in found), np.int64, len(found))
        at, level = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for k, (keys, _, counts) in enumerate(self.levels):
            if not len(keys):
                return
            inside = at + k < len(ids)
            at, level = at[inside], level[inside]
            last = ids[at + k]
            known = last > 0
            at, key = at[known], level[known] * self.width + last[known]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            at, level = at[hit], place[hit]
            counts += np.bincount(level, minlength=len(keys))


#: Candidates whose counts travel together.
BLOCK = 8192
PARTS = "block int, counts array<long>"
PARTS_SCHEMA = pa.schema([("block", pa.int32()), ("counts", pa.list_(pa.int64()))])
COUNTS = "lang string, phrase binary, f long"
COUNTS_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])


def _sent(sent) -> tuple[list[str], list[bytes]]:
    with pa.ipc.open_stream(sent.value) as stream:
        table = stream.read_all()
    return table.column(0).to_pylist(), table.column(1).to_pylist()


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _count(sent):
    """Occurrences of the candidates in a task's texts: an array for each block of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, phrases = _sent(sent)
        by: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            by.setdefault(lang, []).append(i)
        known = {lang: Candidates([phrases[i] for i in rows]) for lang, rows in by.items()}
        for data in batches:
            held: dict[str, list[bytes]] = {}
            size = 0
            for lang, text in zip(data.column(0).to_pylist(), data.column(1), strict=True):
                if lang not in known:
                    continue
                raw = text.as_buffer().to_pybytes()
                held.setdefault(lang, []).append(raw)
                size += len(raw)
                if size >= READ_BYTES:
                    for name, texts in held.items():
                        known[name].count(texts)
                    held, size = {}, 0
            for name, texts in held.items():
                known[name].count(texts)
        every = np.zeros(len(phrases), np.int64)
        for lang, found in known.items():
            at = np.array(by[lang])
            for _, rows, counts in found.levels:
                every[at[rows]] = counts
        for block in range(0, len(every), BLOCK):
            some = every[block : block + BLOCK]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([some], pa.list_(pa.int64()))], schema=PARTS_SCHEMA)

    return run


def _add(sent):
    """Arrays of equal blocks, sorted by block, to one row for each candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, phrases = _sent(sent)

        def rows(block: int, total: np.ndarray) -> pa.RecordBatch:
            part = slice(block, block + len(total))
            return pa.RecordBatch.from_arrays([pa.array(langs[part]), pa.array(phrases[part], pa.binary()), pa.array(total)], schema=COUNTS_SCHEMA)

        held, total = None, None
        for data in batches:
            for block, counts in zip(data.column(0).to_pylist(), data.column(1), strict=True):
                if block != held:
                    if held is not None:
                        yield rows(held, total)
                    held, total = block, np.zeros(len(counts), np.int64)
                total += counts.values.to_numpy()
        if held is not None:
            yield rows(held, total)

    return run


def _looked_at(step: int):
    """(lang, run): the run of words after every ``step``th byte of a task's texts."""
    apart = re.compile(b"[%s]+" % re.escape(ENDS + BLANKS))
    word = re.compile(b"[%s]*([^%s]+)" % (re.escape(BLANKS), re.escape(ENDS + BLANKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = None
        for data in batches:
            langs, runs = [], []
            for lang, text in zip(data.column(0).to_pylist(), data.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                if after is None:
                    after = zlib.crc32(raw[:4096]) % step
                while after < len(raw):
                    start, found = apart.search(raw, after), []
                    at = start.end() if start else len(raw)
                    while len(found) < LONGEST and (one := word.match(raw, at)):
                        found.append(one[1][:200].lower() + b" ")
                        at = one.end()
                    langs.append(lang)
                    runs.append(b"".join(found))
                    after += step
                after -= len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(runs, pa.binary())], schema=LOOKED_SCHEMA)

    return run


LOOKED = "lang string, run binary"
LOOKED_SCHEMA = pa.schema([("lang", pa.string()), ("run", pa.binary())])


def sorted_runs(ids: np.ndarray, n_words: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ``ids`` in order and how often they occur; with ``times``, that many times each.

    One-dimensional ids are a text, 0 between pieces: its rows are the LONGEST words from every word
    on, 0 after the end of the piece.
    """
    bits = max(1, int(n_words - 1).bit_length())
    per = min(LONGEST, 63 // bits)
    if ids.ndim == 1:
        at = np.flatnonzero(ids)
        text = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)])
        inside = np.ones(len(at), bool)
    keys: list[np.ndarray] = []
    for k in range(LONGEST):
        if ids.ndim == 1:
            word = text[at + k]
            inside &= word > 0
            word = np.where(inside, word, 0)
        else:
            word = ids[:, k]
        if k % per:
            keys[-1] <<= bits
            keys[-1] |= word
        else:
            keys.append(word.astype(np.int64))
    if len(keys) == 1 and times is None:
        keys[0].sort()
    else:
        order = np.lexsort(keys[::-1])
        for i in range(len(keys)):
            keys[i] = keys[i][order]
        times = None if times is None else times[order]
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    if times is None:
        counts = np.diff(np.append(first, len(new)))
    else:
        counts = np.add.reduceat(times, first) if len(first) else times
    rows = np.empty((len(first), LONGEST), np.int32)
    for k in range(LONGEST):
        after = min(per, LONGEST - k // per * per) - 1 - k % per
        rows[:, k] = (keys[k // per][first] >> (bits * after)) & ((1 << bits) - 1)
    return rows, counts


def shared_words(rows: np.ndarray) -> np.ndarray:
    """How many of its first words each row of sorted rows shares with the row before; 0 after the end of a piece don't count."""
    shared = np.zeros(len(rows), np.int8)
    same = np.ones(max(0, len(rows) - 1), bool)
    for k in range(LONGEST):
        same &= (rows[1:, k] == rows[:-1, k]) & (rows[1:, k] > 0)
        shared[1:] += same
    return shared


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


RUNS = "part int, lang string, n int, size int, runs binary"
RUNS_SCHEMA = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("n", pa.int32()), ("size", pa.int32()), ("runs", pa.binary())])


def packed(rows: np.ndarray, counts: np.ndarray, written: pa.Array) -> tuple[int, int, bytes]:
    """Sorted rows as bytes: of each row its length, the words that it doesn't share with the row before, its count.

    ``written`` holds the words, each with a space after it.
    """
    shared = shared_words(rows)
    lengths = np.zeros(len(rows), np.int8)
    own = np.empty(rows.shape, bool)
    for k in range(LONGEST):
        word = rows[:, k] > 0
        lengths += word
        own[:, k] = word & (shared <= k)
    used, words = np.unique(rows[own], return_inverse=True)
    words, counts = _narrow(words), _narrow(counts)
    _, ends, letters = written.take(pa.array(used)).buffers()
    letters = letters.to_pybytes()[: np.frombuffer(ends, np.int32)[len(used)]]
    head = np.array([words.itemsize, counts.itemsize, len(words)], np.int64)
    raw = b"".join([head.tobytes(), (shared * 8 + lengths).astype(np.uint8).tobytes(), words.tobytes(), counts.tobytes(), letters])
    return len(rows), len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(n: int, size: int, runs: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Rows with numbers from 1 on, counts and the words of the numbers."""
    raw = pa.decompress(runs, decompressed_size=size, codec="zstd", asbytes=True)
    wide, wide_counts, n_words = np.frombuffer(raw, np.int64, 3).tolist()
    heads = np.frombuffer(raw, np.uint8, n, 24)
    words = np.frombuffer(raw, f"u{wide}", n_words, 24 + n)
    end = 24 + n + n_words * wide
    counts = np.frombuffer(raw, f"u{wide_counts}", n, end).astype(np.int64)
    names = raw[end + n * wide_counts :].split(b" ")[:-1]
    shared, lengths = (heads >> 3)[:, None], (heads & 7)[:, None]
    place = np.arange(LONGEST)
    own = (place >= shared) & (place < lengths)
    rows = np.zeros((n, LONGEST), np.int32)
    rows[own] = words.astype(np.int32) + 1
    # a shared word stands in the last row above that has a word or an end of its own there
    above = np.where(place < shared, 0, np.arange(n)[:, None])
    rows = rows[np.maximum.accumulate(above, 0), place]
    return rows, counts, names


def _ordered(names: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words, after END, in the order in which runs are written, and the new number of each old one."""
    order = sorted(range(1, len(names)), key=lambda i: names[i] + b" ")
    place = np.zeros(len(names), np.int32)
    place[order] = np.arange(1, len(names), dtype=np.int32)
    return [END] + [names[i] for i in order], place


def _runs(sent):
    """Each run of LONGEST words of a task's texts, with its local count, in rows for the parts that the bounds make.

    The runs hold every phrase: it is the beginning of as many runs as it occurs. They are sorted, so
    a row holds only the words that a run doesn't share with the run before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: list[tuple[str, bytes]] = list(zip(*_sent(sent), strict=True))

        def rows_of(lang: str, held: Shard) -> Iterator[pa.RecordBatch]:
            ids = held.ids()
            names, place = _ordered(list(held.words))
            rows, counts = sorted_runs(place[ids], len(names))
            spaced = [w + b" " for w in names]
            written = pa.array(spaced, pa.binary())
            part = bisect_left(bounds, (lang, b""))
            at = 0
            while at < len(rows):
                end = len(rows)
                if part < len(bounds) and bounds[part][0] == lang:
                    end = bisect_left(range(len(rows)), bounds[part][1], at, key=lambda i: b"".join([spaced[w] for w in rows[i].tolist() if w]))
                for a in range(at, end, ROW_RUNS):
                    b = min(end, a + ROW_RUNS)
                    n, size, some = packed(rows[a:b], counts[a:b], written)
                    columns = [pa.array([part], pa.int32()), pa.array([lang]), pa.array([n], pa.int32()), pa.array([size], pa.int32()), pa.array([some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=RUNS_SCHEMA)
                at, part = end, part + 1

        held: dict[str, Shard] = {}
        size = 0
        for data in batches:
            for lang, text in zip(data.column(0).to_pylist(), data.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                one = held.setdefault(lang, Shard())
                one.add(raw)
                size += len(raw)
                if size >= RUN_BYTES or len(one.words) >= RUN_WORDS:
                    while held:
                        yield from rows_of(*held.popitem())
                    size = 0
        while held:
            yield from rows_of(*held.popitem())

    return run


def begun(rows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The phrases of 1 to LONGEST words that begin sorted rows ``least`` times, and how often they do.

    The first and the last of each length are there whatever their counts: neighbouring parts may hold more of them.
    """
    shared = shared_words(rows)
    for k in range(1, LONGEST + 1):
        first = np.flatnonzero((shared < k) & (rows[:, k - 1] > 0))
        if not len(first):
            return
        total = np.cumsum(np.where(rows[:, k - 1] > 0, counts, 0))
        sums = np.diff(np.append((total[first] - counts[first]), total[-1]))
        kept = sums >= least
        kept[[0, -1]] = True
        yield rows[first[kept], :k], sums[kept]


def _begun(support: int):
    """The phrases of each part, from the runs of all shards in it, sorted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def phrases(held: dict[str, tuple[Words, list, list]]) -> Iterator[pa.RecordBatch]:
            while held:
                lang, (words, found, times) = held.popitem()
                names, place = _ordered(list(words))
                rows, counts = sorted_runs(place[np.concatenate(found)], len(names), np.concatenate(times))
                del found, times
                for some, sums in begun(rows, counts, support):
                    for a in range(0, len(some), 65536):
                        joined = [b" ".join([names[w] for w in row]) for row in some[a : a + 65536].tolist()]
                        columns = [pa.array([lang] * len(joined)), pa.array(joined, pa.binary()), pa.array(sums[a : a + 65536], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, schema=COUNTS_SCHEMA)

        held, of = {}, None
        for data in batches:
            for part, lang, n, size, runs in zip(*(data.column(i) for i in range(5)), strict=True):
                if part.as_py() != of:
                    yield from phrases(held)
                    of = part.as_py()
                words, found, times = held.setdefault(lang.as_py(), (Words(), [], []))
                rows, counts, names = unpacked(n.as_py(), size.as_py(), runs.as_buffer())
                number = np.array([0] + [words[w] for w in names], np.int32)
                found.append(number[rows])
                times.append(counts)
        yield from phrases(held)

    return run


def _counted(plain: DataFrame, n_words: int, n_bytes: int, support: int) -> DataFrame:
    """(lang, phrase, f) of all phrases of (lang, text) with the support, by runs of words.

    A shard passes on each of its different runs once. They go by their order to parts of some PART_RUNS runs,
    whatever a phrase's share; the bounds come from a look at some places of the texts and decide
    only which task counts a run. A phrase on a bound is added up from the parts beside it.
    """
    spark = plain.sparkSession
    texts = plain.select("lang", F.col("text").cast("binary"))
    parts = -(-n_words // PART_RUNS)
    bounds = []
    if parts > 1:
        looks = texts.mapInArrow(_looked_at(max(1, n_bytes // (parts * LOOKS))), LOOKED).toArrow()
        looks = sorted(zip(looks.column(0).to_pylist(), looks.column(1).to_pylist(), strict=True))
        bounds = sorted({looks[i * len(looks) // parts] for i in range(1, parts)}) if looks else []
    sent = spark.sparkContext.broadcast(_written(pa.table([pa.array([x for x, _ in bounds], pa.string()), pa.array([x for _, x in bounds], pa.binary())], schema=LOOKED_SCHEMA)))
    dealt = texts.mapInArrow(_runs(sent), RUNS).repartition(len(bounds) + 1, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_begun(support), COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, support: int = 100) -> DataFrame:
    """(lang, phrase, f, n): every phrase of 1 to 5 words that occurs ``support`` times in its language.

    ``docs`` is (lang, text). A null lang is ``und``, a null text empty; rows may repeat; an empty
    table gives no rows. ``phrase`` is the words in UTF-8, joined by spaces; n counts the language's
    words.

    Rows are dealt evenly, whatever their keys, over shards of a bounded number of bytes. A shard is
    mined completely at the support that its share of the words leaves; what no shard reports can't
    reach the global support. A phrase's local counts, with the most that shards without a report
    may hide, bound its global count; candidates below the support by that bound go. The rest are
    counted in all texts.

    With so many shards that their support is below LEAST_LOCAL, or with more candidates than may be
    sent to every task, the local support is 1, so the sums of the local counts are exact by themselves.
    Then a shard's phrases aren't written out: its sorted runs of words hold them all, one run a word.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    plain = docs.select(lang, text)
    counted = F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")).alias("n")
    totals = cut(plain.groupBy("lang").agg(counted, F.sum(F.octet_length("text").cast("long")).alias("bytes")).where("n > 0"))
    size = totals.agg(F.sum("bytes"), F.count(F.lit(1)), F.sum("n")).first()
    if not size[1]:
        return spark.createDataFrame([], "lang string, phrase binary, f long, n long")
    shards = max(LEAST_SHARDS, -(-size[0] // SHARD_BYTES))
    known = totals.select(F.col("lang").alias("_lang"), "n")
    known = F.broadcast(known) if size[1] <= 100_000 else known
    exact = _confirmed(plain, known, size[1], shards, support) if -(-support // shards) >= LEAST_LOCAL else None
    if exact is None:
        exact = _counted(plain, size[2], size[0], support)
    exact = exact.where(F.col("f") >= support)
    return cut(exact.join(known, F.col("lang") == F.col("_lang")).select("lang", "phrase", "f", "n"))


def _confirmed(plain: DataFrame, known: DataFrame, n_langs: int, shards: int, support: int) -> DataFrame | None:
    """(lang, phrase, f) of the phrases that shards report; None where the candidates are too many to be sent."""
    spark = plain.sparkSession
    # the input's own order deals rows evenly, also where one key or text fills the table
    dealt = plain.join(known, F.col("lang") == F.col("_lang")).select("lang", F.col("text").cast("binary"), "n")
    dealt = dealt.withColumn("shard", F.monotonically_increasing_id() % shards).repartition(shards, "shard").drop("shard")
    local = cut(dealt.mapInArrow(_mine(support), LOCAL).groupBy("lang", "phrase").agg(F.sum("part").alias("part")))
    hidden = local.where("phrase is null").select(F.col("lang").alias("_lang"), F.col("part").alias("hidden"))
    hidden = F.broadcast(hidden) if n_langs <= 100_000 else hidden
    candidates = cut(local.where("phrase is not null").join(hidden, F.col("lang") == F.col("_lang")).where(F.col("part") + F.col("hidden") >= support))
    exact = candidates.where("hidden = 0").select("lang", "phrase", F.col("part").alias("f"))
    open_ = candidates.where("hidden > 0").select("lang", "phrase")
    unknown = open_.limit(SENT_ROWS + 1).count()
    if unknown > SENT_ROWS:
        return None
    if unknown:
        sent = spark.sparkContext.broadcast(_written(open_.toArrow()))
        seen = plain.select("lang", F.col("text").cast("binary")).mapInArrow(_count(sent), PARTS)
        exact = exact.union(seen.repartition("block").sortWithinPartitions("block").mapInArrow(_add(sent), COUNTS))
    return exact


def collocations(docs: DataFrame, support: int = 100, most: int = 2000) -> DataFrame:
    """The first ``most`` collocations of every language of ``docs`` (lang, text).

    A phrase of 2 to 5 words with a occurrences, cut into parts with l and r, scores
    floor(1000 a n / (l r)), by the cut with the lowest score, of equal ones that after the fewest
    words. Phrases whose words lie in a longer phrase of as many occurrences go. Exact in decimals;
    numerators beyond 38 digits fail with an error. Returns lang, rank, phrase, a, l, r, n, score.
    """
    counts = phrase_counts(docs, support)
    words = F.split(F.col("phrase").cast("string"), " ")
    phrases = counts.select("lang", F.col("phrase").cast("string").alias("phrase"), words.alias("words"), "f", "n").where(F.size("words") > 1)
    joined = lambda x: F.array_join(x, " ")
    # every part of a phrase occurs as often as the phrase, so it is in the table
    parts = counts.select(F.col("lang").alias("_lang"), F.col("phrase").cast("string").alias("part"), F.col("f").alias("of"))
    size = F.size("words")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "f", "n", "k", joined(F.slice("words", 1, F.col("k"))).alias("head"), joined(F.slice("words", F.col("k") + 1, size - F.col("k"))).alias("rest"))
    heads, rests = parts.toDF("hl", "hp", "l"), parts.toDF("rl", "rp", "r")
    met = cuts.join(heads, (F.col("lang") == F.col("hl")) & (F.col("head") == F.col("hp")))
    met = met.join(rests, (F.col("lang") == F.col("rl")) & (F.col("rest") == F.col("rp")))
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(f as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = met.select("lang", "phrase", F.col("f").alias("a"), "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    # phrases of two words and more inside each longer phrase
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda at: F.array_join(F.slice("words", at, k), " "))))
    inner = phrases.where(size > 2).select("lang", "f", F.explode(F.array_distinct(spans)).alias("part"))
    inner = inner.groupBy("lang", "part").agg(F.max("f").alias("longer")).toDF("il", "part", "longer")
    kept = lowest.join(inner, (F.col("lang") == F.col("il")) & (F.col("phrase") == F.col("part")), "left")
    kept = kept.where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    flat = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows by plain counting.
SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT lang, w, i, unnest(range(1, 6)) AS k FROM starts),
counts AS (
  SELECT lang, w[i:i + k - 1] AS p, count(*) AS f FROM grams WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM counts WHERE len(p) > 1),
scores AS (
  SELECT c.lang, c.p, c.f AS a, c.k, h.f AS l, t.f AS r, n,
         ((1000::HUGEINT * c.f * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN counts h ON h.lang = c.lang AND h.p = c.p[1:c.k]
  JOIN counts t ON t.lang = c.lang AND t.p = c.p[c.k + 1:]),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
spans AS (SELECT lang, p, f, unnest(range(1, len(p))) AS i FROM counts WHERE len(p) > 2),
inner_spans AS (SELECT lang, p, f, i, unnest(range(2, len(p))) AS k FROM spans),
longer AS (SELECT lang, p[i:i + k - 1] AS part, max(f) AS f FROM inner_spans WHERE i + k - 1 <= len(p) GROUP BY ALL),
kept AS (
  SELECT s.*, array_to_string(s.p, ' ') AS phrase FROM lowest s
  LEFT JOIN longer g ON g.lang = s.lang AND g.part = s.p WHERE g.f IS NULL OR g.f < s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
