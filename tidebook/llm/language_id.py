"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.llm.common import cut, unit

#: Code points above this one share a class, as do all characters that aren't letters.
TABLE = 1 << 16
#: A text is parsed in stretches of so many characters, a phrase ending with its stretch.
STRETCH = 1024
#: Stretches that are parsed side by side.
SIDE = 2048
#: Counts of up to so many languages go to every executor, at a few dozen bytes each; more are shuffled.
BROADCAST_LANGUAGES = 10_000
RESULT = "doc_id long, lang_pred string, score double"


class SuffixAutomaton:
    """Accepts every substring of a sequence of small integers.

    ``step`` has a row for each state and a column for each symbol: the state reached, or, where
    the substring read so far doesn't go on, minus the state after starting anew with that symbol,
    minus 1. So a greedy parse into longest matches is a walk that counts negative steps.
    """

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            current = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = current
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[current] = q
                else:
                    clone = len(nexts)
                    nexts.append(nexts[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[current] = clone
            last = current
        states = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
        keys = np.fromiter((c for x in nexts for c in x), np.int64, len(states))
        goals = np.fromiter((s for x in nexts for s in x.values()), np.int32, len(states))
        # a symbol that doesn't occur is a phrase of its own: a last state from which nothing goes on
        fresh = np.full(size, len(nexts), np.int32)
        fresh[keys[states == 0]] = goals[states == 0]
        self.step = np.tile(-fresh - 1, (len(nexts) + 1, 1))
        self.step[states, keys] = goals
        self.step[0] = fresh
        self.flat, self.width, self.bits = self.step.reshape(-1), size, math.log2(len(symbols) + 1)

    def phrases(self, block: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many longest matches each row of symbols falls into; rows come longest first."""
        state, count = np.zeros(len(block), np.int32), np.zeros(len(block), np.int32)
        columns = np.ascontiguousarray(block.T)
        alive = np.searchsorted(-lengths, -np.arange(len(columns)), side="left")
        for at, n in enumerate(alive):
            if not n:
                break
            reached = self.flat[state[:n] * self.width + columns[at, :n]]
            ended = reached < 0
            count[:n] += ended
            state[:n] = np.where(ended, -reached - 1, reached)
        return count + (lengths > 0)


class Parser:
    """One automaton for each language over a common alphabet of letters and a blank."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        letters = sorted({c for x in samples.values() for c in x.lower() if c.isalpha() and ord(c) < TABLE})
        self.classes = np.zeros(TABLE, np.int32)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        unknown = len(letters) + 1
        self.letter = np.zeros(TABLE, bool)
        self.letter[[i for i in range(TABLE) if chr(i).isalpha()]] = True
        self.classes[self.letter & (self.classes == 0)] = unknown
        self.unknown, size = unknown, unknown + 1
        self.automata = [SuffixAutomaton(self.symbols(samples[x]), size) for x in self.languages]

    def symbols(self, text: str) -> np.ndarray:
        """Letters as their class; every run of other characters as one blank."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        classes = self.classes[np.minimum(points, TABLE - 1)]
        beyond = points >= TABLE
        if beyond.any():
            letters = [p for p in np.unique(points[beyond]).tolist() if chr(p).isalpha()]
            classes = np.where(beyond, np.where(np.isin(points, letters), self.unknown, 0), classes)
        return classes[(classes != 0) | (np.concatenate(([1], classes[:-1])) != 0)].astype(np.int32) if len(classes) else classes.astype(np.int32)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        coded = [self.symbols(x) for x in texts]
        owners, parts = [], []
        for i, x in enumerate(coded):
            for at in range(0, len(x), STRETCH):
                owners.append(i)
                parts.append(x[at : at + STRETCH])
        totals = np.zeros((len(texts), len(self.languages)))
        order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
        for at in range(0, len(order), SIDE):
            chosen = order[at : at + SIDE]
            lengths = np.array([len(parts[k]) for k in chosen])
            block = np.zeros((len(chosen), lengths[0]), np.int32)
            for row, k in enumerate(chosen):
                block[row, : lengths[row]] = parts[k]
            for j, automaton in enumerate(self.automata):
                np.add.at(totals[:, j], [owners[k] for k in chosen], automaton.phrases(block, lengths) * automaton.bits)
        best = totals.argmin(1)
        odds = np.exp2(np.maximum(totals.min(1)[:, None] - totals, -1000)).sum(1)
        spoken = [bool((x != 0).any()) for x in coded]
        names = [self.languages[b] if s else "und" for b, s in zip(best, spoken, strict=True)]
        return names, [float(1 / o) if s else 0.0 for o, s in zip(odds, spoken, strict=True)]


def learn(docs: DataFrame, sample_chars: int = 100_000, piece_chars: int = 2_000, seed: int = 17) -> dict[str, str]:
    """A sample of labelled text for each language, ``sample_chars`` characters at most.

    The documents with the smallest hashes of their ids give ``piece_chars`` characters each, at
    most, so that a long document is not a language's whole sample. These two parameters bound what is
    fitted on. Rows without text, letters, language or id are passed over, and so are repeated
    rows, which share one hash: of the rows of one id and language the smallest piece is taken.
    A language's ids are counted over usable rows only, so none of the others thins its sample.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike("\\p{L}"))
    rows = 4 * math.ceil(sample_chars / piece_chars) + 400
    counts = cut(docs.groupBy(F.col("lang").alias("_lang")).agg(F.approx_count_distinct("doc_id", 0.02).alias("_n")))
    if counts.count() <= BROADCAST_LANGUAGES:  # or all texts of a language would meet in one task
        counts = F.broadcast(counts)
    place = unit(F.lit(seed), F.col("doc_id").cast("string"))
    # hashes are even and the count is off by a few percent, so three times the ids that are needed lie about below this bound at any size
    early = docs.select("doc_id", "lang", "text", place.alias("_h")).join(counts, F.col("lang") == F.col("_lang")).where(F.col("_h") * F.col("_n") <= 3 * rows)
    usable = early.select("lang", "_h", F.substring("text", 1, piece_chars).alias("piece"))
    usable = usable.groupBy("lang", "_h").agg(F.min("piece").alias("piece"))
    first = usable.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "piece"))).where(F.col("_r") <= rows)
    pieces = first.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("_r", "piece"))).alias("p")).collect()
    return {r["lang"]: " ".join(x["piece"] for x in r["p"])[:sample_chars] for r in pieces}


_PARSERS: dict[str, Parser] = {}


def _predict(samples, digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[digest] = Parser(samples.value)
        for batch in batches:
            names, scores = _PARSERS[digest].predict([x.as_py() for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    Every whole text is parsed greedily into the longest stretches that occur in a language's
    sample; with c phrases and a sample of N symbols the parse costs c * log2(N) bits, and the
    language of the lowest cost wins, the first in order of name if several share it. The score
    is the winner's share when every language counts by 2 to the minus of its cost. Null texts
    and texts without a letter give ``und`` and score 0; so does every text without any sample.
    Repeated rows all stay; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if not samples:
        return narrow.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    digest = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    return narrow.mapInArrow(_predict(spark.sparkContext.broadcast(samples), digest), RESULT)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves ``part`` modulo ``parts``; null keys do not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))
