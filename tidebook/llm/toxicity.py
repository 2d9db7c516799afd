"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import cut, free_name

#: A word is a run of letters, in lower case. A pattern is the beginning of a longer word, written with a star.
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = range(4, 9)
#: Voters on the hits of all terms: so many for each thousand words, or so many different terms.
DENSITIES, VARIETIES = (1, 3, 10), (2, 4)
MOST_TERMS = 56
ROUNDS = 8
#: A task that counts terms passes its counts on when it holds so many.
HELD_TERMS = 1 << 16


def terms_of(words: Counter) -> Iterator[str]:
    """The different words of a text and their beginnings."""
    seen = set()
    for w in words:
        yield w
        for k in BEGINNINGS:
            if k >= len(w):
                break
            seen.add(w[:k])
    for s in seen:
        yield s + "*"


@dataclass(frozen=True)
class Voters:
    """Terms that vote for toxicity where they occur, words or patterns."""

    terms: tuple[str, ...]

    @property
    def size(self) -> int:
        return len(self.terms) + len(DENSITIES) + len(VARIETIES)

    def counter(self):
        """A function from a text to its number of words, the terms it has and how often."""
        whole = {t: i for i, t in enumerate(self.terms) if not t.endswith("*")}
        begins: dict[str, list[tuple[str, int]]] = {}
        for i, t in enumerate(self.terms):
            if t.endswith("*"):
                begins.setdefault(t[: BEGINNINGS[0]], []).append((t[:-1], i))

        def count(text: str | None) -> tuple[int, list[int], list[int]]:
            words = Counter(WORD.findall((text or "").lower()))
            hits: Counter = Counter()
            for w, n in words.items():
                if w in whole:
                    hits[whole[w]] += n
                for start, i in begins.get(w[: BEGINNINGS[0]], ()):
                    if len(w) > len(start) and w.startswith(start):
                        hits[i] += n
            found = sorted(hits)
            return sum(words.values()), found, [hits[i] for i in found]

        return count

    def mask(self, words: int, found: list[int], counts: list[int]) -> int:
        """All votes as bits: the terms, then densities, then varieties."""
        bits = sum(1 << i for i in found)
        at, rate = len(self.terms), 1000 * sum(counts) / max(words, 1)
        for j, least in enumerate(DENSITIES):
            bits |= (rate >= least) << (at + j)
        for j, least in enumerate(VARIETIES):
            bits |= (len(found) >= least) << (at + len(DENSITIES) + j)
        return bits


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, seed: int = 23) -> DataFrame | None:
    """(text, toxic, mass) of the ``sample_rows`` ids of each label with the smallest hashes.

    ``labels`` is (doc_id, toxic). Rows with a null or of a missing document are passed over, repeats
    count once, of two labels of one document 1 counts, and of several texts of one id the least.
    ``mass`` adds up to each label's share of all labels. None without both labels.
    """
    clean = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    clean = clean.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in clean.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return None
    some = [clean.where(F.col("toxic") == v).orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(sample_rows) for v in (0, 1)]
    few = F.broadcast(some[0].union(some[1]))
    met = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("text")).join(few, F.col("_doc") == F.col("_id"))
    texts = cut(met.groupBy("_id", "toxic").agg(F.min("text").alias("text")))
    got = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(got) < 2:
        return None
    part = {v: shares[v] / sum(shares.values()) / got[v] for v in (0, 1)}
    mass = F.when(F.col("toxic") == 1, F.lit(part[1])).otherwise(F.lit(part[0]))
    return texts.select("text", "toxic", mass.alias("mass"))


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, n) of (text, toxic) rows: in how many texts a term is, passed on in parts that the caller adds up.

    A part ends with the text that brings its terms to ``HELD_TERMS``, so a task holds so many and those of
    one text, however many texts its batch has.
    """
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])
    seen: Counter = Counter()

    def part() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen]), pa.array([v for _, v in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], schema=schema)
        seen.clear()
        return made

    for data in batches:
        for text, toxic in zip(data.column(0), data.column(1).to_pylist(), strict=True):
            seen.update((t, toxic) for t in terms_of(Counter(WORD.findall(text.as_py().lower()))))
            if len(seen) >= HELD_TERMS:
                yield part()
    if seen:
        yield part()


def choose_voters(sample: DataFrame) -> Voters:
    """The terms that tell the labels of the sample apart best, those of toxic documents only.

    Terms are ranked by the likelihood ratio of their document counts; of nested terms with equal
    counts only the best stays. Bounded: some thousand terms reach the driver, at most
    ``MOST_TERMS`` stay.
    """
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(term_counts, "term string, toxic int, n long")
    sums = counted.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("f"))
    p, q = F.col("t") / F.lit(float(sizes[1])), F.col("f") / F.lit(float(sizes[0]))
    both = (F.col("t") + F.col("f")) / F.lit(float(sizes[0] + sizes[1]))
    logs = lambda n, share: F.when(n > 0, n * F.log(share / both)).otherwise(F.lit(0.0))
    least = max(3, sizes[1] // 200)
    ranked = sums.where((F.col("t") >= least) & (p > 4 * q)).select("term", "t", "f", (logs(F.col("t"), p) + logs(F.col("f"), q)).alias("gain"))
    best = ranked.orderBy(F.col("gain").desc(), "term").limit(2000).collect()
    chosen: list = []
    for r in best:
        stem = r["term"].rstrip("*")
        nested = any((c["t"], c["f"]) == (r["t"], r["f"]) and (stem.startswith(c["term"].rstrip("*")) or c["term"].startswith(stem)) for c in chosen)
        if not nested:
            chosen.append(r)
        if len(chosen) == MOST_TERMS:
            break
    return Voters(tuple(r["term"] for r in chosen))


def votes(docs: DataFrame, voters: Voters, *carried: str) -> DataFrame:
    """The carried columns with words (long), found and counts (arrays of int) and mask (long) of each text."""
    names = [free_name(carried, n) for n in ("words", "found", "counts", "mask")]
    frame = docs.select(*carried, "text")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]] + [f"{n} {t}" for n, t in zip(names, ("long", "array<int>", "array<int>", "long"), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = voters.counter()
        for data in batches:
            # one text at a time: a batch of them as Python strings may be several times its bytes
            rows = [count(t.as_py()) for t in data.column(len(carried))]
            mine = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                pa.array([voters.mask(*r) for r in rows], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*data.columns[:-1], *mine], names=[*data.schema.names[:-1], *names])

    return frame.mapInArrow(run, ddl)


def bits_of(masks: np.ndarray, size: int) -> np.ndarray:
    """One row of 0.0 and 1.0 for each mask."""
    return ((masks[:, None] >> np.arange(size)) & 1).astype(float)


@dataclass(frozen=True)
class LabelModel:
    """How often each voter votes in toxic and in other documents, and the weight that its correlations leave it."""

    prior: float
    toxic: tuple[float, ...]
    other: tuple[float, ...]
    weight: tuple[float, ...]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for each row of votes."""
        a, b, d = (np.asarray(x) for x in (self.toxic, self.other, self.weight))
        odds = math.log(self.prior / (1 - self.prior)) + (d * np.log((1 - a) / (1 - b))).sum()
        odds = odds + votes @ (d * (np.log(a / b) - np.log((1 - a) / (1 - b))))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _estimated(sums: np.ndarray, size: int) -> LabelModel:
    """The model that weighted sums of votes and of pairs of votes give."""
    flat = sums.reshape(2, -1)
    rates, shared = [], np.zeros((size, size))
    whole = flat[:, 0].sum()
    for mass, single, pairs in ((x[0], x[1 : 1 + size], x[1 + size :].reshape(size, size)) for x in flat):
        # a little mass of both votes keeps rates off 0 and 1
        rate = (single + 5e-5) / (mass + 1e-3)
        spread = np.sqrt(rate * (1 - rate))
        shared += mass / whole * (pairs / max(mass, 1e-12) - np.outer(rate, rate)) / np.outer(spread, spread)
        rates.append(rate)
    np.fill_diagonal(shared, 0)
    near = np.where(shared > 0.1, np.minimum(shared, 1), 0).sum(1)
    return LabelModel(float(np.clip(flat[1, 0] / whole, 1e-4, 0.5)), tuple(rates[1]), tuple(rates[0]), tuple(1 / (1 + near)))


def label_model(patterns: DataFrame, size: int, rounds: int = ROUNDS) -> LabelModel:
    """Fit the votes of labelled and unlabelled documents by expectation maximisation.

    ``patterns`` is (mask, toxic, mass): the mass of documents that vote alike, by their label, null
    if unknown. The first estimate comes from the labelled mass; each round weighs the unlabelled mass
    by its posterior and sums votes and pairs of votes for either class. Voters are
    taken as independent within a class but for their correlations: the sum of a voter's
    correlations above 0.1 with others in the same class divides its weight, so voters that repeat
    each other count as one.
    """
    schema = pa.schema([("sums", pa.list_(pa.float64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * (1 + size + size * size))
        for data in batches:
            for row in data.column(0):
                total += row.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], schema=schema)

    def sums(model: LabelModel | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 1 + size + size * size))
            for data in batches:
                v = bits_of(data.column(0).to_numpy(), size)
                known = data.column(1).to_numpy(zero_copy_only=False).astype(float)
                mass = data.column(2).to_numpy()
                guess = np.zeros(len(mass)) if model is None else model.posterior(v)
                mass = np.where(np.isnan(known), 0.0, mass) if model is None else mass
                of = np.where(np.isnan(known), guess, known)
                for c, w in enumerate((mass * (1 - of), mass * of)):
                    weighted = v * w[:, None]
                    total[c] += np.concatenate([[w.sum()], weighted.sum(0), (weighted.T @ v).ravel()])
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], schema=schema)

        # one row of sums a task, added up by one task and sent to the driver as one row
        return np.array(patterns.mapInArrow(run, "sums array<double>").repartition(1).mapInArrow(add, "sums array<double>").first()["sums"])

    model = _estimated(sums(None), size)
    for _ in range(rounds):
        model = _estimated(sums(model), size)
    return model


def inputs(words: np.ndarray, found: list[list[int]], counts: list[list[int]], terms: int) -> np.ndarray:
    """What the linear classifier sees: a row for each document.

    For each term the log of its count and of its count for each thousand words; the same for all
    terms together, the number of different terms, and the log of the length.
    """
    x = np.zeros((len(words), terms))
    for i, (at, n) in enumerate(zip(found, counts, strict=True)):
        if len(at):
            x[i, at] = n
    scale = 1000 / np.maximum(words, 1)[:, None]
    every = x.sum(1, keepdims=True)
    return np.hstack([np.log1p(x), np.log1p(x * scale), np.log1p(every), np.log1p(every * scale), np.log1p((x > 0).sum(1, keepdims=True)), np.log1p(words)[:, None]])


@dataclass(frozen=True)
class ToxicityModel:
    """Voters, label model and the linear classifier's weights; without voters every score is 0."""

    voters: Voters
    labels: LabelModel | None
    weights: tuple[float, ...]
    intercept: float

    def scores(self, words: np.ndarray, found: list, counts: list) -> np.ndarray:
        """Probability of toxic for documents with these words and hits."""
        if not self.weights:
            return np.zeros(len(words))
        odds = inputs(words, found, counts, len(self.voters.terms)) @ np.asarray(self.weights) + self.intercept
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit(shown: DataFrame, sample: DataFrame, voters: Voters, unlabelled_rows: int = 8000, seed: int = 29) -> ToxicityModel:
    """Label model over the votes of all documents, classifier on posterior labels of bounded samples.

    ``shown`` is ``votes`` of all documents, ``sample`` what ``labelled_sample`` gave; labelled and
    unlabelled documents weigh the same in the label model. The classifier learns from the labelled sample, whose posterior
    is its label, and from the ``unlabelled_rows`` documents that vote at all, and as many that do not,
    with the smallest hashes of their votes, each weighing as both classes by its posterior.
    """
    seen = cut(votes(sample, voters, "toxic", "mass"))
    whole = shown.count()
    free = shown.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).select("mask", F.lit(None).cast("int").alias("toxic"), (F.col("n") / F.lit(float(max(whole, 1)))).alias("mass"))
    patterns = cut(free.union(seen.groupBy("mask", "toxic").agg(F.sum("mass").alias("mass"))))
    model = label_model(patterns, voters.size)
    shares = {bool(r["v"]): r["n"] for r in shown.groupBy((F.col("mask") != 0).alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = ("words", "found", "counts", "mask")
    parts = [seen.select(*columns, "toxic", "mass")]
    order = F.xxhash64(F.lit(seed), "words", "found", "counts")
    for voted, n in shares.items():
        some = shown.where(F.col("mask") != 0) if voted else shown.where(F.col("mask") == 0)
        part = n / whole / min(n, unlabelled_rows)
        parts.append(some.orderBy(order, "words").limit(unlabelled_rows).select(*columns, F.lit(None).cast("int"), F.lit(part)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p.toDF(*rows.columns))
    terms = len(voters.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            words, found, counts = data.column(0).to_numpy(), data.column(1).to_pylist(), data.column(2).to_pylist()
            known = data.column(4).to_numpy(zero_copy_only=False).astype(float)
            of = np.where(np.isnan(known), model.posterior(bits_of(data.column(3).to_numpy(), voters.size)), known)
            x = pa.array(list(inputs(words, found, counts, terms)), pa.list_(pa.float64()))
            for label, weight in ((0.0, 1 - of), (1.0, of)):
                yield pa.RecordBatch.from_arrays([x, pa.array(np.full(len(of), label)), pa.array(weight * data.column(5).to_numpy())], names=["x", "label", "weight"])

    made = rows.mapInArrow(run, "x array<double>, label double, weight double").where("weight > 0")
    made = cut(made).select(array_to_vector("x").alias("features"), "label", (F.col("weight") * F.lit(10000.0)).alias("weight"))
    line = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=100).fit(made)
    return ToxicityModel(voters, model, tuple(float(w) for w in line.coefficients), float(line.intercept))


def scored(shown: DataFrame, model: ToxicityModel, *carried: str) -> DataFrame:
    """The carried columns of ``votes`` rows with their score, 0 to 1."""
    frame = shown.select(*carried, "words", "found", "counts")
    name = free_name(carried, "score")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-3]] + [f"{name} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            words, found, counts = data.columns[-3:]
            score = model.scores(words.to_numpy(), found.to_pylist(), counts.to_pylist())
            yield pa.RecordBatch.from_arrays([*data.columns[:-3], pa.array(score)], names=[*data.schema.names[:-3], name])

    return frame.mapInArrow(run, ddl)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic).

    A null or empty text has no votes and still a score. Repeated rows score alike; other columns
    are not read. Without labels of both kinds, or without a term that tells them apart, every
    score is 0. Each text is split into words once for all documents, and again for the sample.
    """
    found = labelled_sample(docs, labels, sample_rows)
    voters = Voters(()) if found is None else choose_voters(found)
    shown = cut(votes(docs, voters, "doc_id"))
    if not voters.terms:
        return scored(shown, ToxicityModel(voters, None, (), 0.0), "doc_id")
    return scored(shown, fit(shown, found, voters), "doc_id")
