"""Quality scores by Bradley-Terry pairwise ranking, cut at a score quantile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.llm.common import BLANKS, cut, free_name

#: Fixed value: characters counted as symbols.
SYMBOLS = "$%&*#!@|^~<>={}[]\\/_"
#: Labels up to this number are sent to the documents; beyond it the documents' features go to the labels.
SENT_LABELS = 500_000
FEATURES = ("words", "word_length", "unique_words", "repeated_words", "symbols", "upper_case", "digits", "repeated_lines", "stops")


def split_texts(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The documents with two more columns, the words and the non-empty lines of the text.

    A projection of their own lets Spark split a text once for all features.
    """
    text = F.coalesce("text", F.lit(""))
    words, lines = free_name(docs.columns, "_words"), free_name(docs.columns, "_lines")
    parts = [F.filter(F.split(text, by), lambda x: x != "").alias(name) for by, name in ((BLANKS, words), ("\n", lines))]
    return docs.select("*", *parts), F.col(words), F.col(lines)


def features(text: Column, words: Column, lines: Column) -> list[Column]:
    """What a text shows of its quality, as doubles in the order of FEATURES.

    Counts over the whole text, each put in relation to its length; a null text counts as empty.
    All are 0 for a text without words.
    """
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    lost = lambda pattern: (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))) / chars
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    after = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    same = F.array_remove(F.zip_with(words, after, lambda a, b: a.eqNullSafe(b)), False)
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    return [
        F.log1p(F.size(words)),
        F.least(F.char_length(text) / n, F.lit(20.0)),
        F.size(F.array_distinct(words)) / n,
        F.size(same) / n,
        F.sqrt((F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))) / chars),
        F.sqrt(F.char_length(F.regexp_replace(text, "\\P{Lu}+", "")) / chars),
        F.sqrt(lost("[0-9]+")),
        1 - F.size(F.array_distinct(lines)) / n_lines,
        F.sqrt(lost("[.,]+")),
    ]


@dataclass(frozen=True)
class PairwiseModel:
    """Feature weights and the score at which a document is accepted."""

    weights: tuple[float, ...]
    threshold: float

    def score(self, text: Column, words: Column, lines: Column) -> Column:
        """0 to 1, 0.5 at the threshold; for any text, empty and null ones too."""
        # plain sums, since the arguments of a lambda function aren't compiled
        strength = sum((F.coalesce(x, F.lit(0.0)) * F.lit(w) for x, w in zip(features(text, words, lines), self.weights, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-(strength - F.lit(self.threshold))))


#: Accepts everything; what a corpus without two classes of labels gives.
ACCEPT_ALL = PairwiseModel((0.0,) * len(FEATURES), 0.0)


def _ranked(known: DataFrame) -> DataFrame:
    """(quality, x, r): the place of every row among those of its label, from 0, in the order of the hashes.

    Places are counted inside 4,096 ranges of hashes, and the ranges' starts come from their sizes.
    """
    parts = known.withColumn("_p", F.shiftright("_h", 52).cast("int"))
    earlier = Window.partitionBy("quality").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("quality", "_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    order = Window.partitionBy("quality", "_p").orderBy("_h", "_id", "x")
    placed = parts.withColumn("_r", F.row_number().over(order) - 1).join(F.broadcast(starts.drop("_n")), ["quality", "_p"])  # 8,192 rows
    return placed.select("quality", "x", (F.col("_start") + F.col("_r")).alias("r"))


def _threshold(strengths: DataFrame, shares: dict[int, int], counts: dict[int, int], parts: int = 4096) -> float | None:
    """The least strength up to which more rows lie than labels are 0, or None; rows stand in for their label's share.

    The range that holds it is split into parts, of which only counts are looked at, until it is a single value.
    """
    upto = F.col("n1") * F.lit(shares[1]) / F.lit(counts[1]) + F.col("n0") * F.lit(shares[0]) / F.lit(counts[0])
    counted = lambda q: F.count_if(F.col("quality") == q)
    summed = Window.orderBy("low")
    below, low, high = {0: 0, 1: 0}, float("-inf"), float("inf")
    while True:
        inside = strengths.where(F.col("s").between(low, high))
        ends = inside.agg(F.min("s").alias("a"), F.max("s").alias("z"))
        step = F.coalesce(F.floor(F.try_divide((F.col("s") - F.col("a")) * parts, F.col("z") - F.col("a"))), F.lit(0))
        ranges = inside.crossJoin(F.broadcast(ends)).groupBy(step.alias("_p")).agg(  # one row of ends
            F.min("s").alias("low"), F.max("s").alias("high"), counted(0).alias("m0"), counted(1).alias("m1")
        )
        totals = ranges.select("low", "high", "m0", "m1", *[(F.sum(f"m{q}").over(summed) + F.lit(below[q])).alias(f"n{q}") for q in (0, 1)])
        first = totals.where(upto > shares[0]).orderBy("low").first()
        if first is None:
            return None
        if first["low"] == first["high"]:
            return float(first["low"])
        below = {q: first[f"n{q}"] - first[f"m{q}"] for q in (0, 1)}
        low, high = first["low"], first["high"]


def fit(docs: DataFrame, labels: DataFrame, rounds: int = 4, regularisation: float = 1e-4, seed: int = 17) -> PairwiseModel:
    """Learn from preference pairs between documents labelled 1 and 0.

    ``labels`` is (doc_id, quality); rows with a null, or of a document that isn't there, are
    passed over; repeated rows of one label count once, and of the texts of one id the one with the
    least features is taken. All labels count: in the order of the hashes of their ids each document meets
    ``rounds`` others of the opposite label, and the log-odds that it wins are linear in the difference
    of the two feature vectors. The threshold is the score quantile below which the share of label 0 lies,
    with that share counted over all labels. Without both labels everything is accepted.
    """
    clean = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where("_id is not null and quality in (0, 1)").distinct()
    shares = {r["quality"]: r["n"] for r in clean.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return ACCEPT_ALL
    hashed = clean.withColumn("_h", F.xxhash64(F.lit(seed), "_id"))
    texts = docs.select(F.col("doc_id").alias("_doc"), "text")
    own = F.col("_doc") == F.col("_id")
    if sum(shares.values()) <= SENT_LABELS:
        seen, words, lines = split_texts(texts.join(F.broadcast(hashed), own))
        shown = seen.select("quality", "_h", "_id", F.array(*features(F.col("text"), words, lines)).alias("x"))
    else:  # texts don't move
        seen, words, lines = split_texts(texts)
        shown = seen.select("_doc", F.array(*features(F.col("text"), words, lines)).alias("x")).join(hashed, own).drop("_doc")
    known = cut(shown.groupBy("quality", "_h", "_id").agg(F.min("x").alias("x")))
    ranked = _ranked(known)
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return ACCEPT_ALL
    good = ranked.where("quality = 1").select(F.col("x").alias("good"), F.col("r").alias("gr"))
    bad = ranked.where("quality = 0").select(F.col("x").alias("bad"), F.col("r").alias("br"))
    turns = F.array(*[F.lit(k * 7919) for k in range(rounds)])
    rows = max(counts.values())
    meets = good.sparkSession.range(rows).withColumn("turn", F.explode(turns))
    meets = meets.select((F.col("id") % counts[1]).alias("m1"), ((F.col("id") + F.col("turn")) % counts[0]).alias("m0"), ((F.col("id") + F.col("turn")) % 2).alias("side"))
    pairs = meets.join(good, meets["m1"] == good["gr"]).join(bad, meets["m0"] == bad["br"])
    sign = F.when(F.col("side") == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    named = [((F.element_at("good", i + 1) - F.element_at("bad", i + 1)) * sign).alias(f"f{i}") for i in range(len(FEATURES))]
    differences = VectorAssembler(inputCols=[f"f{i}" for i in range(len(FEATURES))], outputCol="difference").transform(
        pairs.select(F.col("side").cast("double").alias("won"), *named)
    )
    if differences.select("won").distinct().count() < 2:
        return ACCEPT_ALL
    wins = LogisticRegression(featuresCol="difference", labelCol="won", fitIntercept=False, regParam=regularisation, maxIter=200)
    weights = tuple(float(w) for w in wins.fit(differences.select("won", "difference")).coefficients)
    strength = F.aggregate(F.zip_with("x", F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    threshold = _threshold(known.select("quality", strength.alias("s")), shares, counts)
    return PairwiseModel(weights, threshold if threshold is not None else 0.0)


def scored(docs: DataFrame, model: PairwiseModel, column: str = "score") -> DataFrame:
    """The documents with their score; a clashing column of that name goes."""
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    split, words, lines = split_texts(docs)
    return split.select(*kept, model.score(F.col("text"), words, lines).alias(column))


def keep_accepted(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """The documents that the model accepts, as they are."""
    name = free_name(docs.columns, "_score")
    return scored(docs, model, name).where(F.col(name) >= 0.5).drop(name)
