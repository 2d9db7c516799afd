"""Personal data: fixed formats, and what bootstrapped contexts add to them. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
#: The formats, written so that no text makes the search step back over what it has read: a run
#: of name characters or digits is tried from its start only (or from the end of the last match).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these cannot hold the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+"}
#: Digits and separators up to a blank or closing punctuation.
_PART = r"[+(]?+[0-9][0-9().+/,-]*+(?![^\x20\x09-\x0D;:!?])"
#: A mention: such parts joined over single spaces, else a run of non-blank characters with a digit or an at sign.
TOKEN = rf"(?<![^\x20\x09-\x0D])(?:{_PART}(?:\x20{_PART})*+|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"


def _found(text: Column, pattern: str, guard: Column) -> Column:
    """Matches with their places: array of (start, end, match, before, after), in code points."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        F.slice(pieces, 1, F.size(matches)),
        F.zip_with(matches, F.slice(pieces, 2, F.greatest(F.size(matches), F.lit(0))), lambda m, after: F.struct(m.alias("m"), after.alias("after"))),
        lambda before, x: F.struct(F.char_length(before).alias("gap"), before.alias("before"), x["m"].alias("m"), x["after"].alias("after")),
    )
    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    placed = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + F.char_length(x["m"])).alias("at"),
            F.concat(
                s["out"],
                F.array(
                    F.struct(
                        (s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + F.char_length(x["m"])).alias("end"), x["m"].alias("match"), x["before"].alias("before"), x["after"].alias("after")
                    )
                ),
            ).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.when(guard, placed).otherwise(F.array().cast(kind))


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.char_length(digits))
    digit = lambda i: F.ascii(F.substring(digits, -i, F.lit(1))) - 48
    total = F.aggregate(places, F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        value = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.char_length(value(p)) <= 3) & (F.coalesce(value(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.char_length(digits).between(12, 19) & _luhn(digits)
    return F.char_length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _typed(found: Column, i: int) -> Column:
    """The valid matches of kind i as spans."""
    kept = F.filter(found, lambda x: _valid(KINDS[i], x["match"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))


def _number(spans: str, i: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == i)).cast("long")


def base_spans(text: Column) -> Column:
    """Spans of the fixed formats, array of (start, kind, end), kind as its place in KINDS."""
    spans = []
    for i, kind in enumerate(KINDS):
        guard = F.contains(text, F.lit(NEEDS[kind])) if len(NEEDS[kind]) == 1 else text.rlike(NEEDS[kind])
        spans.append(_typed(_found(text, PATTERNS[kind], guard), i))
    return F.array_sort(F.concat(*spans))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _mentions(text: Column) -> Column:
    """Tokens that may identify someone, without punctuation around them, and the words beside them."""
    found = _found(text, TOKEN, text.rlike("[0-9@]"))
    lead = lambda x: F.char_length(F.regexp_extract(x["match"], r"^[^\p{L}0-9+@]+", 0))
    trail = lambda x: F.char_length(F.regexp_extract(x["match"], r"(?<=[\p{L}0-9])[^\p{L}0-9]++$", 0))
    return F.filter(
        F.transform(
            found,
            lambda x: F.struct(
                (x["start"] + lead(x)).alias("start"),
                (x["end"] - trail(x)).alias("end"),
                F.substring(x["match"], lead(x) + 1, F.char_length(x["match"]) - lead(x) - trail(x)).alias("token"),
                F.lower(F.regexp_extract(x["before"], r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$", 1)).alias("left"),
                F.lower(F.regexp_extract(x["after"], r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)).alias("right"),
            ),
        ),
        lambda x: x["end"] > x["start"],
    )


def shape(token: Column) -> Column:
    """A token's form: letters as a, every digit as 9, other characters as they are."""
    return F.regexp_replace(F.regexp_replace(token, r"\p{L}+", "a"), "[0-9]", "9")


def coarse(token: Column) -> Column:
    """A token's type: an address, a number of 7 to 19 digits, another number, or letters with digits."""
    digits = F.char_length(F.regexp_replace(token, "[^0-9]", ""))
    number = F.when(digits.between(7, 19), F.lit("number")).otherwise(F.lit("short or long"))
    return F.when(F.contains(token, F.lit("@")), F.lit("address")).when(token.rlike(r"\p{L}"), F.lit("mixed")).otherwise(number)


def find_personal_data(docs: DataFrame, rounds: int = 3, support: int = 5, accept: float = 0.9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The fixed formats give the base spans, whose number is counted and whose list is hashed. They
    are also the seeds: the word (with a letter) before or after a seed is a lexical pattern of its kind,
    once with the seed's coarse type (address, number, letters with digits) and once with its exact shape. What
    stands beside such a word and is of the type is a candidate, digits joined over single spaces.
    Patterns and the tokens they match form a graph. In each round a pattern
    scores the summed belief in its tokens over their number plus one, provided it matches
    ``support`` different seeds, and an unseen token believes in a kind by the noisy-or of its two
    sides, each with the better of its patterns. Tokens that end at ``accept`` or more join ``spans`` with that kind; they never
    overlap base spans, which all stay. Every statistic is over all documents.

    Null and empty texts have no spans. Equal rows get equal results; equal ids with different
    texts are kept apart. An empty table gives no rows; other columns are not read.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(content).alias("_h"), base_spans(content).alias("base"), _mentions(content).alias("mentions"))
    read = cut(read)

    covering = F.filter("base", lambda b: (b["start"] < F.col("m.end")) & (b["end"] > F.col("m.start")))
    seen = read.where(F.size("mentions") > 0).select("doc_id", "_h", "base", F.explode("mentions").alias("m")).select("doc_id", "_h", "m", covering.alias("over"))
    first = F.get("over", F.lit(0))
    whole = (first["start"] <= F.col("m.start")) & (first["end"] >= F.col("m.end"))
    seed = F.when(whole, first["kind"])
    sides = F.array(F.struct(F.lit("<").alias("side"), F.col("m.left").alias("word")), F.struct(F.lit(">").alias("side"), F.col("m.right").alias("word")))
    tokens = seen.where((F.size("over") == 0) | whole).select(
        "doc_id", "_h", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.token").alias("token"), seed.alias("kind"), F.explode(F.filter(sides, lambda x: x["word"].rlike(r"\p{L}"))).alias("x")
    )
    # repeated rows are one document: they add nothing to any statistic
    kinds = F.array(F.xxhash64("x.side", "x.word", shape(F.col("token"))), F.xxhash64("x.side", "x.word", F.lit("type"), coarse(F.col("token"))))
    tokens = tokens.withColumn("pattern", F.explode(kinds)).withColumn("side", F.col("x.side")).drop("x").distinct()
    seeds = tokens.where("kind is not null").groupBy("pattern", "kind", "token").agg(F.count(F.lit(1)).alias("n"))
    seeds = seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("seeds")).where(F.col("different") >= support)
    unseen = tokens.where("kind is null").select("doc_id", "_h", "start", "end", "side", "pattern")
    # the graph: unseen tokens of the patterns that have seeds enough, and all tokens that such a pattern matches
    totals = tokens.groupBy("pattern").agg(F.count(F.lit(1)).alias("matched"))
    patterns = cut(seeds.join(totals, "pattern"))
    edges = cut(unseen.join(patterns.select("pattern", "kind"), "pattern"))
    here = ["doc_id", "_h", "start", "end", "kind"]
    belief = edges.select(*here, F.lit(0.0).alias("belief")).distinct()
    for _ in range(rounds):
        known = belief.select(*[F.col(c).alias(f"b_{c}") for c in here], "belief")
        same = F.expr(" and ".join(f"{c} <=> b_{c}" for c in here))
        added = edges.join(known, same).groupBy("pattern", "kind").agg(F.sum("belief").alias("added"))
        scores = patterns.join(added, ["pattern", "kind"], "left")
        scores = scores.select("pattern", "kind", ((F.col("seeds") + F.coalesce("added", F.lit(0.0))) / (F.col("matched") + 1)).alias("score"))
        sides = [F.coalesce(F.max(F.when(F.col("side") == side, F.col("score"))), F.lit(0.0)) for side in "<>"]
        belief = cut(edges.join(scores, ["pattern", "kind"]).groupBy(*here).agg((1 - (1 - sides[0]) * (1 - sides[1])).alias("belief")))
    chosen = belief.where(F.col("belief") >= accept).groupBy("doc_id", "_h", "start", "end").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"))
    added = chosen.groupBy("doc_id", "_h").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    added = added.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_g"), "added")
    out = read.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    counts = [_number("base", i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(spans).alias("spans"))
