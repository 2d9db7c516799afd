"""Benchmark decontamination by templates: windows of canonical tokens, then consistent slots.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import cut

#: Units of measure that may follow a number.
UNITS = "km|kg|cm|mm|mg|ml|m|g|l|lb|lbs|oz|ft|in|mi|mph|kmh|h|hr|hrs|min|s|sec|ms|w|kw|v|a|hz|k|c|f|usd|eur|gbp|percent|dollars?|euros?|cents?|pounds?|miles?|metres?|meters?|kilometres?|kilometers?|grams?|kilograms?|litres?|liters?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|degrees?"
#: Marks before a token: a name, a number, a unit.
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
#: Up to so many candidates go to every executor, at a few dozen bytes each; more are shuffled.
BROADCAST_ROWS = 50_000
#: A run has so many equal words or values, however few words an item has beside its placeholders.
LEAST = 4
#: Blanks that aren't a single space.
OTHER_BLANKS = r"[\s\u0085\p{Z}&&[^\x20]][\s\u0085\p{Z}]*+|\x20[\s\u0085\p{Z}]++"
#: A character, with its marks, of a script that is written without spaces.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\u30FC\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]\p{M}*+)"
#: All characters of these scripts lie here; a plain range is quickly looked for.
HIGH = r"[\x{0E00}-\x{10FFFF}]"


def _without_marks(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    taken = F.contains(text, F.lit(NAME)) | F.contains(text, F.lit(NUMBER)) | F.contains(text, F.lit(UNIT))
    return F.when(taken, F.regexp_replace(text, "[\u0001-\u0003]", " ")).otherwise(text)


def _named(text: Column) -> Column:
    text = F.regexp_replace(text, OTHER_BLANKS, " ")
    return F.regexp_replace(text, r"\x20(?<=[\p{L}\p{N}][,;]?\x20)(\p{Lu}[\p{Ll}\p{M}]+)(?!\p{Lu})", f" {NAME}$1")


def _numbered(text: Column) -> Column:
    numbers = F.regexp_replace(text, r"(?<![\p{L}\p{N}])([0-9]++)", f"{NUMBER}$1 ")
    units = F.regexp_replace(numbers, rf"(?i)(?<=[0-9]\x20{{1,2}})({UNITS}|[%°])(?![\p{{L}}\p{{N}}])", f"{UNIT}$1")
    return F.when(text.rlike("[0-9]"), units).otherwise(text)


def _spaced(text: Column) -> Column:
    return F.when(text.rlike(HIGH), F.regexp_replace(text, UNSPACED, " $1 ")).otherwise(text)


def _split(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}\\p{N}%°\u0001-\u0003]+", " ")
    return F.filter(F.split(plain, " "), lambda x: x != "")


#: From a text to its marked tokens.
STEPS = (_without_marks, _named, _numbered, _spaced, _split)


def marked_tokens(text: Column) -> Column:
    """Lower-case tokens without punctuation; names, numbers and units carry a mark before them.

    A name is a word within a sentence of one capital and small letters; a unit stands behind a number; a number is a run
    of digits, so that 3.5 is two. Blanks of any kind and number are one space. Each character of a script without spaces is a token.
    """
    for step in STEPS:
        text = step(text)
    return text


def with_tokens(frame: DataFrame, text: str, name: str) -> DataFrame:
    """The frame with the marked tokens of a text in its place, under another name.

    Each step is a projection of its own: its result is used more than once by the next, and as
    one expression every use would compute it anew.
    """
    rest = [c for c in frame.columns if c != text]
    for step in STEPS:
        frame = frame.select(*rest, step(F.col(text)).alias(text))
    return frame.withColumnRenamed(text, name)


def canonical(tokens: Column) -> Column:
    """The template of marked tokens: a marked token becomes its mark."""
    return F.transform(tokens, lambda x: F.when(F.ascii(x) <= 3, F.left(x, F.lit(1))).otherwise(x))


def plain(tokens: Column) -> Column:
    """Marked tokens without their marks."""
    return F.transform(tokens, _value)


def folded(tokens: Column) -> Column:
    """Marked tokens with only numbers as marks, so that neither case nor what stands before a name matters."""
    return F.transform(tokens, lambda x: F.when(F.startswith(x, F.lit(NUMBER)), F.lit(NUMBER)).otherwise(_value(x)))


def _value(token: Column) -> Column:
    return F.translate(token, NAME + NUMBER + UNIT, "")


def _windows(window: int, *kinds: str) -> Column:
    """(place, hashes) of every window of columns that hold the same tokens in several forms."""
    n = F.size(kinds[0]) - window
    places = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    hashes = lambda i: [F.xxhash64(F.slice(k, i + 1, window)) for k in kinds]
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.array(*hashes(i)).alias("hashes")))


def _met(tokens: DataFrame, windows: Column, place: str, *names: str) -> DataFrame:
    """The names, place and each different hash of all windows."""
    rows = tokens.select(*names, F.explode(windows).alias("w"))
    return rows.select(*names, F.col("w.place").alias(place), F.explode(F.array_distinct("w.hashes")).alias("hash"))


def _anchored(items: DataFrame, window: int) -> DataFrame:
    """(key, offset, length, hash, number, at, short): one anchor token for each window of an item, and for each short item.

    The anchor is the window's longest word; a window without words has a number as anchor, one of names and
    units only its first mark. ``key`` is the hash of the anchor as ``folded`` has it, or of the
    mark, ``offset`` its place in the window, ``hash`` that of the whole window. Two windows that
    agree have the same token at the anchor, so a document's window is met at that token.
    """
    def anchor(part: Column, ranked) -> Column:
        one = lambda x, i: F.struct(ranked(x).alias("rank"), F.char_length(x).alias("chars"), (-i).alias("place"), x.alias("token"))
        return F.array_max(F.transform(part, one))

    number = lambda x: F.startswith(x, F.lit(NUMBER))
    typed = lambda x: F.when(F.ascii(x) > 3, F.lit(2)).when(number(x), F.lit(1)).otherwise(F.lit(0))
    untyped = lambda x: F.when(number(x), F.lit(1)).otherwise(F.lit(2))
    part = lambda i, n: F.slice("item", i + 1, n)
    entry = lambda i, n, found, hash_: F.struct(i.alias("at"), F.lit(n).alias("length") if isinstance(n, int) else n.alias("length"), found.alias("anchor"), hash_.alias("hash"))
    places = F.sequence(F.lit(0), F.size("item") - window)
    both = F.transform(
        places,
        lambda i: F.array(
            entry(i, window, anchor(part(i, window), typed), F.xxhash64(canonical(part(i, window)))),
            entry(i, window, anchor(part(i, window), untyped), F.xxhash64(folded(part(i, window)))),
        ),
    )
    long = items.where(F.size("item") >= window).select("number", F.explode(F.flatten(both)).alias("w"), F.lit(False).alias("short"))
    short = items.where(F.size("item") < window).select(
        "number", entry(F.lit(0), F.size("item"), anchor(F.col("item"), untyped), F.xxhash64(plain(F.col("item")))).alias("w"), F.lit(True).alias("short")
    )
    token = F.col("w.anchor.token")
    key = F.when(F.col("w.anchor.rank") == 0, F.xxhash64(F.left(token, F.lit(1)))).otherwise(F.xxhash64(_key(token)))
    rows = long.unionByName(short).select(
        key.alias("key"), (-F.col("w.anchor.place")).alias("offset"), "w.length", "w.hash", "number", "w.at", "short", (F.col("w.anchor.rank") == 0).alias("marked")
    )
    return rows.dropDuplicates(["number", "at", "hash"])


def _key(token: Column) -> Column:
    """A token as ``folded`` has it, in compiled code."""
    return F.when(F.ascii(token) > 3, token).when(F.startswith(token, F.lit(NUMBER)), F.lit(NUMBER)).otherwise(F.substring(token, 2, 1 << 30))


def _by_anchor(named: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, text_hash, number, short, shift) of every window that a document shares with an item.

    Each token is looked up among the anchors; the few windows around those found are hashed.
    """
    rows = named.select("doc_id", "text_hash", "tokens", F.posexplode_outer("tokens").alias("p", "t"))  # outer: no filter by the tokens, which would compute them twice
    columns = ["doc_id", "text_hash", "tokens", "p"]
    found = rows.select(*columns, F.xxhash64(_key(F.col("t"))).alias("key")).join(F.broadcast(anchors.where("not marked")), "key")
    marks = anchors.where("marked")
    if not marks.isEmpty():
        names = rows.where(F.ascii("t").isin(1, 3)).select(*columns, F.xxhash64(F.left("t", F.lit(1))).alias("key"))
        found = found.unionByName(names.join(F.broadcast(marks), "key"))
    start = F.col("p") - F.col("offset")
    inside = found.where((start >= 0) & (start + F.col("length") <= F.size("tokens")))
    # the generator keeps the check below out of the join, whose rows would then carry copies of all tokens
    part = F.explode_outer(F.array(F.slice("tokens", start + 1, F.col("length")))).alias("part")
    part = inside.select("doc_id", "text_hash", "number", "short", (start - F.col("at")).alias("shift"), "hash", part)
    window = (F.xxhash64(canonical(F.col("part"))) == F.col("hash")) | (F.xxhash64(folded(F.col("part"))) == F.col("hash"))
    same = part.where(F.when(F.col("short"), F.xxhash64(plain(F.col("part"))) == F.col("hash")).otherwise(window))
    return same.select("doc_id", "text_hash", "number", "short", "shift")


def _by_window(named: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The same for more items than may be sent to every executor: all hashes of all windows are joined."""
    short = F.size("item") < window
    keys = items.where(~short).select("number", canonical(F.col("item")).alias("template"), folded(F.col("item")).alias("folded"))
    keys = _met(keys, _windows(window, "template", "folded"), "at", "number")
    whole = items.where(short).select("number", F.lit(0).alias("at"), F.xxhash64(plain(F.col("item"))).alias("hash"))
    keys = cut(keys.union(whole).join(items.select("number", short.alias("short")), "number"))
    lengths = sorted(r[0] for r in items.where(short).select(F.size("item")).distinct().collect())
    forms = [canonical(F.col("tokens")).alias("template"), folded(F.col("tokens")).alias("folded")] + ([plain(F.col("tokens")).alias("plain")] if lengths else [])
    windows = F.concat(_windows(window, "template", "folded"), *[_windows(n, "plain") for n in lengths])
    met = _met(named.select("doc_id", "text_hash", *forms), windows, "place", "doc_id", "text_hash")
    return met.join(keys, "hash").select("doc_id", "text_hash", "number", "short", (F.col("place") - F.col("at")).alias("shift"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, run: int = 10, least_literals: int = 7) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, text_hash, item_id, run, matched, item_tokens, slots, changed_slots.

    Texts become templates, in which names, numbers and units are typed placeholders. The hashes of
    all windows of ``window`` tokens of the items meet those of all such windows of the documents,
    and so do the windows of lower-case words in which only numbers are placeholders, as a name
    may be untyped in one of the texts. A window can only meet an item's where the document has the item
    window's anchor, its longest word, so only windows around such words are hashed.
    Each meeting aligns a document with an item; where templates agree, a placeholder's value in the
    item must always be the same value in the document, or it counts as no agreement. Equal values
    always agree and count as literals, as equal words do, whether typed or not. An item is held where a run of at least
    ``run`` tokens agrees (or all of a shorter item) with at least ``least_literals`` literals, or two
    thirds of the item's words that aren't placeholders where that is less, but at least LEAST.
    ``changed_slots`` counts placeholders with other values: a re-parameterised item. Of several
    alignments of an item the one with the longest run is reported.

    An item with fewer than ``window`` tokens has no template that could be told from chance: it is
    held where all its lower-case tokens stand in the document in their order, found by the hash of its
    whole token list, and its first such place is reported. So an item of one word is held by every
    document with that word. Items without tokens and null or empty texts are held by nothing and hold
    nothing. A document stands for all rows that agree in id and text. Empty tables give no rows;
    other columns are not read.
    """
    content = F.coalesce("text", F.lit(""))
    items = benchmark.select("item_id", marked_tokens(F.col("text")).alias("item")).where(F.size("item") > 0)
    items = cut(items.distinct().withColumn("number", F.xxhash64("item_id", "item")))
    anchors = cut(_anchored(items, window))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content.alias("text"))
    named = with_tokens(read.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), "text", "tokens")
    aligned = _by_anchor(named, anchors) if anchors.count() <= BROADCAST_ROWS else _by_window(named, items, window)
    # the places of a short item are all alike
    aligned = aligned.groupBy("doc_id", "text_hash", "number", F.when(~F.col("short"), F.col("shift")).alias("_at")).agg(F.min("shift").alias("shift"))
    aligned = cut(aligned.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("number", "shift")).alias("met")))
    known = aligned.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "met")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    again = read.withColumn("text_hash", F.xxhash64("text")).join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h")))
    pairs = with_tokens(again.select("doc_id", "text_hash", "met", "text"), "text", "doc").select("doc_id", "text_hash", "doc", F.explode_outer("met").alias("m"))
    pairs = pairs.select("doc_id", "text_hash", "doc", F.col("m.number").alias("number"), F.col("m.shift").alias("shift")).join(items, "number")
    return _checked(pairs, window, run, least_literals)


def _checked(pairs: DataFrame, window: int, run: int, least_literals: int) -> DataFrame:
    """The alignments that hold, the best of each document and item."""
    part = F.transform(F.sequence(F.lit(1), F.size("item")), lambda i: F.get("doc", i - 1 + F.col("shift")))
    both = F.zip_with("item", part, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = pairs.select("doc_id", "text_hash", "item_id", F.size("item").alias("item_tokens"), both.alias("both"))
    slot = lambda x: (F.ascii(x["a"]) <= 3) & (F.left(x["a"], F.lit(1)) == F.left(x["b"], F.lit(1)))
    pairs = pairs.withColumn("slots", F.array_distinct(F.filter("both", lambda x: x["b"].isNotNull() & slot(x))))
    # values of the item that stand for more than one value of the document
    values = F.transform("slots", lambda x: x["a"])
    pairs = pairs.withColumn("torn", F.filter(F.array_distinct(values), lambda a: F.size(F.filter("slots", lambda x: x["a"] == a)) > 1))
    agrees = lambda x: F.when(x["b"].isNull(), F.lit(0)).when(_value(x["a"]) == _value(x["b"]), F.lit(2)).when(slot(x) & ~F.array_contains("torn", x["a"]), F.lit(1)).otherwise(F.lit(0))
    words = F.size(F.filter("both", lambda x: F.ascii(x["a"]) > 3))
    wanted = F.least(F.lit(least_literals), F.greatest(F.lit(LEAST), F.ceil(words * 2 / 3).cast("int")))
    pairs = pairs.withColumn("agree", F.transform("both", agrees)).withColumn("wanted", wanted).withColumn("shortest", F.least(F.lit(run), F.col("item_tokens")))
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("literal"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(x > 0, s["now"] + 1).otherwise(F.lit(0))
        literal = F.when(x == 2, s["literal"] + 1).when(x == 1, s["literal"]).otherwise(F.lit(0))
        best = F.when((now >= F.col("shortest")) & (literal >= F.col("wanted")), F.greatest(now, s["best"])).otherwise(s["best"])
        return F.struct(now.alias("now"), literal.alias("literal"), best.alias("best"))

    pairs = pairs.withColumn("longest", F.aggregate("agree", state, step, lambda s: s["best"]))
    equal = F.forall("both", lambda x: F.coalesce(_value(x["a"]) == _value(x["b"]), F.lit(False)))
    held = F.when(F.col("item_tokens") < window, equal).otherwise(F.col("longest") > 0)
    changed = F.size(F.filter("slots", lambda x: (x["a"] != x["b"]) & ~F.array_contains("torn", x["a"])))
    facts = F.struct(
        F.when(F.col("item_tokens") < window, F.col("item_tokens")).otherwise(F.col("longest")).alias("run"), F.size(F.filter("agree", lambda x: x > 0)).alias("matched"), F.size("slots").alias("slots"), changed.alias("changed_slots")
    )
    best = pairs.where(held).groupBy("doc_id", "text_hash", "item_id", "item_tokens").agg(F.max(facts).alias("f"))
    return best.select("doc_id", "text_hash", "item_id", "f.run", "f.matched", "item_tokens", "f.slots", "f.changed_slots")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, as they are."""
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    match = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_h"])
    return docs.join(found, match, "left_anti")
