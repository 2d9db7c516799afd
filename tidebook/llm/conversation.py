"""Conversation structure repair: the cheapest edits, found by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import cut

#: What an edit costs, and what an undeleted truncated row costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of a conversation: nothing yet, or the initial of its last role.
START, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Role that an insertion or a new role has in each state; the states in which a role may follow.
FOLLOWING = (USER, USER, ASSISTANT, USER)
ALLOWED = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
#: More than any path costs.
NEVER = 1 << 40
#: Rows that one search covers; longer conversations are chained from such pieces.
PIECE_ROWS = 64
NO_DIGEST = hashlib.sha256(b"").hexdigest()


class Search:
    """Edits of one run of rows, from one state to a goal.

    ``rows`` has one character a row: x must be deleted; s, u, a or o (any other role) may stay, in
    capitals where the text is truncated. The goal is a state that the last row's edit must leave,
    or None: the end of the conversation, which must be complete and may be reached by insertions.
    """

    def __init__(self, rows: str, entry: int, goal: int | None):
        self.rows, self.entry, self.goal = rows, entry, goal
        self.size = len(rows)
        self.estimates = self._estimates()

    def _estimates(self) -> list[tuple[int, ...]]:
        """For each row and state a cost that no path from there undercuts.

        Rows that must go cost a deletion, truncated ones their charge. Neighbours that may not
        follow each other need an insertion between them or a change of one of them; of such pairs,
        the dearest set without a shared row counts.
        """
        if self.goal in (START, SYSTEM):
            return self._deletions()
        least, ahead = [0] * (self.size + 1), [0] * (self.size + 1)
        stay = [i for i, c in enumerate(self.rows) if c != "x"]
        for i in range(self.size - 1, -1, -1):
            c = self.rows[i]
            least[i] = least[i + 1] + (DELETE if c == "x" else TRUNCATED if c.isupper() else 0)
            ahead[i] = ahead[i + 1] + (c != "x")
        change = [min(REROLE, DELETE - TRUNCATED) if self.rows[i].isupper() else REROLE for i in stay]
        state = [STATE.get(self.rows[i].lower()) for i in stay]

        def pair(last: int | None, at: int, before: int | None) -> int:
            """Cost between a state, that of row ``before`` or the entry, and the row ``at`` or the end."""
            if at == len(stay):
                fits = last in (START, ASSISTANT) if self.goal is None else last == self.goal
                most = INSERT
            else:
                fits = state[at] is not None and last is not None and last in ALLOWED[state[at]]
                most = min(INSERT, change[at])
            return 0 if fits else most if before is None else min(most, change[before])

        pairs = [0] * (len(stay) + 2)
        for t in range(len(stay) - 1, -1, -1):
            pairs[t] = max(pairs[t + 1], pair(state[t], t + 1, t) + pairs[t + 2])
        out = []
        for i in range(self.size + 1):
            t = len(stay) - ahead[i]
            out.append(tuple(least[i] + max(pairs[t], pair(q, t, None) + pairs[t + 1]) for q in range(4)))
        return out

    def _deletions(self) -> list[tuple[int, ...]]:
        """The exact costs where the goal is the start or a system role.

        Nothing leads back to those states, so every row goes, but for one system row on the way
        from the start.
        """
        out, spared = [], NEVER
        for i in range(self.size, -1, -1):
            every = DELETE * (self.size - i)
            if i < self.size and self.rows[i] in "sS":
                spared = min(spared, (TRUNCATED if self.rows[i] == "S" else 0) - DELETE)
            begin = every if self.goal == START else min(every + spared, NEVER)
            out.append((begin, every if self.goal == SYSTEM else NEVER, NEVER, NEVER))
        return out[::-1]

    def reachable(self) -> bool:
        """Whether any path leads to the goal."""
        if self.goal is None or self.goal == self.entry:
            return True
        if self.goal == START:
            return False
        if self.goal == SYSTEM:
            return self.entry == START and "s" in self.rows.lower()
        return self.size > 0

    def run(self) -> tuple[int, str] | None:
        """Cost and edits, one letter each; of equally cheap paths the least in ASCII order.

        Depth-first search in that order under a bound, so the first accepted path is the least;
        the bound then grows to the least cost that it cut off. No cheaper path is left out, since
        a bound never exceeds the cheapest cost.
        """
        if not self.reachable():
            return None
        bound = self.estimates[0][self.entry]
        while True:
            self.failed: dict[tuple[int, int], int] = {}
            self.excess = NEVER
            found = self._descend(0, self.entry, bound)
            if found is not None:
                return bound, found
            bound += self.excess

    def _edits(self, i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        """Letter, cost, next row and state of every edit at a row, in ASCII order."""
        if i == self.size:
            if self.goal is None:
                yield "I", INSERT, i, FOLLOWING[q]
            return
        c = self.rows[i]
        yield "D", DELETE, i + 1, q
        yield "I", INSERT, i, FOLLOWING[q]
        if c == "x":
            return
        charge = TRUNCATED if c.isupper() else 0
        own = STATE.get(c.lower())
        if own is not None and q in ALLOWED[own]:
            yield "K", charge, i + 1, own
        yield "R", REROLE + charge, i + 1, FOLLOWING[q]

    def _descend(self, i: int, q: int, left: int) -> str | None:
        if i == self.size and (q in (START, ASSISTANT) if self.goal is None else q == self.goal):
            return ""
        if self.failed.get((i, q), -1) >= left:
            return None
        for letter, cost, following, state in self._edits(i, q):
            over = cost + self.estimates[following][state] - left
            if over > 0:
                self.excess = min(self.excess, over)
                continue
            rest = self._descend(following, state, left - cost)
            if rest is not None:
                return letter + rest
        self.failed[i, q] = left
        return None


@lru_cache(maxsize=100_000)
def search(rows: str, entry: int, goal: int | None) -> tuple[int, str] | None:
    """Cost and edits of a run of rows; runs that look alike are searched once in a task."""
    return Search(rows, entry, goal).run()


def wrapped(n: int) -> int:
    """The number as 64-bit arithmetic gives it."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


class Piece:
    """Counts and symbols of up to ``PIECE_ROWS`` consecutive rows of one conversation."""

    def __init__(self):
        self.rows: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.first = self.last = None

    def add(self, turn: int | None, initial: str, look: str, again: bool) -> None:
        """One row: its turn, role initial, symbol (b: blank), and whether it was seen earlier."""
        if self.rows:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        if look == "b":
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif look.isupper():
            self.truncated += 1
        self.rows.append("x" if look == "b" or again else look)

    def counts(self) -> list[int]:
        return [self.blank, self.duplicate, self.truncated, self.illegal]


PIECES = "part int, piece long, whole boolean, low long, high long, turns long, counts array<long>, ends array<string>, paths array<string>"


def _pieces(schema: pa.Schema):
    """Sorted rows to pieces; conversations that one piece surely covers are solved at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out = TaskContext.get().partitionId(), 0, []

        def close(conv, piece: Piece, opens: bool, closes: bool) -> None:
            """``opens``, ``closes``: the piece surely is the first, the last of its conversation."""
            rows = "".join(piece.rows)
            exits = (None,) if closes else range(4)
            found = [(e, x, search(rows, e, x)) for e in ((START,) if opens else range(4)) for x in exits]
            paths = [f"{e}{'-' if x is None else x}{r[0]}:{r[1]}" for e, x, r in found if r]
            out.append((conv, part, number, opens and closes, piece.low, piece.high, piece.turns, piece.counts(), [piece.first, piece.last], paths))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        held, conv, opens, runs, previous = None, None, False, 0, None
        for data in batches:
            for c, turn, key, initial, look, again, copies in zip(*(x.to_pylist() for x in data.columns), strict=True):
                if held is None or c != conv:
                    if held is not None:
                        close(conv, held, opens, True)
                        number += 1
                    # the first conversation of a task may begin, and its last end, in another task
                    held, conv, opens, runs = Piece(), c, runs > 0, runs + 1
                for k in range(copies):
                    if len(held.rows) == PIECE_ROWS:
                        close(conv, held, opens, False)
                        number += 1
                        held, opens = Piece(), False
                    held.add(turn, initial, look, again or k > 0)
            if len(out) >= 4096:
                yield batch()
                out.clear()
        if held is not None:
            close(conv, held, opens, False)
        if out:
            yield batch()

    return run


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Chain:
    """Pieces of one conversation in order, joined by their cheapest paths.

    For each state the cheapest edits so far are kept, with the place of their letters among those
    of the other states. Every piece's edits end with a row's own edit, so none is the beginning of
    another, and comparing place and piece compares the whole strings.
    """

    def __init__(self):
        self.best: dict[int, tuple[int, int, tuple | None]] = {START: (0, 0, None)}
        self.counts = [0, 0, 0, 0]
        self.low = self.high = None
        self.turns = 0
        self.last = None

    def add(self, low, high, turns, counts, ends, paths) -> None:
        if self.last is not None:
            self.counts[3] += self.last + ends[0] not in LEGAL
        self.last = ends[1]
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.turns += turns - (low is not None and low == self.high)
        self.low = low if self.low is None else self.low
        self.high = self.high if high is None else high
        reached: dict[object, tuple[int, int, str, int]] = {}
        for path in paths:
            entry, exit_ = int(path[0]), path[1]
            if entry in self.best:
                cost, audit = path[2:].split(":")
                way = (self.best[entry][0] + int(cost), self.best[entry][1], audit, entry)
                reached[exit_] = min(reached.get(exit_, way), way)
        order = sorted(reached, key=lambda x: reached[x][1:3])
        self.best = {
            None if x == "-" else int(x): (reached[x][0], order.index(x), (self.best[reached[x][3]][2], reached[x][2])) for x in reached
        }

    def summary(self) -> list:
        """Counts, cost and edits of the conversation."""
        if None in self.best:
            cost, _, way = self.best[None]
            tail = ""
        else:
            # insertions that complete the conversation after its last row
            ends = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
            q = min(self.best, key=lambda x: (self.best[x][0] + INSERT * len(ends[x]), self.best[x][1]))
            cost, way, tail = self.best[q][0] + INSERT * len(ends[q]), self.best[q][2], ends[q]
        parts = [tail]
        while way is not None:
            way, letters = way
            parts.append(letters)
        gaps = 0 if self.low is None else wrapped(self.high - self.low + 1 - self.turns)
        return [gaps, *self.counts, cost, "".join(reversed(parts))]


def _chain(schema: pa.Schema):
    """Pieces, sorted by conversation and place, to one row a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv = None, None
        for data in batches:
            out = []
            for c, *piece in zip(*(x.to_pylist() for x in data.columns), strict=True):
                if held is None or c != conv:
                    if held is not None:
                        out.append([conv, *held.summary()])
                    held, conv = Chain(), c
                held.add(*piece)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held is not None:
            row = [conv, *held.summary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return run


def _texts(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key): nulls of role and text are one space.

    The key is a digest of conversation, role and text; rows of one turn are ordered by it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    named = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    key = F.unhex(F.sha2(F.concat(named, F.lit(":"), F.char_length(role), F.lit(":"), role, text), 256))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), key.alias("key"))


def _symbol(role: Column, text: Column) -> Column:
    """b for a blank text, else the role's initial (o: another), a capital where the text is truncated."""
    initial = F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise(F.lit("o"))
    ends = F.regexp_like(text, F.lit("[.!?][\\x20\\x09-\\x0D]*\\z"))
    blank = ~F.regexp_like(text, F.lit("[^\\x20\\x09-\\x0D]"))
    return F.when(blank, F.lit("b")).when(ends, initial).otherwise(F.upper(initial))


def _schema(rows: DataFrame, ddl: str) -> tuple[str, pa.Schema]:
    """DDL of the conversation's id and these columns, and the same for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {ddl}"
    return ddl, to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)


def summaries(rows: DataFrame) -> DataFrame:
    """Faults, cost and edits of every conversation of ``rows`` (conv_id, turn, role, text).

    Rows follow their turn, nulls first, then a digest of role and text. A null role or text is one
    space; a null conv_id is a conversation; repeated rows are rows; other columns are not read.
    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs) and audit, a letter
    for each edit. An empty table gives no rows.

    Equal rows of a turn are counted before they move. The rows are dealt out by ranges of
    (conversation, turn), so that a long conversation is shared by many tasks; each task searches
    its pieces of 64 rows for every state that they may begin and end in, and the pieces of a
    conversation are chained by those costs. Only conversations cut by a range or longer than
    a piece take the second step.
    """
    look = _symbol(F.col("role"), F.col("text")).alias("look")
    narrow = _texts(rows).select("conv_id", "turn", "key", F.substring("role", 1, 1).alias("initial"), look)
    merged = cut(narrow.groupBy("conv_id", "turn", "key", "initial", "look").agg(F.count(F.lit(1)).alias("copies")))
    firsts = merged.groupBy("key").agg(F.min(F.struct("turn"))["turn"].alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = cut(firsts.select(F.col("key").alias("seen"), "earliest"))
    known = merged.join(firsts, F.col("key") == F.col("seen"), "left")
    again = F.col("seen").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest"))
    ordered = cut(known.select("conv_id", "turn", "key", "initial", "look", again.alias("again"), "copies"))
    order = ("conv_id", "turn", "key")
    ddl, schema = _schema(rows, PIECES)
    pieces = cut(ordered.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(schema), ddl))
    place = ("conv_id", "part", "piece")
    parts = pieces.select(*place, "low", "high", "turns", "counts", "ends", "paths")
    ddl, schema = _schema(rows, SUMMARY)
    cuts = parts.where(~pieces["whole"]).repartition("conv_id").sortWithinPartitions(*place).drop("part", "piece")
    whole = parts.where(pieces["whole"]).drop("part", "piece")
    return cuts.mapInArrow(_chain(schema), ddl).union(whole.mapInArrow(_chain(schema), ddl))


REPAIRED = "position long, edit string, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversation, position, edit, role and text of every repaired row, and a row without edit at each end.

    Reads a conversation's edits, then its rows; holds no more than one batch and those edits.
    """
    conv, audit, at, state, place = None, None, 0, START, 0

    def inserts():
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = FOLLOWING[state]
            yield conv, place, "I", NAMES[state], ""
            at, place = at + 1, place + 1

    for data in batches:
        for c, first, role, text in zip(*(x.to_pylist() for x in data.columns), strict=True):
            if first:
                if audit is not None:
                    yield from inserts()
                    yield conv, place, None, None, None
                conv, audit, at, state, place = c, text, 0, START, 0
                continue
            yield from inserts()
            letter, at = audit[at], at + 1
            if letter == "D":
                continue
            state = STATE[role[0]] if letter == "K" else FOLLOWING[state]
            yield conv, place, letter, role if letter == "K" else NAMES[state], text
            place += 1
    if audit is not None:
        yield from inserts()
        yield conv, place, None, None, None


def _with_edits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's edits followed by its rows, in one task: (conv_id, first, role, text)."""
    texts = _texts(rows).select("conv_id", F.lit(False).alias("first"), "turn", "key", "role", "text")
    heads = found.select("conv_id", F.lit(True), F.lit(None).cast("long"), F.lit(None).cast("binary"), F.lit(None).cast("string"), "audit")
    order = ("conv_id", F.col("first").desc(), "turn", "key")
    both = heads.toDF(*texts.columns).union(texts)
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "first", "role", "text")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows after their edits: conv_id, position (from 0), edit (I, K, R), role and text.

    ``found`` is what ``summaries`` gave for these rows.
    """
    ddl, schema = _schema(rows, REPAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in _edited(batches):
            if row[2] is None:
                continue
            out.append(row)
            size += len(row[4])
            if len(out) >= 4096 or size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _with_edits(rows, found).mapInArrow(run, ddl)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: the repaired ``role:text``, joined by newlines, in lowercase hex.

    A digest of ordered texts can only be taken in their order, so each conversation is read through
    by one task, a batch at a time; only the digest's state and the edits are held.
    """
    ddl, schema = _schema(rows, "repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest = [], hashlib.sha256()
        for conv, position, edit, role, text in _edited(batches):
            if edit is not None:
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
                continue
            out.append((conv, digest.hexdigest()))
            digest = hashlib.sha256()
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _with_edits(rows, found).mapInArrow(run, ddl)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults that a checksum of ``conv_id:turn`` puts in; nulls there are one space.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it,
    4 makes it the user's.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = (F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20).cast("int")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault != 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repair_report(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Counts, cost, edits and digest of every conversation of ``rows``, whose remaining rows are ``kept``.

    A conversation without remaining rows has zeros, no edits and the digest of nothing.
    """
    found = cut(summaries(kept))
    hashes = digests(kept, found).withColumnRenamed("conv_id", "_conv")
    whole = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv").withColumnRenamed("conv_id", "_conv")
    ids = rows.select("conv_id").distinct()
    empty = {"audit": "", "repaired_sha256": NO_DIGEST}
    columns = [c for c in whole.columns if c != "_conv"]
    filled = [F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c in columns]
    return ids.join(whole, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", *filled)
