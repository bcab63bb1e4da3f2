"""Structure repair of conversations by a dynamic program over runs.

A row of a conversation becomes one of nine symbols: what its role begins with (system, user, assistant or another) with a
whole or a cut-off text, or a row that must go. Equal neighbours make a run. What one symbol costs from each state of the
role pattern `(s?(ua)+)?` to each other is a min-plus matrix; a run of n rows is its n-th power, put together from cached
binary powers. From the costs at the borders of runs the cheapest edits are unrolled, the least letter first.

Two streams over sorted rows do it: the first holds a byte a row and no text, the second has the edits at hand before the
texts come by. Neither holds a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable

BLANKS = " \t\n\x0b\x0c\r"
SYSTEM, USER, ASSISTANT, OTHER = range(4)
GONE = 8  # a symbol; the others are initial + 4 * truncated
NEVER = 1 << 60
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the pattern: nothing yet, after s, after u, after a. What may come next, by initial.
STATES = range(4)
NEXT = ({SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})
#: The role that an insertion or a new role has in each state, and the state after it.
MADE = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
ENDS = (0, NEVER, NEVER, 0)

Matrix = tuple[tuple[int, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def apply(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(NEVER, *(x + y for x, y in zip(row, v, strict=True))) for row in a)


def insertions() -> Matrix:
    """The cost of any number of insertions from each state to each other."""
    one = tuple(tuple(0 if i == j else INSERT if MADE[i][1] == j else NEVER for j in STATES) for i in STATES)
    return times(times(one, one), one)


@cache
def power(symbol: int, b: int) -> Matrix:
    """The cost of 2 ** b rows of a symbol, with insertions before each."""
    if b:
        half = power(symbol, b - 1)
        return times(half, half)
    initial, extra = symbol % 4, TRUNCATED * (symbol // 4)
    cost = [[NEVER] * 4 for _ in STATES]
    for p in STATES:
        cost[p][p] = DELETE
        if symbol != GONE:
            made = MADE[p][1]
            cost[p][made] = min(cost[p][made], REROLE + extra)
            if initial in NEXT[p]:
                kept = NEXT[p][initial]
                cost[p][kept] = min(cost[p][kept], extra)
    return times(insertions(), tuple(map(tuple, cost)))


def advance(symbol: int, n: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The least costs before a run of n rows, from those after it."""
    b = 0
    while n:
        if n & 1:
            after = apply(power(symbol, b), after)
        n >>= 1
        b += 1
    return after


def cheapest(symbols: bytes) -> tuple[int, str]:
    """The least cost, and the least of the strings of edits (Delete, Insert, Keep, Rerole) that have it."""
    row = np.frombuffer(symbols, np.uint8)
    starts = np.flatnonzero(np.diff(row.astype(int), prepend=-1)).tolist()
    runs = [(int(row[a]), b - a) for a, b in zip(starts, [*starts[1:], len(row)], strict=False)]
    border = [apply(insertions(), ENDS)]
    for symbol, n in reversed(runs):
        border.append(advance(symbol, n, border[-1]))
    border.reverse()
    out: list[str] = []
    state, cost = 0, border[0][0]
    for i, (symbol, n) in enumerate(runs):
        inside = [border[i + 1]]
        for _ in range(n - 1):
            inside.append(apply(power(symbol, 0), inside[-1]))
        inside.append(border[i])
        for now, after in zip(inside[:0:-1], inside[-2::-1], strict=True):
            left = now[state]
            while True:
                made, extra = MADE[state][1], TRUNCATED * (symbol // 4)
                if DELETE + after[state] == left:
                    out.append("D")
                    break
                if INSERT + now[made] == left:
                    out.append("I")
                    state, left = made, now[made]
                    continue
                if symbol != GONE and symbol % 4 in NEXT[state] and extra + after[NEXT[state][symbol % 4]] == left:
                    out.append("K")
                    state = NEXT[state][symbol % 4]
                else:
                    out.append("R")
                    state = made
                break
    while ENDS[state]:
        out.append("I")
        state = MADE[state][1]
    return cost, "".join(out)


@lru_cache(100_000)
def short(symbols: bytes) -> tuple[int, str]:
    """cheapest() for conversations of few turns, which share their symbols."""
    return cheapest(symbols)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, here: damage by crc32(`conv_id:turn`) % 20, nulls being one space.

    0 drops a row (here is false, so that its conversation stays known), 1 empties its text, 2 takes out `[.!?]`, 3 repeats
    it, 4 makes it the user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), shown("role").alias("role"), shown("text").alias("text"), k.alias("k"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") != 0).alias("here"), times).drop("copy")


def digest() -> Column:
    """128 bits of a row's role and text."""
    return F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"


def reports(rows: DataFrame) -> DataFrame:
    """REPORT of each conversation in rows as damaged() gives them."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)  # duplicates become 2
    lean = rows.select("conv_id", "turn", "here", code.cast("byte").alias("role"), fault.cast("byte").alias("fault"), F.when(F.col("here"), digest()).alias("digest"))
    lean = lean.repartition("conv_id")
    # a window over more keys than the rows are dealt by needs no further shuffle
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first()))
    lean = lean.withColumn("again", nth > 1).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv: int | None = None
        began = False
        symbols, blank, duplicate, truncated, illegal, before = bytearray(), 0, 0, 0, 0, -1
        low = high = turn_before = None
        turns = 0

        def close() -> None:
            whole = bytes(symbols)
            cost, audit = short(whole) if len(whole) <= 64 else cheapest(whole)
            out.append((conv, high - low + 1 - turns if turns else 0, blank, duplicate, truncated, illegal, cost, audit))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "here", "role", "fault", "again")]
            for c, turn, here, role, fault, again in zip(*columns, strict=True):
                if c != conv or not began:
                    if began:
                        close()
                    conv, began = c, True
                    symbols, blank, duplicate, truncated, illegal, before = bytearray(), 0, 0, 0, 0, -1
                    low = high = turn_before = None
                    turns = 0
                if not here:
                    continue
                if turn is not None and turn != turn_before:
                    turns, high, turn_before = turns + 1, turn, turn
                    low = turn if low is None else low
                if before >= 0 and (before, role) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
                    illegal += 1
                before = role
                if fault == 1:
                    blank += 1
                    symbols.append(GONE)
                elif again:
                    duplicate += 1
                    symbols.append(GONE)
                else:
                    truncated += fault == 3
                    symbols.append(role + 4 * (fault == 3))
            if len(out) >= 4096:
                yield table(out)
                out = []
        if began:
            close()
        if out:
            yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        *numbers, audit = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(audit, pa.string())], names=["conv_id", *COUNTS, "audit"])

    importable(rows.sparkSession)
    return lean.mapInArrow(run, REPORT)


class Editor:
    """Follows a string of edits along the rows of a conversation and gives the rows that come out."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            role, self.state = MADE[self.state]
            yield role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state]["sua".index(role[0])]
            yield role, text
        elif edit == "R":
            role, self.state = MADE[self.state]
            yield role, text


def followed(rows: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Sends each conversation's report and then its rows, in order, past what make() gives; that yields record batches."""
    edits = reports(rows).select("conv_id", F.lit(False).alias("late"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), *COUNTS)
    texts = rows.where("here").select("conv_id", F.lit(True).alias("late"), "turn", digest().alias("digest"), "role", "text", *[F.lit(None).cast("long").alias(c) for c in COUNTS])
    both = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "late", F.col("turn").asc_nulls_first(), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make()(batches)

    importable(rows.sparkSession)
    return both.drop("turn", "digest").mapInArrow(run, schema)


def repair(turns: DataFrame) -> DataFrame:
    """REPORT and repaired_sha256 of every conversation of rows as damaged() gives them; the digest is of `role:text`, joined by newlines."""

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            head: tuple | None = None
            editor, sha, first = Editor(""), hashlib.sha256(), True

            def put(lines: Iterator[tuple[str, str]]) -> None:
                nonlocal first
                for role, text in lines:
                    sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False

            def close() -> None:
                put(editor.inserted())
                out.append((*head, editor.audit, sha.hexdigest()))

            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("late", "role", "text", "conv_id", *COUNTS)]
                for late, role, text, *report in zip(*columns, strict=True):
                    if late:
                        put(editor.row(role, text))
                    else:
                        if head:
                            close()
                        head, editor, sha, first = tuple(report), Editor(text), hashlib.sha256(), True
                if len(out) >= 4096:
                    yield table(out)
                    out = []
            if head:
                close()
            if out:
                yield table(out)

        def table(out: list[tuple]) -> pa.RecordBatch:
            *numbers, audit, sha = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(audit, pa.string()), pa.array(sha, pa.string())], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

        return run

    return followed(turns, make, REPORT + ", repaired_sha256 string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, ord, role, text: the rows of the repaired conversations, ord from 0."""

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            editor, conv, ord = Editor(""), None, 0
            out: list[tuple] = []

            def put(lines: Iterator[tuple[str, str]]) -> None:
                nonlocal ord
                for role, text in lines:
                    out.append((conv, ord, role, text))
                    ord += 1

            for batch in batches:
                for late, role, text, c in zip(*(batch.column(x).to_pylist() for x in ("late", "role", "text", "conv_id")), strict=True):
                    if late:
                        put(editor.row(role, text))
                    else:
                        put(editor.inserted())
                        editor, conv, ord = Editor(text), c, 0
                yield table(out)
                out = []
            put(editor.inserted())
            yield table(out)

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["conv_id", "ord", "role", "text"])

        return run

    return followed(turns, make, "conv_id long, ord long, role string, text string")


def op13_conversation_repair(turns: DataFrame) -> DataFrame:
    """Damages the conversations, then reports faults, the cheapest repair and the digest of what it gives.

    Nulls in any column count as one space, also in the damage's key; rows without a conv_id are one conversation, whose
    conv_id is null. A role that is empty begins with nothing and fits nowhere. Equal turns are ordered by a digest of role
    and text, so repeated rows stand side by side; all but the first are duplicates. Texts of any length pass by once. A
    conversation of any length takes a byte a row and its string of edits; one task reads it, as its digest and edits are
    sequential. Conversations of which no row is left have zeros and empty strings. Other columns are passed over. An empty
    table gives no rows.
    """
    return repair(damaged(turns))
