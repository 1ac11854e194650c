"""Conversation structure repair by a run-length dynamic programme over min-plus transitions.

A row is a symbol: the initial of its role, whether it is truncated, or that it must go. A repaired
conversation has the role initials ``(s?(ua)+)?``, an automaton of four states. A symbol is a 4 x 4
min-plus matrix of edit costs (inserts, then one edit of the row); equal neighbours form a run,
which is advanced by the cached binary powers of its matrix. From the costs to the end, kept at
the borders of runs, the choices are unrolled forwards, the least letter first.

Rows are range partitioned by (conversation, turn), so one long conversation lies in many tasks. A
task finishes the conversations that lie within it. What may go on in another task is handed on
in pieces of bounded size with the product of their matrices; products are chained per
conversation, then all pieces are unrolled side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
OK, BLANK, DUPLICATE, CUT = range(4)  # faults
SYSTEM, USER, ASSISTANT, OTHER = range(4)  # classes of role initials
GONE = 8  # the symbol of a row that must be deleted; others are class + 4 if truncated
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

# States: nothing yet, after s, after u, after a.
STATES = range(4)
NEXT = (2, 2, 3, 2)  # where a row of the only fitting role leads
NAMES = {2: "user", 3: "assistant"}
KEPT = {SYSTEM: {0: 1}, USER: {0: 2, 1: 2, 3: 2}, ASSISTANT: {2: 3}, OTHER: {}}
FAR = 1 << 60

PIECE_ROWS = 1 << 15
PIECE_BYTES = 2 << 20
BLOCK = 512  # rows whose costs to the end are held at a time while a run is unrolled

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]
Run = tuple[int, int]  # symbol, rows


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(a[i][k] + b[k][j] for k in STATES), FAR) for j in STATES) for i in STATES)


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(min(a[i][k] + v[k] for k in STATES), FAR) for i in STATES)


def _inserts() -> Matrix:
    one = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else FAR for j in STATES) for i in STATES)
    return times(one, times(one, one))


UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in STATES) for i in STATES)
INSERTS = _inserts()
END: Vector = apply(INSERTS, (0, FAR, FAR, 0))


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """The transition of ``2 ** k`` rows of a symbol, inserts before each row included."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    row = [[FAR] * 4 for _ in STATES]
    for s in STATES:
        row[s][s] = DELETE
        if symbol != GONE:
            extra = TRUNCATED if symbol >= 4 else 0
            row[s][NEXT[s]] = min(row[s][NEXT[s]], REROLE + extra)
            if s in KEPT[symbol % 4]:
                t = KEPT[symbol % 4][s]
                row[s][t] = min(row[s][t], KEEP + extra)
    return times(INSERTS, tuple(map(tuple, row)))


def back(run: Run, v: Vector) -> Vector:
    """Costs to the end before a run, from those after it."""
    symbol, n = run
    k = 0
    while n:
        if n & 1:
            v = apply(power(symbol, k), v)
        n >>= 1
        k += 1
    return v


def product(runs: list[Run]) -> Matrix:
    out = UNIT
    for symbol, n in runs:
        k = 0
        while n:
            if n & 1:
                out = times(out, power(symbol, k))
            n >>= 1
            k += 1
    return out


def unroll(runs: list[Run], end: Vector, state: int, last: bool) -> tuple[str, int, list[tuple[int, str | None]]]:
    """Letters of the cheapest edits (ties ASCII-least), the state after them, and the lines left.

    ``end`` holds the costs to the end after the runs; ``last`` also makes the closing inserts. A
    line is (row, new role or None); row -1 is an insert.
    """
    after = [end]
    for run in reversed(runs):
        after.append(back(run, after[-1]))
    after.pop()
    letters: list[str] = []
    lines: list[tuple[int, str | None]] = []
    row = 0
    for symbol, n in runs:
        v = after.pop()
        if symbol == GONE:  # inserts can wait: D is less than I
            letters.append("D" * n)
            row += n
            continue
        borders = [v]
        for low in range((n - 1) // BLOCK * BLOCK, 0, -BLOCK):
            borders.append(back((symbol, min(n - low, BLOCK)), borders[-1]))
        extra, kept, step = (TRUNCATED if symbol >= 4 else 0), KEPT[symbol % 4], power(symbol, 0)
        for low in range(0, n, BLOCK):
            costs = [borders.pop()]
            for _ in range(min(n - low, BLOCK)):
                costs.append(apply(step, costs[-1]))
            costs.pop()
            while costs:
                rest = costs.pop()
                before = apply(step, rest)
                while True:
                    to = NEXT[state]
                    if DELETE + rest[state] == before[state]:
                        letters.append("D")
                        break
                    if INSERT + before[to] == before[state]:
                        letters.append("I")
                        lines.append((-1, NAMES[to]))
                        state = to
                        continue
                    if state in kept and KEEP + extra + rest[kept[state]] == before[state]:
                        letters.append("K")
                        lines.append((row, None))
                        state = kept[state]
                    else:
                        letters.append("R")
                        lines.append((row, NAMES[to]))
                        state = to
                    break
                row += 1
    if last:
        while END[state]:
            state = NEXT[state]
            letters.append("I")
            lines.append((-1, NAMES[state]))
    return "".join(letters), state, lines


@lru_cache(maxsize=100_000)
def whole(runs: tuple[Run, ...]) -> tuple[str, tuple[tuple[int, str | None], ...]]:
    audit, _, lines = unroll(list(runs), END, 0, True)
    return audit, tuple(lines)


def _cost(audit: str, cut: int) -> int:
    return DELETE * audit.count("D") + INSERT * audit.count("I") + REROLE * audit.count("R") + TRUNCATED * cut


class Piece:
    """Rows of one conversation that follow each other: symbols, counts, and the texts to write."""

    def __init__(self) -> None:
        self.runs: list[list[int]] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.cut: list[bool] = []
        self.places: list[int] = []  # of the text of each stored row among all rows
        self.rows = self.bytes = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # classes
        self.low = self.high = None  # turns

    def put(self, turn, kind: int, fault: int, n: int, role: str, text: str) -> None:
        if not n:
            return  # tells only that the conversation exists
        if turn is not None and turn != self.high:
            self.turns += 1
            self.high = turn
            if self.low is None:
                self.low = turn
        if self.last is None:
            self.first = kind
        elif (self.last, kind) not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1
        self.last = kind
        if fault == BLANK:
            self.blank += n
        else:
            self.duplicate += n - (fault != DUPLICATE)
            self.truncated += fault == CUT
        gone = fault in (BLANK, DUPLICATE)
        if not gone:
            self.places.append(self.rows)
            self.roles.append(role)
            self.texts.append(text)
            self.cut.append(fault == CUT)
            self.bytes += len(text)
            self._run(kind + 4 * (fault == CUT), 1)
        if gone or n > 1:
            self._run(GONE, n - (not gone))
        self.rows += n

    def _run(self, symbol: int, n: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        else:
            self.runs.append([symbol, n])

    def full(self, most: int) -> bool:
        return max(len(self.texts), len(self.runs)) >= most or self.bytes >= PIECE_BYTES


def _written(audit: str, lines, places: list[int], roles: list[str], texts: list[str], cut: list[bool]) -> tuple[int, str]:
    """Cost and repaired lines."""
    at = {p: i for i, p in enumerate(places)}
    out, undeleted = [], 0
    for row, role in lines:
        if row < 0:
            out.append(f"{role}:")
        else:
            i = at[row]
            out.append(f"{role or roles[i]}:{texts[i]}")
            undeleted += cut[i]
    return _cost(audit, undeleted), "\n".join(out)


STATS = {c: "int" if c in ("first", "last") else "long" for c in "blank duplicate truncated illegal turns low high first last".split()}
ROLL = {"conv_id": "", "piece": "long", "cost": "long", "audit": "string", "text": "string", **STATS}
OPEN = {
    "whole": "boolean", "symbols": "array<int>", "counts": "array<long>", "product": "array<long>", "places": "array<long>",
    "roles": "array<string>", "texts": "array<string>", "cut": "array<boolean>",
}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _schema(columns: dict[str, str], conv: str) -> str:
    return ", ".join(f"{c} {kind or conv}" for c, kind in columns.items())


def _batch(rows: list[tuple], columns: dict[str, str], conv: pa.DataType) -> pa.RecordBatch:
    """Rows as Arrow, so that nulls leave long numbers exact."""
    kinds = [pa.list_(_ARROW[k[6:-1]]) if k.startswith("array") else _ARROW[k] if k else conv for k in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], list(columns))


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Whole conversations repaired, the others in pieces with the product of their transitions."""
    number = TaskContext.get().partitionId() << 32
    columns, out, held = ROLL | OPEN, [], 0

    def close(conv, piece: Piece, entire: bool) -> None:
        nonlocal number, held
        stats = (piece.blank, piece.duplicate, piece.truncated, piece.illegal, piece.turns, piece.low, piece.high, piece.first, piece.last)
        runs = tuple(map(tuple, piece.runs))
        if entire:
            audit, lines = whole(runs) if len(runs) <= 64 and piece.rows <= 256 else unroll(list(runs), END, 0, True)[::2]
            cost, text = _written(audit, lines, piece.places, piece.roles, piece.texts, piece.cut)
            out.append((conv, number, cost, audit, text, *stats, True, *[None] * 7))
        else:
            flat = [x for row in product(list(runs)) for x in row]
            symbols, counts = [r[0] for r in runs], [r[1] for r in runs]
            out.append((conv, number, None, None, None, *stats, False, symbols, counts, flat, piece.places, piece.roles, piece.texts, piece.cut))
        held += piece.bytes
        number += 1

    kind, conv, piece, started = pa.int64(), None, None, False  # started: the conversation may have begun before this piece
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        values = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "fault", "n", "role", "text")]
        for c, turn, initial, fault, n, role, text in zip(*values, strict=True):
            if piece is None:
                conv, piece, started = c, Piece(), True
            elif c != conv:
                close(conv, piece, not started)
                conv, piece, started = c, Piece(), False
            elif piece.full(most):
                close(conv, piece, False)
                piece, started = Piece(), True
            piece.put(turn, initial, fault, n, role, text)
            if held > 8 * PIECE_BYTES or len(out) > 5000:
                yield _batch(out, columns, kind)
                out, held = [], 0
    if piece is not None:
        close(conv, piece, False)
        yield _batch(out, columns, kind)


def _square(flat) -> Matrix:
    return tuple(tuple(int(x) for x in flat[4 * i : 4 * i + 4]) for i in STATES)


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs to the end after each piece of a conversation."""
    pdf = pdf.sort_values("piece", ascending=False)
    v, out = END, []
    for flat in pdf["product"]:
        out.append(list(v))
        v = apply(_square(flat), v)
    final = [i == 0 for i in range(len(out))]
    return pd.DataFrame({"piece": pdf["piece"].to_numpy(), "end": out, "final": final})


def _runs(symbols, counts) -> list[Run]:
    return [(int(s), int(n)) for s, n in zip(symbols, counts, strict=True)]


EXITS = {"conv_id": "", "piece": "long", "end": "array<long>", "final": "boolean", "exits": "array<int>"}


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each piece ends, for each state in which it may begin."""
    for batch in batches:
        rows = batch.to_pylist()
        found = [[unroll(_runs(r["symbols"], r["counts"]), tuple(r["end"]), state, False)[1] for state in STATES] for r in rows]
        out = [(r["conv_id"], r["piece"], r["end"], r["final"], e) for r, e in zip(rows, found, strict=True)]
        yield _batch(out, EXITS, batch.schema.field("conv_id").type)


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("piece")
    state, entry = 0, []
    for exits in pdf["exits"]:
        entry.append(state)
        state = int(exits[state])
    return pdf[["piece", "end", "final"]].assign(entry=entry)


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            audit, _, lines = unroll(_runs(r["symbols"], r["counts"]), tuple(r["end"]), r["entry"], r["final"])
            cost, text = _written(audit, lines, r["places"], r["roles"], r["texts"], r["cut"])
            yield _batch([(r["conv_id"], r["piece"], cost, audit, text, *(r[c] for c in STATS))], ROLL, batch.schema.field("conv_id").type)


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, kind, fault, digest): equal rows as one with their number ``n``.

    ``rows`` has a column ``n`` too, 0 for a row that only names its conversation (role null).
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = rows.withColumn("end", end).withColumn("kind", kind).withColumn("digest", digest)
    seen = rows.where("n > 0 AND end <> ''").groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("c"))
    seen = seen.where("c > 1").select(F.col("conv_id").alias("seen_conv"), F.col("digest").alias("seen_digest"), "first")
    both = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("seen_conv")) & (F.col("digest") == F.col("seen_digest")), "left")
    later = F.col("first").isNotNull() & (F.struct("turn") > F.col("first"))
    fault = F.when(F.col("end") == "", BLANK).when(later, DUPLICATE).when(~F.col("end").isin(".", "!", "?"), CUT).otherwise(OK)
    return both.select("conv_id", "turn", "role", "text", "n", "kind", fault.alias("fault"), "digest")


def repaired(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pieces of repaired conversations: (conv_id, piece, cost, audit, text, counts of the piece, entire).

    ``rows`` needs conv_id, turn (long), role and text, and may have ``n`` (times the row stands
    there, 0 for a row that only names its conversation); other columns are ignored. A null role
    or text is one space, a null conv_id a conversation of its own, null turns come first. Rows of
    one turn go by role, then by a digest of the text; equal rows follow each other. ``text`` holds
    the repaired lines ``role:text``. Most conversations are one ``entire`` piece, the others are
    cut at the borders of tasks and after ``piece_rows`` rows or ``PIECE_BYTES`` characters and go
    in the order of ``piece``. No rows give no pieces.
    """
    scratch = Scratch(rows.sparkSession)
    n = F.col("n").cast("long") if "n" in rows.columns else F.lit(1).cast("long")
    conv = rows.schema["conv_id"].dataType.simpleString()
    fill = lambda c: F.when(n > 0, F.coalesce(F.col(c), F.lit(" "))).alias(c)
    clean = rows.select("conv_id", F.when(n > 0, F.col("turn").cast("long")).alias("turn"), fill("role"), fill("text"), n.alias("n"))
    order = ["conv_id", "turn", "role", "digest"]
    ordered = with_faults(clean).repartitionByRange(*order).sortWithinPartitions(*order)
    found = scratch.store(ordered.mapInArrow(partial(_pieces, most=piece_rows), _schema(ROLL | OPEN, conv)))
    rest = found.where("NOT whole")
    ends = rest.select("conv_id", "piece", "product").groupBy("conv_id").applyInPandas(_ends, "piece long, end array<long>, final boolean")
    exits = rest.select("conv_id", "piece", "symbols", "counts").join(ends, "piece").mapInArrow(_exits, _schema(EXITS, conv))
    entries = exits.groupBy("conv_id").applyInPandas(_entries, "piece long, end array<long>, final boolean, entry int")
    solved = rest.join(entries, "piece").mapInArrow(_unrolled, _schema(ROLL, conv))
    entire = found.where("whole").select(*ROLL).withColumn("entire", F.lit(True))
    return entire.unionByName(solved.withColumn("entire", F.lit(False)))


DIGESTS = {"conv_id": "", **{c: "long" for c in "gaps blank duplicate truncated illegal cost".split()}, "audit": "string", "repaired_sha256": "string"}


class Summary:
    """Counts, audit and running hash of the pieces of one conversation."""

    def __init__(self, conv):
        self.conv = conv
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.turns, self.low, self.high, self.last = 0, None, None, None
        self.audit: list[str] = []
        self.sha, self.lines = hashlib.sha256(), False

    def add(self, r: dict) -> None:
        for c in self.sums:
            self.sums[c] += r[c]
        if r["first"] is not None:
            self.sums["illegal"] += self.last is not None and (self.last, r["first"]) not in LEGAL
            self.last = r["last"]
        if r["low"] is not None:
            self.turns += r["turns"] - (self.high == r["low"])
            self.low = r["low"] if self.low is None else self.low
            self.high = r["high"]
        self.audit.append(r["audit"])
        if r["text"]:
            self.sha.update((b"\n" if self.lines else b"") + r["text"].encode())
            self.lines = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return (self.conv, gaps, *self.sums.values(), "".join(self.audit), self.sha.hexdigest())


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its pieces, which arrive in order."""
    now, kind = None, None
    for batch in batches:
        out, kind = [], batch.schema.field("conv_id").type
        for r in batch.to_pylist():
            if now is None or r["conv_id"] != now.conv:
                if now:
                    out.append(now.row())
                now = Summary(r["conv_id"])
            now.add(r)
        yield _batch(out, DIGESTS, kind)
    if now:
        yield _batch([now.row()], DIGESTS, kind)


def summaries(pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    gaps is maxTurn - minTurn + 1 - distinct turns, nulls left out, at most 2**63 - 1. A conversation
    without rows has zeros, an empty audit and the hash of an empty text. Only pieces of
    conversations that were cut move here; the hash of such a conversation runs over them in order.
    """
    conv = pieces.schema["conv_id"].dataType.simpleString()
    widest = F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("turns")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.least(widest, F.lit(2**63 - 1)).cast("long"))
    sha = F.sha2(F.encode("text", "utf-8"), 256)
    one = pieces.where("entire").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", sha.alias("repaired_sha256"))
    many = pieces.where("NOT entire").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    many = many.mapInArrow(_digested, _schema(DIGESTS, conv))
    return one.union(many)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32("conv_id:turn") % 20, as (conv_id, turn, role, text, n) for ``repaired``.

    0 drops the row (n 0), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user. Nulls are one space.
    """
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    draw = F.crc32(key.cast("binary")) % 20
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    n = F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), n.cast("long").alias("n"))
