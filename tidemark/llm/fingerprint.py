"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, and long lines into sentences and runs of words); each
paragraph has a 64-bit digest that also counts its repetitions. A digest is added to three cells
of a sketch; a cell holds a count, the xor of its digests and the xor of their checks. Two
sketches subtract cell by cell; what both hold cancels out, and the rest is peeled: a cell with
one digest gives it away, its removal frees others. If peeling gets stuck both sketches are
built anew with more cells, at least twice as many. The recovered difference gives the likeness of two versions:
shared digests over all digests.

The next document of each row is found without moving any text twice: rows go to ranges of
doc_id, sorted, and only the first row of a range is also sent to the range before it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

CELLS = 48  # of a fingerprint, a multiple of the hashes
HASHES = 3
WORDS = 6  # longest run of words in a paragraph piece
RANGE_BYTES = 2 << 20
SENTENCES = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
_MULTIPLIERS = np.array(_K[:HASHES], dtype=np.uint64)[:, None]
_OFFSETS = np.arange(HASHES, dtype=np.uint64)[:, None]
_THIRDS = np.arange(HASHES, dtype=np.int64)[:, None]


def paragraphs(text: str) -> list[str]:
    """Lines, cut at sentence ends and after every ``WORDS`` words; blank ones are left out."""
    out = []
    for sentence in SENTENCES.findall(text) if "\n" not in text else (s for line in text.split("\n") for s in SENTENCES.findall(line)):
        words = sentence.split()
        if len(words) <= WORDS:
            if words:
                out.append(" ".join(words))
        else:
            out += [" ".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)]
    return out


def digests(text: str) -> np.ndarray:
    """A digest for each paragraph and, if it is repeated, for each repetition."""
    out = np.array([xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in paragraphs(text)], dtype=np.uint64)
    seen = np.zeros(len(out), dtype=np.uint64)
    order = np.argsort(out, kind="stable")
    ordered = out[order]
    same = np.concatenate(([False], ordered[1:] == ordered[:-1])) if len(out) else np.zeros(0, dtype=bool)
    if same.any():  # the k-th repetition of a paragraph is told from the others
        at = np.arange(len(out))
        seen[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
    return scramble(out + seen * _K[3])


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _K[1]
    return x ^ (x >> np.uint64(32))


def places(x: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each third of the sketch: a row for each third."""
    third = cells // HASHES
    mixed = scramble(x[None, :] * _MULTIPLIERS + _OFFSETS)
    return (mixed % np.uint64(third)).astype(np.int64) + _THIRDS * third


class Sketch:
    """Invertible sketch: counts, xor of digests, xor of checks."""

    def __init__(self, cells: int, items: np.ndarray | None = None):
        self.count = np.zeros(cells, dtype=np.int32)
        self.sum = np.zeros(cells, dtype=np.uint64)
        self.check = np.zeros(cells, dtype=np.uint64)
        if items is not None and len(items):
            self.put(items, np.ones(len(items), dtype=np.int32))

    def put(self, items: np.ndarray, sign: np.ndarray, check: np.ndarray | None = None) -> None:
        """Add digests, or take them away; ``check`` holds their checks if they are known."""
        at = places(items, len(self.count)).ravel()
        if check is None:
            check = scramble(items * _K[2])
        np.add.at(self.count, at, np.concatenate((sign,) * HASHES))
        np.bitwise_xor.at(self.sum, at, np.concatenate((items,) * HASHES))
        np.bitwise_xor.at(self.check, at, np.concatenate((check,) * HASHES))

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(len(self.count))
        out.count, out.sum, out.check = self.count - other.count, self.sum ^ other.sum, self.check ^ other.check
        return out

    def peel(self) -> tuple[list[int], list[int]] | None:
        """Digests only here and only in the other sketch; None if some stay hidden."""
        mine, theirs = [], []
        while True:
            pure = np.flatnonzero((self.count == 1) | (self.count == -1))
            items, check = self.sum[pure], self.check[pure]
            pure = pure[scramble(items * _K[2]) == check]
            if not len(pure):
                break
            items = self.sum[pure]
            order = np.argsort(items, kind="stable")
            items = items[order]
            first = np.concatenate(([True], items[1:] != items[:-1]))  # a digest may be alone in several cells
            pure, items = pure[order[first]], items[first]
            signs = self.count[pure]
            mine += items[signs == 1].tolist()
            theirs += items[signs == -1].tolist()
            self.put(items, -signs, self.check[pure])
        return (mine, theirs) if not self.count.any() and not self.sum.any() else None

    def held(self) -> float:
        """About how many digests the sketch holds, from its share of empty cells."""
        cells = len(self.count)
        empty = np.count_nonzero((self.count == 0) & (self.sum == 0))
        return cells / HASHES * np.log(cells / empty) if empty else 2.0 * cells

    def text(self, n: int) -> str:
        """The number of digests in hexadecimal, then the cells in base 64."""
        raw = self.count.astype("<i4").tobytes() + self.sum.astype("<u8").tobytes() + self.check.astype("<u8").tobytes()
        return f"{n:08x}" + base64.b64encode(raw).decode()

    @classmethod
    def read(cls, text: str) -> tuple[int, Sketch]:
        raw = base64.b64decode(text[8:])
        cells = len(raw) // 20
        out = cls(cells)
        out.count = np.frombuffer(raw, "<i4", cells).copy()
        out.sum = np.frombuffer(raw, "<u8", cells, 4 * cells).copy()
        out.check = np.frombuffer(raw, "<u8", cells, 12 * cells).copy()
        return int(text[:8], 16), out


def difference(a: np.ndarray, b: np.ndarray, first: tuple[Sketch, Sketch] | None = None) -> tuple[list[int], list[int]]:
    """Digests only in ``a`` and only in ``b``, recovered from sketches of growing size."""
    cells = CELLS
    while True:
        pair = first if first and cells == CELLS else (Sketch(cells, a), Sketch(cells, b))
        left = pair[0].minus(pair[1])
        held = left.held()
        # Above 0.82 digests a cell peeling cannot succeed and is not begun; with few digests a cell
        # it takes few rounds.
        if held < 0.9 * cells and (found := left.peel()) is not None:
            return found
        cells = HASHES * max(int(held * 2.5 / HASHES) + 1, 2 * cells // HASHES)


def likeness(a: np.ndarray, b: np.ndarray, first: tuple[Sketch, Sketch] | None = None) -> float:
    """Shared digests over all digests of both, 1 for two empty texts."""
    if not len(a) and not len(b):
        return 1.0
    mine, theirs = difference(a, b, first)
    shared = len(a) - len(mine)
    return shared / (shared + len(mine) + len(theirs))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows in ranges of doc_id for ``mapInPandas``: (range, turn, doc_id, text), and their number.

    ``turn`` 1 marks a copy of the row that follows the range: the first of the next range, and
    for the last range the first of all. Ranges hold about ``RANGE_BYTES`` of text; the driver
    holds two ids of each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, int(size // RANGE_BYTES))
    share = min(1.0, 64 * parts / max(1, rows.select("doc_id").count()))
    draw = F.xxhash64("doc_id", F.lit(23)) / 2.0**64 + 0.5
    ids = np.unique(np.array([r[0] for r in rows.where(draw < share).select("doc_id").where("doc_id IS NOT NULL").collect()], dtype=np.int64))
    step = max(1, len(ids) // parts)
    cuts = ids[step::step]

    def ranged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.searchsorted(cuts, s.fillna(-(2**63)).to_numpy(dtype=np.int64), side="right").astype(np.int32))

    placed = rows.withColumn("range", F.pandas_udf("int")(ranged)(F.col("doc_id")))
    firsts = {r["range"]: r["first"] for r in placed.groupBy("range").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("first")).collect()}
    order = sorted(firsts)
    before = {k: order[i - 1] for i, k in enumerate(order)}
    if not order:
        return placed.select("range", F.lit(0).alias("turn"), "doc_id", "text"), 1
    # The first row of each range: by id and text digest, so repeated ids are no matter.
    lead = docs.sparkSession.createDataFrame([(k, firsts[k]["doc_id"], firsts[k]["h"], before[k]) for k in order], "range int, doc_id long, h long, before int")
    marked = placed.join(F.broadcast(lead.select("range", F.col("doc_id").alias("first_id"), F.col("h").alias("first_h"), "before")), "range")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_h"))
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("turn"))
    there = F.struct(F.col("before").alias("range"), F.lit(1).alias("turn"))
    out = marked.select(F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("to"), "doc_id", "text")
    return out.select("to.range", "to.turn", "doc_id", "text"), len(order)


def _fingerprinted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    previous = None  # (range, doc_id, text, digests, sketch)

    def row(doc_id, text: str, own: np.ndarray, sketch: Sketch, following: str, next_own: np.ndarray, next_sketch: Sketch) -> tuple:
        other = edited(text, following)
        other_own = digests(other)
        other_sketch = Sketch(CELLS, other_own)
        return (
            doc_id, text, other, sketch.text(len(own)), other_sketch.text(len(other_own)),
            likeness(own, other_own, (sketch, other_sketch)), likeness(own, next_own, (sketch, next_sketch)),
        )

    columns = ["doc_id", "text", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for pdf in batches:
        out = []
        for part, turn, doc_id, text in pdf.itertuples(index=False, name=None):
            own = digests(text)
            sketch = Sketch(CELLS, own)
            if previous and previous[0] == part:
                out.append(row(*previous[1:], text, own, sketch))
            previous = None if turn else (part, doc_id, text, own, sketch)
            if len(out) >= 500:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    ``docs`` needs doc_id (long) and text; other columns are ignored. A null text counts as empty;
    two texts without paragraphs have likeness 1. The next row is by (doc_id, digest of the text),
    null ids first; the last row's next is the first, a single row's next is itself. Equal texts
    have equal fingerprints. An empty table gives no rows.
    """
    rows, ranges = with_next(docs)
    rows = rows.withColumn("h", F.xxhash64("text")).repartition(ranges, "range").sortWithinPartitions("range", "turn", "doc_id", "h").drop("h")
    kind = "doc_id long, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInPandas(_fingerprinted, kind)
