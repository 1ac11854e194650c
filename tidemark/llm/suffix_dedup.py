"""Repeated byte windows found by ordering suffixes to a fixed depth, most significant digits first.

A suffix is a position of a text; two texts share a string of ``threshold`` bytes where suffixes
are equal through that depth. As in any radix sort by most significant digits, a group that holds
one text only is finished and never looked at again. Only here the first digit is chosen so that
neighbours share it: it is the least hash of the 16-byte grams in the window, equal for equal
windows and the same for runs of about 18 windows.

1. First digit: (digit, doc_id) pairs give the digits that occur in two documents or more.
2. Windows with such a digit move as runs, one string for all neighbours of equal digit; equal
   strings become one row with their least and largest doc_id before they are shuffled.
3. Within a digit the windows of the strings are ordered by further digits of eight bytes through
   the threshold; equal groups are the repeated windows, their least doc_id owns them.
4. Every document removes the windows that a smaller doc_id owns.

Nothing is collected per text but its own spans and digits, which its length bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, release

THRESHOLD = 50  # bytes
GRAM = 16  # bytes of a gram whose hash can be the first digit
RUN = 64  # most windows that move as one string
SLICE_BYTES = 2 << 20  # text that is hashed at once
SORT_BYTES = 4 << 20  # strings whose windows are ordered at once
GROUP = 20_000  # strings of one digit that are ordered in one task; more go through a shuffle of their windows
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _eights(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from every place of ``data`` as a number; ``data`` ends with eight spare bytes."""
    return np.ndarray((len(data) - 7,), dtype=f"{order}u8", buffer=data, strides=(1,))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place."""
    n = max(0, len(raw) - GRAM + 1)
    words = _eights(np.concatenate((raw, np.zeros(8, dtype=np.uint8))), "<")
    h = words[:n].astype(np.uint64) * _A
    h ^= h >> np.uint64(29)
    h += words[8 : 8 + n]
    h *= _B
    h ^= h >> np.uint64(32)
    h *= _A
    return h ^ (h >> np.uint64(29))


def first_digits(raw: np.ndarray, threshold: int) -> np.ndarray:
    """The least gram hash of the window from each place."""
    width = threshold - GRAM + 1
    least, span = gram_hashes(raw), 1
    n = len(raw) - threshold + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[width - span : width - span + n])


def runs(raw: np.ndarray, offsets: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one first digit, none across rows: (first place, windows, digit)."""
    digit = first_digits(raw, threshold)
    n = len(digit)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), digit
    crossing = np.zeros(len(raw) + 1, dtype=np.int32)
    start, stop = offsets[:-1], offsets[1:]
    np.add.at(crossing, np.maximum(start, stop - threshold + 1), 1)
    np.add.at(crossing, stop, -1)
    valid = np.cumsum(crossing)[:n] == 0
    head = valid.copy()
    head[1:] &= ~valid[:-1] | (digit[1:] != digit[:-1])
    tail = valid.copy()
    tail[:-1] &= ~valid[1:] | (digit[1:] != digit[:-1])
    first = np.flatnonzero(head)
    return first, np.flatnonzero(tail) + 1 - first, digit[first]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column, without a copy."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), places.astype(np.int64)


def _binary(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The bytes at these places as a binary array."""
    offsets = np.concatenate(([0], np.cumsum(length)))
    places = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[places].tobytes())])


def _slices(raw: np.ndarray, offsets: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, row offsets within them, first row, place within that row); a long row comes in overlapping slices."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        if offsets[row + 1] - offsets[row] > SLICE_BYTES:
            for low in range(int(offsets[row]), int(offsets[row + 1]) - threshold + 1, SLICE_BYTES):
                part = raw[low : min(low + SLICE_BYTES + threshold - 1, int(offsets[row + 1]))]
                yield part, np.array([0, len(part)]), row, low - int(offsets[row])
            row += 1
        else:
            high = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
            yield raw[offsets[row] : offsets[high]], offsets[row : high + 1] - offsets[row], row, 0
            row = high


def _digits(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """(digit, doc, rid) of each run."""
    for batch in batches:
        doc, rid = batch.column("doc"), batch.column("rid")
        for raw, offsets, row, _ in _slices(*_buffers(batch.column("text")), threshold):
            first, _, digit = runs(raw, offsets, threshold)
            at = np.searchsorted(offsets, first, side="right") - 1
            once = _distinct(at, digit)
            rows = pa.array(at[once] + row)
            yield pa.RecordBatch.from_arrays([pa.array(digit[once].view(np.int64)), doc.take(rows), rid.take(rows)], ["digit", "doc", "rid"])


def _distinct(row: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Places of the first of equal (row, digit)."""
    by = np.lexsort((digit, row))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (row[by][1:] != row[by][:-1]) | (digit[by][1:] != digit[by][:-1])
    return by[new]


def _strings(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """(digit, s, doc, rid, start): runs of windows whose digit is shared, as strings of at most ``RUN`` windows."""
    for batch in batches:
        doc, rid, shared = batch.column("doc"), batch.column("rid"), batch.column("digits")
        for raw, offsets, row, place in _slices(*_buffers(batch.column("text")), threshold):
            first, windows, digit = runs(raw, offsets, threshold)
            known = shared.slice(row, len(offsets) - 1).flatten().to_numpy(zero_copy_only=False)
            wanted = np.isin(digit.view(np.int64), known)
            first, windows, digit = first[wanted], windows[wanted], digit[wanted]
            pieces = -(-windows // RUN)
            whole = np.repeat(np.arange(len(first)), pieces)
            number = np.arange(len(whole)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = first[whole] + number * RUN
            length = np.minimum(windows[whole] - number * RUN, RUN) + threshold - 1
            at = np.searchsorted(offsets, start, side="right") - 1
            rows = pa.array(at + row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digit[whole].view(np.int64)), _binary(raw, start, length), doc.take(rows), rid.take(rows), pa.array(start - offsets[at] + place)],
                ["digit", "s", "doc", "rid", "start"],
            )


def window_owners(data: np.ndarray, start: np.ndarray, windows: np.ndarray, group: np.ndarray, least: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, owner) of every window, by radix passes of eight bytes; ``group`` does not descend.

    The owner is the least ``least`` of all strings of the group that hold an equal window.
    """
    string = np.repeat(np.arange(len(start)), windows)
    place = np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(len(string))
    owner = least[string].copy()
    words = _eights(np.concatenate((data, np.zeros(8, dtype=np.uint8))), ">")
    at, g = np.arange(len(string)), group[string]
    for depth in range(0, threshold, 8):
        _, g = np.unique(g, return_inverse=True)
        going = np.bincount(g, minlength=1)[g] > 1  # a group of one is finished
        at, g = at[going], g[going]
        if not len(at):
            return string, owner
        key = words[place[at] + depth].astype(np.uint64)
        if threshold - depth < 8:
            key &= np.uint64(2**64 - 2 ** (64 - 8 * (threshold - depth)))
        by = np.lexsort((key, g))
        at, g, key = at[by], g[by], key[by]
        g = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])))) - 1
    heads = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    owner[at] = np.minimum.reduceat(least[string[at]], heads)[g]
    return string, owner


def _owned(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """(s, a, b, owner): windows a to b - 1 of a string belong to a doc_id below its largest one."""

    def ordered(table: pa.Table) -> pa.RecordBatch:
        s = table["s"].combine_chunks()
        data, offsets = _buffers(s)
        digit, low, high = (table[c].to_numpy() for c in ("digit", "low", "high"))
        string, owner = window_owners(data, offsets[:-1], np.diff(offsets) - threshold + 1, digit, low, threshold)
        head = np.concatenate(([True], (string[1:] != string[:-1]) | (owner[1:] != owner[:-1])))
        first = np.flatnonzero(head)
        stop = np.append(first[1:], len(string))
        begin = np.searchsorted(string, string[first])
        keep = owner[first] < high[string[first]]
        first, stop, begin = first[keep], stop[keep], begin[keep]
        return pa.RecordBatch.from_arrays(
            [s.take(pa.array(string[first])), pa.array((first - begin).astype(np.int32)), pa.array((stop - begin).astype(np.int32)), pa.array(owner[first])],
            ["s", "a", "b", "owner"],
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < SORT_BYTES:
            continue
        table = pa.Table.from_batches(held)
        digit = table["digit"].to_numpy()
        low = 0
        while True:  # whole digits only; the last one may go on in the next batch
            most = int(np.searchsorted(np.cumsum(np.full(len(digit) - low, size / len(digit))), SORT_BYTES))
            high = int(np.searchsorted(digit, digit[min(low + most, len(digit) - 1)], side="left"))
            if high <= low:
                high = int(np.searchsorted(digit, digit[low], side="right"))
            if high >= len(digit):
                break
            yield ordered(table.slice(low, high - low))
            low = high
        held = table.slice(low).to_batches()
        size = sum(b.nbytes for b in held)
    if held:
        yield ordered(pa.Table.from_batches(held))


def _kept(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        raw, offsets = _buffers(batch.column("text"))
        found = batch.column("found").to_pylist()
        spans, texts = [], []
        for i, marks in enumerate(found):
            text = raw[offsets[i] : offsets[i + 1]]
            if not marks:
                spans.append([])
                texts.append(text.tobytes())
                continue
            change = np.zeros(len(text) + 1, dtype=np.int32)
            marks = np.array([(m["low"], m["high"]) for m in marks])
            np.add.at(change, marks[:, 0], 1)
            np.add.at(change, marks[:, 1] + threshold - 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            texts.append(text[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(texts, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
        )


def _all_windows(big: DataFrame, threshold: int) -> DataFrame:
    """(s, a, b, owner) by a shuffle of every window, for digits with more strings than a task should order."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("s") - threshold))
    windows = big.select("s", "low", "high", at.alias("a")).withColumn("w", F.expr(f"substring(s, a + 1, {threshold})"))
    owners = windows.groupBy("w").agg(F.min("low").alias("owner"))
    found = windows.join(owners, "w").where("owner < high")
    return found.select("s", "a", (F.col("a") + 1).alias("b"), "owner")


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``docs``: what a smaller doc_id has already is removed.

    ``docs`` needs doc_id (long) and text, a null text counting as empty; other columns are ignored.
    A byte goes if a string of ``threshold`` bytes around it also starts in a row with a smaller
    doc_id, judged on the input. Rows of equal doc_id take nothing from each other, and a null
    doc_id neither takes nor loses. ``spans`` are the removed byte ranges in order, ``kept`` the
    remaining bytes, which may end within a character. Repeated rows have the same result; an
    empty table gives no rows. ``threshold`` is at least ``GRAM``.
    """
    if threshold < GRAM:
        raise ValueError(f"threshold must be at least {GRAM} bytes")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc", "text"))
    long_enough = rows.where(F.col("doc").isNotNull() & (F.octet_length("text") >= threshold))

    digits = scratch.store(long_enough.mapInArrow(partial(_digits, threshold=threshold), "digit long, doc long, rid long"))
    shared = digits.groupBy("digit").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("digit")
    shared = scratch.store(shared)
    release(spark)
    hits = digits.select("digit", "rid").join(shared, "digit").groupBy("rid").agg(F.collect_set("digit").alias("digits"))
    hits = scratch.store(hits)
    scratch.drop(digits, shared)
    release(spark)

    strings = long_enough.join(hits, "rid").select("doc", "rid", "text", "digits")
    strings = scratch.store(strings.mapInArrow(partial(_strings, threshold=threshold), "digit long, s binary, doc long, rid long, start long"))
    scratch.drop(hits)
    release(spark)

    distinct = scratch.store(strings.groupBy("digit", "s").agg(F.min("doc").alias("low"), F.max("doc").alias("high")))
    release(spark)
    large = scratch.store(distinct.groupBy("digit").count().where(F.col("count") > group).select("digit"))
    small = distinct.join(large, "digit", "left_anti").repartition("digit").sortWithinPartitions("digit")
    owned = small.mapInArrow(partial(_owned, threshold=threshold), "s binary, a int, b int, owner long")
    owned = owned.union(_all_windows(distinct.join(large, "digit", "left_semi"), threshold))
    owned = scratch.store(owned.select(F.unhex(F.md5("s")).alias("key"), "a", "b", "owner"))
    scratch.drop(distinct)
    release(spark)

    found = strings.select(F.unhex(F.md5("s")).alias("key"), "doc", "rid", "start").join(owned, "key").where("owner < doc")
    mark = F.struct((F.col("start") + F.col("a")).alias("low"), (F.col("start") + F.col("b")).alias("high"))
    found = scratch.store(found.groupBy("doc", "rid").agg(F.collect_set(mark).alias("found")))
    scratch.drop(strings, owned)
    release(spark)

    result = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    return rows.join(found, ["doc", "rid"], "left").select("doc", "text", "found").mapInArrow(partial(_kept, threshold=threshold), result)
