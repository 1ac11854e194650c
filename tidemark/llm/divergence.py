"""Divergence between sources of a language, from term counts found by sorting word starts.

Terms are not cut out of the text. Over the Arrow buffer of a slice of rows each word start is a
pointer with a length; the pointers are ordered by multikey quicksort, eight bytes of the word
at a time (less, equal, greater than a pivot; only the equal part goes on to the next eight).
Equal runs of the order are the terms: their rows give document frequencies, their groups the
counts. Spark adds the slices up, keeps the frequent terms of each language and compares.

All shares are whole numbers in parts of ``SCALE``. Sources meet in blocks of a bounded number
of sources and terms, each summed by one task, and only the sums of a pair leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

SCALE = 1_000_000_000
PRIOR = 5
SLICE_BYTES = 8 << 20  # text whose word starts are sorted together
SMALL = 4096  # pointers that are no longer partitioned but ordered digit by digit
BLOCK_SOURCES = 64
BLOCK_TERMS = 2048

# Letters of ASCII in lower case and every byte of a longer character stand for themselves, others end a word.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 0 for b in range(256)], dtype=np.uint8)
_KEEP = np.array([0] + [2**64 - 2 ** (64 - 8 * n) for n in range(1, 9)], dtype=np.uint64)  # the first n bytes of eight


class Words:
    """Word starts of rows that lie one behind another in a buffer."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        data = np.zeros(len(raw) + 8, dtype=np.uint8)
        np.take(_FOLD, raw, out=data[: len(raw)])
        inside = data[: len(raw)] != 0
        first = offsets[:-1][offsets[:-1] < offsets[1:]]  # of every row that has bytes
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        begins[first] = inside[first]
        before = first[first > 0] - 1
        ends[before] = inside[before]
        self.data = data
        self.start = np.flatnonzero(begins)
        self.length = np.flatnonzero(ends) + 1 - self.start
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.eights = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))

    def digit(self, which: np.ndarray, depth: int) -> np.ndarray:
        """Eight bytes of each word from ``8 * depth``, as a number that orders like them; 0 beyond its end."""
        at = np.minimum(self.start[which] + 8 * depth, len(self.eights) - 1)
        left = np.clip(self.length[which] - 8 * depth, 0, 8)
        return self.eights[at].astype(np.uint64) & _KEEP[left]

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Pointers by word, equal words in text order, and marks where a run of equal words begins."""
        n = len(self.start)
        order, new = np.arange(n), np.zeros(n, dtype=bool)
        open_slices = [(0, n, 0)] if n else []
        while open_slices:
            low, high, depth = open_slices.pop()
            which = order[low:high]
            if high - low <= SMALL:
                self._finish(order[low:high], new[low:high], depth)
                continue
            key = self.digit(which, depth)
            pivot = np.sort(key[:: len(key) // 255])[127]
            less, more = key < pivot, key > pivot
            parts = which[less], which[~(less | more)], which[more]
            order[low:high] = np.concatenate(parts)
            middle, upper = low + len(parts[0]), high - len(parts[2])
            if len(parts[0]):
                open_slices.append((low, middle, depth))
            if len(parts[2]):
                open_slices.append((upper, high, depth))
            if int(pivot) & 0xFF:  # the words go on
                open_slices.append((middle, upper, depth + 1))
            else:
                new[middle] = True
        return order, new

    def _finish(self, order: np.ndarray, new: np.ndarray, depth: int) -> None:
        """Order a small slice in place; only what is still tied and not ended goes to the next digit."""
        new[0] = True
        at = np.arange(len(order))
        group = np.zeros(len(order), dtype=np.int64)
        while len(at):
            key = self.digit(order[at], depth)
            by = np.lexsort((key, group))
            order[at], key, group = order[at][by], key[by], group[by]
            starts = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
            new[at[starts]] = True
            group = np.cumsum(starts) - 1
            size = np.bincount(group)
            going = (size[group] > 1) & ((key & np.uint64(0xFF)) != 0)
            at, group, depth = at[going], group[going], depth + 1


def _text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, without a copy."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), places.astype(np.int64)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``SLICE_BYTES``; a longer row is a range of its own."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, side="right")) - 1)
        yield low, high
        low = high


def _strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The words at these places as a string array."""
    ends = np.cumsum(length)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    places = np.repeat(start - offsets[:-1], length) + np.arange(int(ends[-1]) if len(ends) else 0)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[places].tobytes()))


def slice_counts(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray, groups: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, rows that have it) of rows whose groups are numbered."""
    words = Words(raw, offsets)
    order, new = words.order()
    if not len(order):
        return pa.array([], "string"), order, order, order
    run, row = np.cumsum(new) - 1, words.row[order]
    each = np.flatnonzero(new | np.concatenate(([True], row[1:] != row[:-1])))  # a row within a run
    times = np.diff(np.append(each, len(order)))
    key = run[each] * groups + group[row[each]]
    by = np.argsort(key, kind="stable")
    key = key[by]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.add.reduceat(times[by], heads)
    rows = np.diff(np.append(heads, len(key)))
    lead = order[new]
    terms = _strings(words.data, words.start[lead], words.length[lead])
    return terms.take(pa.array(key[heads] // groups)), key[heads] % groups, count, rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = (batch.column(i).cast("string") for i in (0, 1))
        raw, offsets = _text_buffer(batch.column(2))
        pairs, group = np.unique(np.array(pd.factorize(lang.to_pandas())[0] * (len(batch) + 1) + pd.factorize(source.to_pandas())[0]), return_inverse=True)
        example = np.zeros(len(pairs), dtype=np.int64)
        example[group] = np.arange(len(group))
        for low, high in _slices(offsets):
            cut = offsets[low : high + 1]
            terms, at, count, rows = slice_counts(raw[cut[0] : cut[-1]], cut - cut[0], group[low:high], len(pairs))
            if len(terms):
                rep = pa.array(example[at])
                yield pa.RecordBatch.from_arrays(
                    [lang.take(rep), source.take(rep), terms, pa.array(count, "int64"), pa.array(rows, "int64")],
                    ["lang", "source", "term", "n", "rows"],
                )


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n) for terms in at least ``least_docs`` documents of the language, n > 0.

    Slices arrive already counted, so a frequent term is a row for each slice and not for each
    occurrence. One shuffle by (lang, term) serves the sums and the document frequency.
    """
    found = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, rows long")
    sums = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    within = Window.partitionBy("lang", "term")
    return sums.withColumn("df", F.sum("rows").over(within)).where(F.col("df") >= least_docs).select("lang", "source", "term", "n")


def share(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact beyond 64 bits; null without terms."""
    wide = lambda c: f"cast({c} as decimal(20,0))"
    return F.expr(f"1 + ({wide(count)} + {PRIOR}) * {SCALE} div nullif({wide(total)} + {PRIOR} * {wide(terms)}, 0)")


def _block_sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| of each pair of sources over the terms that any source of the two blocks has here."""
    lang, _, left, right = key
    source, names = pd.factorize(pdf["source"])
    term, terms = pd.factorize(pdf["term"])
    base = np.zeros(len(names), dtype=np.int64)
    block = np.zeros(len(names), dtype=np.int64)
    base[source], block[source] = pdf["p0"], pdf["block"]
    dense = np.repeat(base[:, None], len(terms), axis=1)
    held = term >= 0
    dense[source[held], term[held]] = pdf["p"][held]
    a, b, value = [], [], []
    for i in np.flatnonzero(block == left):
        others = np.flatnonzero((block == right) & ((np.arange(len(names)) > i) if left == right else True))
        if len(others):
            a += [names[i]] * len(others)
            b += names[others].tolist()
            value.append(np.abs(dense[others] - dense[i]).sum(axis=1))
    out = pd.DataFrame({"a": a, "b": b, "value": np.concatenate(value) if value else np.zeros(0, dtype=np.int64)})
    return out.astype({"a": str, "b": str}).assign(lang=lang, touched=len(terms))[["lang", "a", "b", "value", "touched"]]


def divergences(docs: DataFrame, least_docs: int = 30, ranks: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of ``docs``.

    ``docs`` needs text, lang and source, null counting as ''; other columns are ignored. Terms
    are runs of ASCII letters (lower-cased) and non-ASCII characters; a language keeps those in
    at least ``least_docs`` of its rows. With V kept terms and N their occurrences in a group, a
    term of ``count`` occurrences has the share ``1 + floor(SCALE * (count + 5) / (N + 5 V))``.
    Part ``pair`` ranks every other source of the language by the sum of the shares' differences
    over all kept terms, absent ones included (0 if none is kept). Part ``term`` ranks up to
    ``ranks`` terms of the group whose share exceeds the language's, by the excess. Equal values
    rank by item. Repeated rows count each; a group without text still has its pairs; a language
    with one source has none; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = scratch.store(term_counts(clean, least_docs))
    groups = scratch.store(clean.select("lang", "source").distinct())

    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    langs = sources.join(langs, "lang", "left").fillna(0, ["lang_total", "terms"])
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang")
    stats = scratch.store(stats.withColumn("none", F.lit(0)).withColumn("p0", share("none", "total", "terms")).drop("none"))

    placed = counts.join(stats, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))

    above = placed.join(terms, ["lang", "term"]).withColumn("q", share("lang_n", "lang_total", "terms")).where("p > q")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    pieces = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sliced = placed.withColumn("slice", F.pmod(F.xxhash64("term"), pieces("terms", BLOCK_TERMS)).cast("int"))
    # Every source is in every slice, with a row without a term, so that a pair meets where only one has terms.
    every = stats.where("terms > 0").withColumn("slice", F.explode(F.sequence(F.lit(0), pieces("terms", BLOCK_TERMS) - 1)))
    cell = sliced.unionByName(every, allowMissingColumns=True).withColumn("blocks", pieces("sources", BLOCK_SOURCES))
    cell = cell.withColumn("block", F.expr("cast(pmod(xxhash64(source), blocks) as int)"))
    cell = cell.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = cell.select("lang", "slice", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "source", "term", "block", "p", "p0")
    sums = cell.groupBy("lang", "slice", "low", "high").applyInPandas(_block_sums, "lang string, a string, b string, value long, touched long")
    sums = sums.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"), F.sum("touched").alias("touched"))

    one = stats.select("lang", F.col("source").alias("a"), F.col("p0").alias("p_a"), "terms")
    two = stats.select("lang", F.col("source").alias("b"), F.col("p0").alias("p_b"))
    pairs = one.join(two, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left").fillna(0, ["value", "touched"])
    absent = F.coalesce(F.abs(F.col("p_a") - F.col("p_b")) * (F.col("terms") - F.col("touched")), F.lit(0))
    pairs = pairs.select("lang", "a", "b", (F.col("value") + absent).alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value")
    pairs = pairs.select("lang", F.col("x.a").alias("source"), F.lit("pair").alias("part"), F.col("x.b").alias("item"), "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(above.withColumn("rank", rank).where(F.col("rank") <= ranks))
