"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import suffix_dedup as S
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, doc int, rid string, digit double, found long"
DATA = os.environ.get("TESTDATA", "/root/testdata")


def plain(rows, threshold=50):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    owner = {}
    for d, raw in texts:
        if d is not None:
            for i in range(len(raw) - threshold + 1):
                w = raw[i : i + threshold]
                owner[w] = min(owner.get(w, d), d)
    out = []
    for d, raw in texts:
        gone = np.zeros(len(raw), dtype=bool)
        if d is not None:
            for i in range(len(raw) - threshold + 1):
                if owner[raw[i : i + threshold]] < d:
                    gone[i : i + threshold] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), [tuple(map(int, x)) for x in edge.reshape(-1, 2)], hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(frame, **how):
    got = S.without_repeats(frame, **how).withColumn("sha", F.sha2("kept", 256)).drop("kept").collect()
    return sorted(((r.doc_id, r.n_bytes, [tuple(x) for x in r.spans], r.sha) for r in got), key=str)


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(8)] + ["x" * 49, "y" * 50, "z" * 51, "ab" * 200, " " * 90, "ü" * 30]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p)) if rng.random() < 0.4 else 0
            parts.append(p[cut:] if rng.random() < 0.7 else " ".join(word() for _ in range(20)))
        rows.append((rng.randrange(2 * n), " ".join(parts), 1, "r", 0.5, 1))
    line = "one very common line of a little more than fifty bytes, in all"
    rows += [(1000 + i, f"{word()}{word()}{word()}{i}\n{line}\n{i * 7919} {word()} {word()}", 1, "r", 0.5, 1) for i in range(120)]
    rows += [(7, None, 1, "r", 0.5, 1), (None, rows[3][1], 1, "r", 0.5, 1), (None, "q" * 80, 1, "r", 0.5, 1), (8, "", 1, "r", 0.5, 1), (-5, rows[9][1], 1, "r", 0.5, 1)]
    return rows + rows[:10] + [(99, "ab" * 3000 + "c", 1, "r", 0.5, 1), (98, "c" + "ab" * 2000, 1, "r", 0.5, 1)]


@pytest.mark.parametrize("how", [{}, {"group": 1}, {"threshold": 16}, {"threshold": 23, "group": 5}])
def test_removed_bytes_match_all_windows(spark, how):
    rows = corpus()
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4), **how) == plain(rows, how.get("threshold", 50))


def test_empty_table_and_bad_threshold(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == []
    with pytest.raises(ValueError):
        S.without_repeats(empty, threshold=8)


def test_long_rows_in_slices(monkeypatch):
    rng = random.Random(5)
    raw = np.frombuffer(bytes(rng.choices(b"abcdefgh ", k=9000)), dtype=np.uint8)
    offsets = np.array([0, 10, 10, 70, 3000, 8999, 9000])
    one = {(r, int(p)) for r in range(6) for p in range(int(offsets[r + 1] - offsets[r]) - 49)}
    monkeypatch.setattr(S, "SLICE_BYTES", 700)
    seen = {}
    for part, cuts, row, place in S._slices(raw, offsets, 50):
        first, windows, digit = S.runs(part, cuts, 50)
        at = np.searchsorted(cuts, first, side="right") - 1
        for f, w, d, a in zip(first, windows, digit, at, strict=True):
            for p in range(int(f - cuts[a]), int(f - cuts[a] + w)):
                assert (int(a) + row, p + place) not in seen
                seen[int(a) + row, p + place] = int(d)
    assert set(seen) == one
    hashes = S.gram_hashes(raw)
    for (row, place), digit in seen.items():
        p = int(offsets[row]) + place
        assert digit == int(hashes[p : p + 35].min())


def test_sorting_in_small_portions(spark, monkeypatch):
    rng = random.Random(2)
    import pyarrow as pa

    strings = sorted((rng.randrange(40), bytes(rng.choices(b"ab", k=rng.randrange(20, 40))), rng.randrange(9)) for _ in range(500))
    strings = [(d, s, low, low + rng.randrange(3)) for d, s, low in {(d, s): (d, s, low) for d, s, low in strings}.values()]
    strings.sort()
    monkeypatch.setattr(S, "SORT_BYTES", 600)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*strings[i : i + 7], strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["digit", "s", "low", "high"])
        for i in range(0, len(strings), 7)
    ]
    got = [tuple(r.values()) for b in S._owned(iter(batches), 18) for r in b.to_pylist()]
    owner = {}
    for d, s, low, _ in strings:
        for i in range(len(s) - 17):
            key = d, s[i : i + 18]
            owner[key] = min(owner.get(key, low), low)
    want = {(s, i, owner[d, s[i : i + 18]]) for d, s, _, high in strings for i in range(len(s) - 17) if owner[d, s[i : i + 18]] < high}
    assert {(s, i, o) for s, a, b, o in got for i in range(a, b)} == want


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test tables")
def test_query_on_the_smallest_tables(spark):
    got = sorted(map(tuple, QUERIES["op12_suffix_dedup"](spark, f"{DATA}/sf0.001").collect()))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, sum(b - a for a, b in spans), len(spans), sha) for d, n, spans, sha in plain(rows)]
    assert got == sorted(want) and any(r[2] for r in got)
