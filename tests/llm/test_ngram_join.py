import re

import numpy as np
import pandas as pd

from tidemark.llm.ngram_join import _bound_blocks, _in_several_sets, jaccard_components, links, parities, shingle_set


def brute(rows):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j), key=lambda k: sets[k][0])] = min(find(i), find(j), key=lambda k: sets[k][0])
    return sorted((d, len(s), sets[find(i)][0]) for i, (d, s) in enumerate(sets))


def near_copies():
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base)), (1, " ".join(base).upper()), (2, "  ".join(base) + "\n")]
    for k in range(3, 40):  # drifting copies, on both sides of the threshold
        base[(k * 37) % 120] = f"new{k}"
        rows.append((k, " ".join(base)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(100 + k, passage + " " + " ".join(f"x{k}_{i}" for i in range(40))) for k in range(40)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One two"), (204, "one TWO"), (205, "é É ü"), (206, "é é ü"), (207, "z " * 3000)]
    return rows


def test_components_match_all_pairs(spark):
    rows = near_copies()
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", 5, 7), (1, "a b c d e f", 6, 8), (None, "q r s t u v", 1, 1), (2, None, 1, 1)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, id int, component_id int"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2)], key=str)
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_are_whole_texts():
    assert len(shingle_set("a b c d")) == 1
    assert len(shingle_set("x y z w v " * 1000)) == 5
    assert len(shingle_set("\x1c ")) == 1  # not white space here


def test_shingles_of_one_set_are_dropped_across_batches():
    rows = pd.DataFrame(
        [(1, 10, 0), (2, 10, 0), (2, 10, 0), (3, 10, 0), (3, 11, 0), (3, 12, 0), (4, 10, 5), (5, 10, 0), (5, 10, 0), (6, 9, 0)],
        columns=["token", "id", "salt"],
    ).assign(n=7, rest=3)
    for size in range(1, len(rows) + 1):
        batches = (rows.iloc[i : i + size].reset_index(drop=True) for i in range(0, len(rows), size))
        got = pd.concat([rows.iloc[:0], *_in_several_sets(batches)])
        assert list(zip(got["token"], got["id"], strict=True)) == [(3, 10), (3, 11), (3, 12), (4, 10)]


def test_parity_bits_rule_out_large_sets_and_lose_no_link():
    draw = np.random.default_rng(5)
    base = np.unique(draw.integers(0, 1 << 48, 4_150, dtype=np.uint64))
    pool = [base, base[:4_000], base[500:], np.concatenate((base[:3_500], base[:60] + np.uint64(1)))]  # 4,096 and 8,192 bits
    pool += [np.unique(draw.integers(0, 1 << 48, n, dtype=np.uint64)) for n in (900, 1_000, 3_000, 3_300, 4_000, 4_300)]
    pool = [np.unique(x) for x in pool]
    rows = []
    for block in range(len(pool)):  # one member, then every set asks
        rows += [(0, block, 0, False, block, block, len(pool[block]), parities(pool[block]))]
        rows += [(0, block, 0, True, i, i, len(x), parities(x)) for i, x in enumerate(pool)]
    frame = pd.DataFrame(rows, columns=["grp", "block", "salt", "asks", "id", "comp", "n", "bits"])
    left = {(int(r.id), int(r.block)) for part in _bound_blocks(iter([frame])) for r in part.itertuples()}
    linked = {(i, j) for i, a in enumerate(pool) for j, b in enumerate(pool) if i != j and links(len(np.intersect1d(a, b)), len(a), len(b))}
    assert {(0, 1), (0, 2)} <= linked <= left
    assert all(i < 4 and j < 4 for i, j in left)
