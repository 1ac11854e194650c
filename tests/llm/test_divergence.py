"""Source divergence against a plain count of every term, and the sorted word starts against Python's sort."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, value double"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, ranks):
    docs = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, words in own for w in set(words))
        kept = sorted(w for w, k in df.items() if k >= least)
        count = defaultdict(Counter)
        for _, source, words in own:
            count[source].update(w for w in words if df[w] >= least)
        whole = sum(count.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        shares = {s: {w: p(c, w) for w in kept} for s, c in count.items()}
        q = {w: p(whole, w) for w in kept}
        for s in count:
            pairs = [(-sum(abs(shares[s][w] - shares[o][w]) for w in kept), o) for o in count if o != s]
            terms = [(q[w] - shares[s][w], w) for w in kept if count[s][w] and shares[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:ranks])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = ["a", "The", "THE", "été", "Ærø", "日本", "x" * 9, "x" * 8, "x" * 17, "ſ", "İ", "Zz"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(n):
        source = f"s{min(rng.randrange(9), 5)}"
        text = rng.choice([" ", "\n", "-1", "\x7f"]).join(rng.choices(words, [1 + (hash_free(w, source) % 7) for w in words], k=rng.randrange(30)))
        rows.append((i, text, rng.choice(["en", "fr", None]), source, "x", 1, 0.5))
    rows += [(None, None, "en", None, None, None, None), (1, "", "en", "empty", "x", 1, 0.0), (2, "123 !!", "alone", "only", "x", 1, 0.0)]
    return rows + rows[:20]


def hash_free(word, source):
    return sum(word.encode()) * 31 + sum(source.encode())


@pytest.mark.parametrize("least, ranks", [(30, 50), (1, 3), (10_000, 50)])
def test_divergences_match_plain_counts(spark, monkeypatch, least, ranks):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in divergence.divergences(docs, least, ranks).collect())
    assert got == brute(rows, least, ranks)


def test_many_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 2)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 5)
    rows = corpus(200, 4)
    got = sorted(tuple(r) for r in divergence.divergences(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 4).collect())
    assert got == brute(rows, 3, 4)


def test_no_rows_and_no_text(spark):
    assert divergence.divergences(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None, None, None), (1, None, None, "b", None, None, None)]
    got = sorted(tuple(r) for r in divergence.divergences(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


@pytest.mark.parametrize("small", [1, 2, 64, 4096])
def test_order_of_word_starts(monkeypatch, small):
    monkeypatch.setattr(divergence, "SMALL", max(small, 255) if small > 1 else 255)
    rng = random.Random(small)
    texts = ["".join(rng.choices("abABé 日-", k=rng.randrange(60))) for _ in range(300)] + ["z" * 5000, "z" * 5000, "z" * 5001, "", "same", "same"]
    raw = [t.encode() for t in texts]
    words = divergence.Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    order, new = words.order()
    found = [bytes(words.data[s : s + k]) for s, k in zip(words.start[order], words.length[order], strict=True)]
    want = [(w.encode(), i) for i, t in enumerate(texts) for w in TERM.findall(lowered(t))]
    assert list(zip(found, words.row[order], strict=True)) == sorted(want)
    assert [i == 0 or found[i] != found[i - 1] for i in range(len(found))] == new.tolist()
