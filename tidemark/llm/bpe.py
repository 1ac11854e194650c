"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece (a word) starts as one symbol per byte. The leaves of a segment tree hold the merge rank
of each adjacent pair together with its place; the root is therefore the leftmost pair of lowest
rank. That pair is merged and three leaves change (the merged pair, its left neighbour, the slot
that vanished), each updated up to the root in logarithmic time, until no pair can be merged.
Short pieces of one batch advance together as rows of arrays, long ones one at a time. Words
repeat a lot, so each Python worker keeps the ids of those it has met, up to a fixed number.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

TOGETHER = 64  # longest piece, in bytes, that is encoded in arrays
KEPT_WORDS = 500_000
ROWS_OUT = 500  # rows that a task hands on at a time
NONE = np.iinfo(np.int64).max

# Fixed values of the vocabulary's format.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
CONTROLS = regex.compile("[\x1c-\x1f]")  # white space to str.split, not to the vocabulary


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if printable, else the next free one."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


@dataclass
class Vocabulary:
    """What tasks need of a vocabulary file: its size is fixed by the file."""

    tokens: list[str]
    specials: dict[str, int]
    byte_id: np.ndarray
    end_id: np.ndarray
    pair: np.ndarray  # first * size + second, sorted
    rank: np.ndarray  # of each pair
    made: np.ndarray  # token that the merge of a rank makes

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        tokens = [""] * (max([*vocab.values(), *specials.values()]) + 1)
        for token, i in [*vocab.items(), *specials.items()]:
            tokens[i] = token
        symbols = byte_symbols()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"]]
        pair = np.array([vocab[a] * len(tokens) + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pair)
        return cls(
            tokens, specials, np.array([vocab[s] for s in symbols], dtype=np.int64),
            np.array([vocab[s + WORD_END] for s in symbols], dtype=np.int64),
            pair[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in merges], dtype=np.int64),
        )


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.size = len(vocabulary.tokens)
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.specials, key=len, reverse=True))) if vocabulary.specials else None
        self.rank_of = dict(zip(vocabulary.pair.tolist(), vocabulary.rank.tolist(), strict=True))
        self.shown = [t.encode() for t in vocabulary.tokens]
        self.kept: dict[str, bytes] = {}

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first * self.size + second
        at = np.minimum(np.searchsorted(self.v.pair, key), len(self.v.pair) - 1)
        return np.where((self.v.pair[at] == key) & (first >= 0) & (second >= 0), self.v.rank[at], -1)

    def together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes, a power of two: one row of the arrays each."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        column = np.arange(width)
        symbol = np.full((n, width + 1), -1, dtype=np.int64)
        symbol[:, :width] = np.where(column < length[:, None], self.v.byte_id[raw], -1)
        row = np.arange(n)
        symbol[row, length - 1] = self.v.end_id[raw[row, length - 1]]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[:, width] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        alive = np.zeros((n, width + 1), dtype=bool)
        alive[:, :width] = column < length[:, None]

        def leaf(first: np.ndarray, second: np.ndarray, place: np.ndarray) -> np.ndarray:
            rank = self.ranks(first, second)
            return np.where(rank < 0, NONE, rank * width + place)

        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        tree[:, width:] = leaf(symbol[:, :width], symbol[:, 1:], column[None, :])
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        while len(row := row[tree[row, 1] != NONE]):
            place = tree[row, 1] % width
            rank = tree[row, 1] // width
            gone = after[row, place]
            beyond = after[row, gone]
            symbol[row, place] = self.v.made[rank]
            alive[row, gone] = False
            after[row, place] = beyond
            before[row, beyond] = place
            left = before[row, place]
            has_left = left >= 0
            changed = [
                (row, gone, np.full(len(row), NONE)),
                (row, place, leaf(symbol[row, place], symbol[row, beyond], place)),
                (row[has_left], left[has_left], leaf(symbol[row, left], symbol[row, place], left)[has_left]),
            ]
            for r, at, value in changed:
                tree[r, width + at] = value
            for r, at, _ in changed:
                node = (width + at) // 2
                while len(node) and node[0]:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                    node = node // 2
        flat = symbol[alive].astype("<u4")
        ends = np.cumsum(alive.sum(axis=1)) * 4
        raw_ids = flat.tobytes()
        return [raw_ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def alone(self, piece: bytes) -> bytes:
        """The same tree for one long piece."""
        symbol = self.v.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        symbol[-1] = int(self.v.end_id[piece[-1]])
        n = len(symbol)
        width = 1 << (n - 1).bit_length()
        rank_of, made, size = self.rank_of, self.v.made, self.size
        none = NONE
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = rank_of.get(symbol[i] * size + symbol[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = [*range(1, n), -1], list(range(-1, n - 1))

        def put(place: int, value: int) -> None:
            node = width + place
            tree[node] = value
            node //= 2
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low
                node //= 2

        def pair(place: int) -> int:
            rank = rank_of.get(symbol[place] * size + symbol[after[place]]) if after[place] >= 0 else None
            return none if rank is None else rank * width + place

        while tree[1] != none:
            rank, place = divmod(tree[1], width)
            gone = after[place]
            symbol[place] = int(made[rank])
            after[place] = after[gone]
            if after[gone] >= 0:
                before[after[gone]] = place
            put(gone, none)
            put(place, pair(place))
            if before[place] >= 0:
                put(before[place], pair(before[place]))
        out, at = [], 0
        while at >= 0:
            out.append(symbol[at])
            at = after[at]
        return np.array(out, dtype="<u4").tobytes()

    def learn(self, wanted: set[str]) -> None:
        """Encode the words that are not known yet."""
        fresh = [w for w in wanted if w not in self.kept]
        if len(self.kept) + len(fresh) > KEPT_WORDS:
            self.kept.clear()
            fresh = list(wanted)
        cut = [self.pieces.findall(w) for w in fresh]
        by_width: dict[int, list[str]] = {}
        for p in {p for pieces in cut for p in pieces}:
            n = len(p.encode())
            by_width.setdefault(0 if n > TOGETHER else max(2, 1 << (n - 1).bit_length()), []).append(p)
        ids: dict[str, bytes] = {}
        for width, group in by_width.items():
            for i in range(0, len(group), 4096):
                raw = [p.encode() for p in group[i : i + 4096]]
                ids.update(zip(group[i : i + 4096], self.together(raw, width) if width else map(self.alone, raw), strict=True))
        for word, pieces in zip(fresh, cut, strict=True):
            self.kept[word] = b"".join(map(ids.__getitem__, pieces))

    def split(self, text: str) -> list:
        """Words between white space, and ids of special tokens, in order."""
        out: list = []
        at = 0
        for m in self.specials.finditer(text) if self.specials and "<|" in text else ():
            out += words(text[at : m.start()])
            out.append(self.v.specials[m[0]])
            at = m.end()
        return out + words(text[at:] if at else text)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for i in range(0, len(texts), ROWS_OUT):
            split = [self.split(t) for t in texts[i : i + ROWS_OUT]]
            self.learn({w for s in split for w in s if isinstance(w, str)})
            for s in split:
                try:
                    yield b"".join(map(self.kept.__getitem__, s))
                except KeyError:  # a special token
                    yield b"".join(self.kept[w] if isinstance(w, str) else np.uint32(w).tobytes() for w in s)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space, word ends shown, as a vocabulary without decoder does."""
        return b" ".join(map(self.shown.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode()


def words(text: str) -> list[str]:
    """NFC, each character in lower case by itself (no final sigma), cut at white space."""
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return text.split() if text.isprintable() or not CONTROLS.search(text) else regex.split(r"\s+", text)


_ENCODERS: dict[str, Encoder] = {}  # of this Python worker: tasks that follow find the known pieces


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of ``docs`` (doc_id, text; others ignored).

    ``path`` is the vocabulary file; it is read on the driver, its size is fixed, and tasks get
    it as a broadcast. ``ids`` is binary: little-endian unsigned 32-bit ids of the whole text,
    without added special tokens; a special token's string in the text gives its id. ``decoded``
    are the tokens of those ids. A null or empty text has no ids. Every row keeps a row.
    """
    key = uuid.uuid4().hex
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(vocabulary.value)
        encoder = _ENCODERS[key]
        for pdf in batches:
            for i in range(0, len(pdf), ROWS_OUT):
                part = pdf.iloc[i : i + ROWS_OUT]
                ids = list(encoder.encode([t or "" for t in part["text"]]))
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "n_tokens": [len(x) // 4 for x in ids], "ids": ids,
                    "decoded": [encoder.decode(x) for x in ids],
                })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids binary, decoded string")
