"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine.

A bounded sample of labelled texts gives the examples and, for each term (words, and their first
letters), how far its presence tells the labels apart: chi / (chi + ``HALF_CHI``) of the
chi-square statistic multiplies the inverse document frequency, which is counted over all
documents. No term of the sample is left out; one that the sample lacks has weight 0, so the
cosine is that of whole texts. The examples lie in blocks of an inverted index: for a term, the
postings of each block and the block's largest weight. For a text the block maxima bound the
cosine that a block can hold; the block of the highest bound is opened first, then all whose
bounds reach the k-th best example so far, so the k nearest are exact. The texts of a portion that
open a block meet it together: common terms by a matrix product, all others by their postings. Votes weighted by cosine
give a raw score; a logistic curve fitted on sampled texts that are not examples turns it into a
probability. Scoring runs in tasks, on the text column only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Scratch

SAMPLE = 6_000  # labelled texts that the model is fitted on, at most; half of each label if there are
EXAMPLES = 2_000
HALF_CHI = 15.0  # chi-square at which a term has half its weight
NEAREST = 15
BLOCK = 256
OPENED = 1  # blocks opened first; all others that may hold a better example follow
COMMON = 1_024  # terms with most postings, whose postings in a block are a matrix; the others' are lists
PORTION, PORTION_CHARS = 256, 1_000_000  # texts scored at once, and their characters
PRIOR = 0.5
PREFIXES = (4, 6)
KEPT_WORDS = 300_000  # words whose terms a task remembers
NO_EVIDENCE = 0.49  # highest score of a text that is like no example
WORD = re.compile(r"\w+")
EVIDENCE = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])


def terms_of(word: str) -> list[str]:
    """The word and its first 4 and 6 letters, for forms that the sample lacks."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def portions(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts (null: empty) in lists of bounded count and length; a longer text is alone."""
    part, held = [], 0
    for text in texts:
        text = text or ""
        if part and (len(part) == PORTION or held + len(text) > PORTION_CHARS):
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def firsts(sorted_key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate((np.ones(len(sorted_key[:1]), dtype=bool), sorted_key[1:] != sorted_key[:-1])))


@dataclass
class Terms:
    """Places of the sample's terms; the examples' terms come first."""

    names: pa.Array
    inner: int  # terms of the examples
    rows: dict[str, int] = field(default_factory=dict)  # row of a remembered word in ``table``
    table: np.ndarray = field(default_factory=lambda: np.empty((0, 3), dtype=np.int64))

    @cached_property
    def place(self) -> dict[str, int]:
        """Place of each term; made where it is used, the driver holds the names as one buffer."""
        return dict(zip(self.names.to_numpy(zero_copy_only=False).tolist(), range(len(self.names)), strict=True))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, place, count) of every distinct known term of each text, in order."""
        words = [WORD.findall(t.lower()) for t in texts]
        size = [len(w) for w in words]
        flat = list(chain.from_iterable(words))
        if len(self.rows) > KEPT_WORDS:
            self.rows.clear()
        rows, place = self.rows, self.place
        row = np.fromiter(map(rows.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        unknown = np.flatnonzero(row < 0).tolist()
        if unknown:
            low = len(rows)
            fresh = list(dict.fromkeys([flat[i] for i in unknown]))
            rows.update(zip(fresh, range(low, low + len(fresh)), strict=True))
            row[unknown] = [rows[flat[i]] for i in unknown]
            if len(rows) > len(self.table):
                self.table = np.concatenate((self.table, np.empty((max(len(rows), 1024), 3), dtype=np.int64)))
            self.table[low : len(rows)] = -1
            self.table[low : len(rows), 0] = [place.get(w, -1) for w in fresh]
            for at, letters in enumerate(PREFIXES, 1):
                longer = [i for i, w in enumerate(fresh) if len(w) > letters]
                self.table[np.array(longer, dtype=np.int64) + low, at] = [place.get(f"{fresh[i][:letters]}*", -1) for i in longer]
        key = np.repeat(np.arange(len(texts)), size) * max(len(rows), 1) + row
        key.sort()
        first = firsts(key)
        n = np.diff(first, append=len(key))
        text, word = np.divmod(key[first], max(len(rows), 1))
        term = self.table[word]
        held = term >= 0
        key = (text[:, None] * len(self.names) + term)[held]
        n = np.broadcast_to(n[:, None], held.shape)[held]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = firsts(key)
        n = np.add.reduceat(n[order], first) if len(first) else n
        text, term = np.divmod(key[first], max(len(self.names), 1))
        return text, term, n


@dataclass
class Index:
    """Block-max inverted index of the examples."""

    terms: Terms
    weight: np.ndarray  # of each term: idf, times how far the term tells the labels apart
    label: np.ndarray  # of each example, in block order
    ids: np.ndarray
    # Postings by block, term and example:
    term: np.ndarray
    example: np.ndarray
    value: np.ndarray
    prior: float = 0.0
    curve: tuple[float, float] = (0.0, 1.0)

    @property
    def blocks(self) -> int:
        return -(-len(self.label) // BLOCK)

    @cached_property
    def common(self) -> np.ndarray:
        """Row of each term in ``dense``; -1 for all but the ``COMMON`` terms with most postings."""
        held = np.bincount(self.term, minlength=self.terms.inner)
        out = np.full(self.terms.inner, -1)
        most = np.argsort(-held, kind="stable")[:COMMON]
        out[most] = np.arange(len(most))
        return out

    @cached_property
    def dense(self) -> np.ndarray:
        """Postings of common terms as a matrix (term, example) for each block."""
        out = np.zeros((self.blocks, min(COMMON, self.terms.inner), BLOCK))
        at = self.common[self.term]
        held = at >= 0
        out[self.example[held] // BLOCK, at[held], self.example[held] % BLOCK] = self.value[held]
        return out

    @cached_property
    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in their block and weights of all other postings, and where those of (block, term) start."""
        rare = self.common[self.term] < 0
        block, place = np.divmod(self.example[rare].astype(np.int64), BLOCK)
        slot = block * self.terms.inner + self.term[rare]
        return place, self.value[rare], np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=self.blocks * self.terms.inner))))

    @cached_property
    def block_max(self) -> np.ndarray:
        """Largest weight of a term (row) in a block (column)."""
        out = np.zeros((self.terms.inner, self.blocks))
        np.maximum.at(out, (self.term, self.example // BLOCK), self.value)
        return out

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, term, normed weight) of whole texts, in order."""
        text, term, n = self.terms.of(texts)
        weight = (1 + np.log(n)) * self.weight[term]
        held = weight > 0
        text, term, weight = text[held], term[held], weight[held]
        norm = np.sqrt(np.bincount(text, weight**2, minlength=len(texts)))
        return text, term, weight / norm[text]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms of one whole text and their normed weights."""
        return self.vectors([text or ""])[1:]

    def cosines(self, n: int, text: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Cosines of ``n`` texts (rows) with the examples, 0 in blocks that cannot hold one of the nearest."""
        out = np.zeros((n, self.blocks * BLOCK))
        held = term < self.terms.inner
        text, term, weight = text[held], term[held], weight[held]
        if not len(text):
            return out
        bound = np.zeros((n, self.blocks))
        first = firsts(text)
        bound[text[first]] = np.add.reduceat(weight[:, None] * self.block_max[term], first)
        row = self.common[term]
        often = row >= 0
        some = np.zeros((n, self.dense.shape[1]))
        some[text[often], row[often]] = weight[often]
        text, term, weight = text[~often], term[~often], weight[~often]
        place, value, starts = self.postings

        def open_blocks(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                asked = np.flatnonzero(wanted[:, b])
                score = some[asked] @ self.dense[b]
                local = np.full(n, -1)
                local[asked] = np.arange(len(asked))
                slot = b * self.terms.inner + term
                start, many = starts[slot], starts[slot + 1] - starts[slot]
                pick = np.flatnonzero((many > 0) & (local[text] >= 0))
                start, many = start[pick], many[pick]
                at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
                cell = np.repeat(local[text[pick]] * BLOCK, many) + place[at]
                score += np.bincount(cell, np.repeat(weight[pick], many) * value[at], minlength=score.size).reshape(score.shape)
                # The product's last digits depend on the texts beside a text; the rounded ones do not.
                out[asked, b * BLOCK : (b + 1) * BLOCK] = score.round(12)

        order = np.argsort(-bound, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(self.blocks)[None, :], axis=1)
        open_blocks((rank < OPENED) & (bound > 0))
        open_blocks((rank >= OPENED) & (bound > 0) & (bound >= kth(out)[:, None] - 1e-9))
        return out

    def found(self, n: int, text: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, cosine, example) of the k examples of highest cosine above 0.

        Exact; by text, then from the nearest on; ties go to the first in the index.
        """
        cosine = self.cosines(n, text, term, weight)
        near = (cosine > 0) & (cosine >= kth(cosine)[:, None])
        text, best = np.nonzero(near)
        cosine = cosine[text, best]
        order = np.lexsort((best, -cosine, text))
        text, best, cosine = text[order], best[order], cosine[order]
        first = np.searchsorted(text, np.arange(n))
        held = np.arange(len(text)) - first[text] < NEAREST
        return text[held], cosine[held], best[held]

    def nearest(self, term: np.ndarray, weight: np.ndarray) -> list[tuple[float, int]]:
        """Cosine and example of the k nearest of one vector."""
        _, cosine, best = self.found(1, np.zeros(len(term), dtype=np.int64), term, weight)
        return list(zip(cosine.tolist(), best.tolist(), strict=True))

    def votes(self, n: int, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        text, cosine, best = found
        for_one = np.bincount(text, cosine**2 * self.label[best], minlength=n)
        return (for_one + PRIOR * self.prior) / (np.bincount(text, cosine**2, minlength=n) + PRIOR)

    def raw(self, vector: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[tuple[float, int]]]:
        """Weighted vote on one vector and its nearest."""
        term, weight = vector
        found = self.found(1, np.zeros(len(term), dtype=np.int64), term, weight)
        return float(self.votes(1, found)[0]), list(zip(found[1].tolist(), found[2].tolist(), strict=True))

    def probability(self, raw):
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * logit(raw), -30, 30)))

    def judged(self, texts: list[str]) -> pa.StructArray:
        """Score, prediction and evidence of each text."""
        n = len(texts)
        if len(self.label):
            found = self.found(n, *self.vectors(texts))
            score = self.probability(self.votes(n, found))
        else:
            found, score = (np.empty(0, dtype=np.int64),) * 3, np.zeros(n)
        text, cosine, best = found
        many = np.bincount(text, minlength=n)
        score = np.where(many == 0, np.minimum(score, NO_EVIDENCE), score)
        evidence = pa.StructArray.from_arrays(
            [pa.array(self.ids[best], pa.int64()), pa.array(cosine, pa.float64()), pa.array(self.label[best], pa.int32())], fields=list(EVIDENCE)
        )
        evidence = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), evidence)
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32()), evidence], ["score", "predicted", "evidence"])


def kth(cosine: np.ndarray) -> np.ndarray:
    """The k-th highest cosine of each row, 0 where there are fewer."""
    if cosine.shape[1] < NEAREST:
        return np.zeros(len(cosine))
    return np.partition(cosine, -NEAREST, axis=1)[:, -NEAREST]


def untaught() -> Index:
    """The index when there are not texts of both labels."""
    none = np.empty(0, dtype=np.int64)
    return Index(Terms(pa.array([], pa.string()), 0), np.empty(0), none, none, none, none, np.empty(0))


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def sample_terms(texts: DataFrame) -> pa.Table:
    """Every term of the sample, the examples' first: (term, shown, a, b).

    ``a`` and ``b`` count the texts of label 1 and 0 that hold it, ``shown`` the examples. Counted
    in tasks and summed by Spark; as many terms as the bounded sample has reach the driver.
    """

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count: dict[str, list[int]] = {}
            for text, y, example in zip(pdf["text"], pdf["label"], pdf["example"], strict=True):
                for f in {f for w in set(WORD.findall(text.lower())) for f in terms_of(w)}:
                    c = count.setdefault(f, [0, 0, 0])
                    c[y] += 1
                    c[2] += example
            yield pd.DataFrame([(f, *c) for f, c in count.items()], columns=["term", "b", "a", "shown"])

    counts = texts.select("text", "label", "example").mapInPandas(held, "term string, b double, a double, shown long")
    found = counts.groupBy("term").agg(F.sum("shown").alias("shown"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = found.withColumn("inner", (F.col("shown") > 0).cast("int")).toArrow()
    return found.sort_by([("inner", "descending"), ("term", "ascending")]).combine_chunks()


def document_counts(docs: DataFrame, terms: Terms) -> np.ndarray:
    """How many of all documents hold each term: one aggregation, restricted to the given terms."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(terms.names), dtype=np.int64)
        for batch in batches:
            for part in portions(batch.column(0).to_pylist()):
                n += np.bincount(terms.of(part)[1], minlength=len(n))
        term = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n[term])], ["term", "n"])

    found = docs.select("text").where("text IS NOT NULL").mapInArrow(held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms.names))
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def build(docs: DataFrame, texts: DataFrame, share: float) -> Index:
    """Index over the sample (doc_id, text, label, draw, example); ``share`` is the true share of label 1."""
    n = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return untaught()
    found = sample_terms(texts)
    terms = Terms(found["term"].combine_chunks(), int(found["inner"].to_numpy().sum()))
    a, b = found["a"].to_numpy(), found["b"].to_numpy()
    c, d, every = n[1] - a, n[0] - b, n[0] + n[1]
    spread = (a + b) * (c + d) * float(n[0] * n[1])
    chi = np.divide(every * (a * d - b * c) ** 2, spread, out=np.zeros(len(a)), where=spread > 0)
    idf = np.log((2 + docs.count()) / (1 + document_counts(docs, terms)))
    none = np.empty(0, dtype=np.int64)
    index = Index(terms, idf * chi / (chi + HALF_CHI), none, none, none, none, np.empty(0), share)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [index.vector(t) for t in pdf["text"]]
            heaviest = [t[int(np.argmax(w))] if len(t) else -1 for t, w in both]
            yield pdf[["doc_id", "label", "draw"]].assign(heaviest=heaviest, term=[t for t, _ in both], weight=[w for _, w in both])

    shown = texts.where("example").select("doc_id", "text", "label", "draw")
    rows = shown.mapInPandas(vectors, "doc_id long, label int, draw long, heaviest int, term array<int>, weight array<double>").toArrow()
    # Blocks hold like examples: in order of the label and of the heaviest term.
    rows = rows.sort_by([(name, "ascending") for name in ("label", "heaviest", "draw", "doc_id")]).combine_chunks()
    term = rows["term"].combine_chunks()
    example = np.repeat(np.arange(len(rows), dtype=np.int32), pc.list_value_length(term).to_numpy(zero_copy_only=False))
    term = term.flatten().to_numpy()
    order = np.lexsort((example, term, example // BLOCK))
    index.term, index.example = term[order], example[order]
    index.value = rows["weight"].combine_chunks().flatten().to_numpy()[order]
    index.label = rows["label"].to_numpy().astype(np.int64)
    index.ids = rows["doc_id"].to_numpy().copy()
    del rows, term, example, order

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [index.votes(len(part), index.found(len(part), *index.vectors(part))) for part in portions(pdf["text"])]
            yield pd.DataFrame({"label": pdf["label"], "raw": np.concatenate([np.empty(0), *raw])})

    rest = texts.where("NOT example").select("text", "label").mapInPandas(votes, "label int, raw double").orderBy("label", "raw").toPandas()
    y = rest["label"].to_numpy()
    if len(set(y.tolist())) == 2:
        weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
        index.curve = logistic(logit(rest["raw"].to_numpy()), y, weight)
    return index


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic curve by Newton steps, lightly held towards (0, 1)."""
    z, beta = np.column_stack([np.ones_like(x), x]), np.array([0.0, 1.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (p - y)) + (beta - [0.0, 1.0])
        hess = z.T @ (z * (weight * p * (1 - p))[:, None]) + np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Index:
    """Fit on documents (doc_id, text) with labels (doc_id, toxic); null labels and texts are left out.

    A document with several labels has their rounded mean. ``most`` bounds the sampled rows; the
    driver holds their terms and the examples' postings, not their texts; the sample's ids, as
    few, go to the tasks that read texts. Document counts are those of all rows of ``docs``.
    """
    one = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("toxic")).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return untaught()
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most / 2 / n))])
    few = one.where(F.xxhash64("doc_id", F.lit(11)) / 2.0**64 + 0.5 < share[F.col("toxic")]).limit(2 * most)
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(few), "doc_id")
    texts = found.groupBy(F.xxhash64("text").alias("draw")).agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.round(F.avg("toxic")).cast("int").alias("label"))
    scratch = Scratch(docs.sparkSession)
    texts = scratch.store(texts)
    # Every second text of a label may be an example, the others fit the curve. Only the keys are ordered.
    turn = F.row_number().over(Window.partitionBy("label").orderBy("draw")) - 1
    marks = texts.select("draw", ((turn % 2 == 0) & (turn < EXAMPLES)).alias("example"))
    marked = scratch.store(texts.join(F.broadcast(marks), "draw"))
    scratch.drop(texts)
    index = build(docs, marked, counts.get(1, 0) / total)
    scratch.drop(marked)
    return index


def scored(text: Column, index: Index) -> Column:
    """struct(score, predicted, evidence) of each whole text.

    ``evidence`` lists the nearest examples (doc_id, cosine, label). A null or empty text, or one
    without a term of an example, has no evidence; its score is the prior's, never above
    ``NO_EVIDENCE``. Where the labelled texts have one label only, or there are none, every score is 0.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [index.judged(part) for part in portions(texts.to_pylist())]
            yield pa.concat_arrays(parts or [index.judged([])])

    kind = "score double, predicted int, evidence array<struct<doc_id: long, cosine: double, label: int>>"
    return F.arrow_udf(kind)(run)(text)
