"""Mixing to target weights by soft membership; DataFrame functions only.

A table of labelled documents names the domain of some. A classifier fitted on a bounded sample
of them gives each document a posterior over the domains: log ratios of hashed words from one
half of the sample, and from the other half a softmax over these, length, repetition, capitals
and symbols, each row weighted by what it stands for. Fitting on rows that the ratios have not
seen keeps the posteriors honest, so their totals are near the true shares.

With ``t`` words and posterior ``p`` a document at rate ``r`` adds ``r t p`` to the expected
words of the domains. The rates solve a least-squares problem by projected gradient: every
round is one aggregation over all documents (the domain totals), a small linear system on the
driver, and the step ``r <- max(floor, r - p . step)`` in every document. The residual is
weighted by the inverse of the domains' own moments, so a few rounds suffice. The state between
rounds is the list of steps, not a column: a lost executor costs a recomputation only.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

BUCKETS = 4096
SAMPLE = 6000  # labelled documents that the classifier is fitted on, at most
SHRINK = 10.0
ROUNDS = 60
CLOSE = 1e-6
RESIDUAL = 0.01  # share of the target total that may be missed without a warning


def with_evidence(docs: DataFrame, kept: Sequence[str]) -> DataFrame:
    """(the kept columns, n_words, held, f_0 .. f_3): words, distinct hashed words, and four shapes of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / (F.length(text) + 1)
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    out = docs.select(*kept, words.alias("words"), count("[^A-Z]+").alias("f_2"), count(r"[\p{L}\p{N}\s]+").alias("f_3"))
    held = F.array_distinct(F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))
    out = out.select(*kept, F.size("words").cast("long").alias("n_words"), held.alias("held"), "f_2", "f_3")
    return out.select(*kept, "n_words", "held", F.log1p("n_words").alias("f_0"), (F.size("held") / (F.col("n_words") + 1)).alias("f_1"), "f_2", "f_3")


@dataclass
class Domains:
    """A fitted classifier: ratios of the buckets per domain, and a softmax over the evidence."""

    names: list[str]
    ratio: list[list[float]]
    weight: np.ndarray  # domain x (1 + evidence)

    def evidence(self) -> list[Column]:
        size = F.size("held") + F.lit(1.0)
        logs = [_sum_at(F.expr(f"array({', '.join(f'{x}D' for x in ratio)})")) for ratio in self.ratio]
        return [F.col(f"f_{i}") for i in range(4)] + [x / F.sqrt(size) for x in logs]


def _sum_at(weights: Column) -> Column:
    return F.aggregate("held", F.lit(0.0), lambda acc, b: acc + F.element_at(weights, b + 1))


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, importance: np.ndarray, ridge: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Weights (class x 1 + feature) of a softmax regression on raw features, by accelerated gradient."""
    prior = np.array([importance[y == k].sum() for k in range(classes)]) + 1e-9
    bias = np.log(prior / prior.sum())
    out = np.zeros((classes, x.shape[1] + 1))
    out[:, 0] = bias
    if len(x) < 2 * classes:
        return out
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack((np.ones(len(x)), (x - middle) / scale))
    w, before = np.zeros((classes, z.shape[1])), np.zeros((classes, z.shape[1]))
    w[:, 0] = before[:, 0] = bias
    share = importance / importance.sum()
    wanted = np.eye(classes)[y]
    step = 2.0 / (share @ (z * z).sum(axis=1))
    for turn in range(rounds):
        ahead = w + turn / (turn + 3) * (w - before)
        logit = z @ ahead.T
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = ((p - wanted) * share[:, None]).T @ z
        slope[:, 1:] += ridge * ahead[:, 1:]
        w, before = ahead - step * slope, w
    out[:, 1:] = w[:, 1:] / scale
    out[:, 0] = w[:, 0] - out[:, 1:] @ middle
    return out


def fit_domains(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE) -> Domains | None:
    """From labelled (doc_id, domain), at most about ``most`` of them; None without labels.

    What reaches the driver is a row per domain and bucket, and a row of numbers for each sampled
    document. A document with several domains counts for the smallest name.
    """
    one = labelled.where("domain IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    size = {r["domain"]: r["n"] for r in one.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(size)
    if not names:
        return None
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, most / len(names) / size[k]))])
    few = one.where(F.xxhash64("doc_id", F.lit(5)) / 2.0**64 + 0.5 < share[F.col("domain")]).limit(2 * most)
    few = few.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)))
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    found = Scratch(docs.sparkSession).store(with_evidence(found, ["doc_id", "domain", "half"]))
    held = found.where("half = 0").select("domain", F.explode(F.concat("held", F.array(F.lit(-1)))).alias("bucket"))
    n = np.zeros((len(names), BUCKETS + 1))
    for r in held.groupBy("domain", "bucket").agg(F.count("*").alias("n")).collect():
        n[names.index(r["domain"]), r["bucket"]] = r["n"]  # bucket -1, in the last place, counts the documents
    each, n = n[:, -1], n[:, :-1]
    overall = (n / np.maximum(each, 1)[:, None]).mean(axis=0)
    ratio = np.log((n + SHRINK) / (each[:, None] * overall + SHRINK)).round(6).tolist()
    model = Domains(names, ratio, np.zeros((len(names), 5 + len(names))))
    rows = found.where("half = 1").select("domain", F.array(*model.evidence()).alias("x")).collect()
    y = np.array([names.index(r["domain"]) for r in rows], dtype=np.int64)
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), 4 + len(names))
    taken = np.bincount(y, minlength=len(names))
    importance = np.array([size[k] for k in names]) / np.maximum(taken, 1)
    model.weight = softmax_fit(x, y, len(names), importance[y])
    if not len(rows):
        model.weight[:, 0] = np.log(np.array([size[k] for k in names]) / sum(size.values()))
    return model


def posteriors(docs: DataFrame, model: Domains, carried: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(the columns carried, n_words, p_<i> per domain)."""
    n = len(model.names)
    out = with_evidence(docs, carried)
    evidence = model.evidence()
    out = out.select(*carried, "n_words", *[e.alias(f"e_{i}") for i, e in enumerate(evidence)])
    logit = lambda k: sum((F.col(f"e_{i}") * float(model.weight[k, i + 1]) for i in range(len(evidence))), F.lit(float(model.weight[k, 0])))
    out = out.select(*carried, "n_words", *[logit(k).alias(f"l_{k}") for k in range(n)])
    top = F.greatest(*[F.col(f"l_{i}") for i in range(n)]) if n > 1 else F.col("l_0")
    out = out.select(*carried, "n_words", *[F.exp(F.col(f"l_{i}") - top).alias(f"x_{i}") for i in range(n)])
    norm = sum((F.col(f"x_{i}") for i in range(1, n)), F.col("x_0"))
    return out.select(*carried, "n_words", *[(F.col(f"x_{i}") / norm).alias(f"p_{i}") for i in range(n)])


def rate_after(steps: list[list[float]], n: int, floor: float) -> Column:
    """A document's rate after these projected steps, from 1."""
    if not steps:
        return F.lit(1.0)
    taken = F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in s) + ")" for s in steps) + ")")
    return F.aggregate(
        taken, F.lit(1.0),
        lambda r, s: F.greatest(F.lit(float(floor)), r - sum((F.col(f"p_{i}") * s[i] for i in range(1, n)), F.col("p_0") * s[0])),
    )


def fitted_rates(table: DataFrame, n: int, targets: np.ndarray, floor: float = 0.0, rounds: int = ROUNDS) -> tuple[list[list[float]], np.ndarray]:
    """The steps of the projected gradient and the domain totals reached."""
    p = [F.col(f"p_{i}") for i in range(n)]
    t = F.col("n_words")
    moments = table.agg(*[F.sum(t * p[i] * p[j]).alias(f"m_{i}_{j}") for i in range(n) for j in range(n)]).first()
    inverse = np.linalg.pinv(np.array([[moments[f"m_{i}_{j}"] or 0.0 for j in range(n)] for i in range(n)]), rcond=1e-9, hermitian=True)
    steps: list[list[float]] = []
    totals = targets
    for turn in range(rounds + 1):
        rate = rate_after(steps, n, floor)
        row = table.agg(*[F.sum(t * p[i] * rate).alias(f"s_{i}") for i in range(n)]).first()
        totals = np.array([row[f"s_{i}"] or 0.0 for i in range(n)])
        step = inverse @ (totals - targets)
        if turn == rounds or np.abs(step).max(initial=0.0) < CLOSE:
            break
        steps.append(step.tolist())
    return steps, totals


def mixed(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], keep_all: bool = False, most: int = SAMPLE, carried: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """(doc_id, n_words, domain, p_domain, rate, posterior) of every row of ``docs`` (doc_id, text; others ignored).

    ``weights`` are the wanted shares of the domains of ``labelled`` (doc_id, domain); domains
    without a weight aim at 0. The targets sum to the present number of words, or with
    ``keep_all`` to the least number at which no domain must shrink, and then no rate falls below
    1. ``domain`` is the likeliest domain (of equal ones the first by name), ``p_domain`` its
    posterior. Null and empty texts have 0 words and the posterior of an empty text. Targets that
    the documents cannot reach within ``RESIDUAL`` give a warning with the shares reached. Without labels all rates are 1
    and the domain is null. Repeated rows each have their row. ``carried`` are the columns of
    ``docs`` that come back with each row in place of doc_id.
    """
    model = fit_domains(docs, labelled, most)
    if model is None:
        return with_evidence(docs, carried).select(*carried, "n_words", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("p_domain"), F.lit(1.0).alias("rate"), F.create_map().cast("map<string,double>").alias("posterior"))
    names, n = model.names, len(model.names)
    table = Scratch(docs.sparkSession).store(posteriors(docs, model, carried))
    now = table.agg(*[F.sum(F.col("n_words") * F.col(f"p_{i}")).alias(f"s_{i}") for i in range(n)]).first()
    present = np.array([now[f"s_{i}"] or 0.0 for i in range(n)])
    share = np.array([weights.get(k, 0.0) for k in names])
    total = present.sum()
    if keep_all:
        total = max([present[i] / share[i] for i in range(n) if share[i] > 0], default=total)
    targets = share / share.sum() * total if share.sum() else present
    steps, reached = fitted_rates(table, n, targets, 1.0 if keep_all else 0.0)
    missed = np.abs(reached - targets).max(initial=0.0)
    if missed > RESIDUAL * targets.sum():
        shares = dict(zip(names, (reached / max(reached.sum(), 1e-9)).round(4).tolist(), strict=True))
        warnings.warn(f"the mix misses its targets: reached shares {shares}", stacklevel=2)
    best = F.greatest(*[F.struct(F.col(f"p_{i}").alias("p"), F.lit(-i).alias("turn"), F.lit(k).alias("name")) for i, k in enumerate(names)]) if n > 1 else F.struct(F.col("p_0").alias("p"), F.lit(names[0]).alias("name"))
    posterior = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.col(f"p_{i}"))])
    return table.select(
        *carried, "n_words", best["name"].alias("domain"), best["p"].alias("p_domain"),
        rate_after(steps, n, 1.0 if keep_all else 0.0).alias("rate"), posterior.alias("posterior"),
    )


def copies(rate: Column, doc_id: Column, seed: int = 3) -> Column:
    """Whole copies of a document at that rate: the fraction is settled by a hash of the id."""
    draw = F.xxhash64(doc_id, F.lit(seed)) / 2.0**64 + 0.5
    return F.floor(rate + draw).cast("int")
