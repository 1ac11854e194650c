"""URL filter: explicit rules, and naive Bayes over segmented host words for the rest.

A rule names a host and a path prefix; it fits its host and all subdomains, and the longest
fitting rule decides. For the other urls the host's labels are split into words by a unigram
Viterbi search (word probabilities from the pages' own texts), and multinomial naive Bayes over
those words and the path's tokens, fitted on the urls that rules decide, gives the verdict.
Hosts and paths are cut in SQL; segmentation runs in tasks. All words and tokens count: the
commonest are sent to the tasks, the others are joined to the hosts and rows that hold them.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

WORDS = 30_000  # commonest of the unigram model, sent to the tasks; the others are joined
TOKENS = 50_000  # commonest of the classifier, likewise
SMOOTH = 1.0
SPLIT = re.compile(r"[^a-z0-9]+")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule, as (verdict, host/path) pairs give them; null if none fits."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def split_at(counts: DataFrame, key: str, n: Column, most: int) -> tuple[list, DataFrame | None]:
    """The ``most`` commonest rows on the driver and the frame of all others, None if there are none."""
    head = counts.orderBy(n.desc(), key).limit(most + 1).collect()
    if len(head) <= most:
        return head, None
    last = counts.where(F.col(key) == head[most - 1][key]).select(n.alias("_n"), F.col(key).alias("_key"))
    rest = counts.join(F.broadcast(last), (n < F.col("_n")) | ((n == F.col("_n")) & (F.col(key) > F.col("_key"))))
    return head[:most], rest.select(counts.columns)


def word_costs(texts: DataFrame, column: str, scratch: Scratch) -> tuple[dict[str, float], float, DataFrame | None]:
    """-log probability of the commonest words of the html's text, the cost of a letter outside all
    words, and (word, cost) of the other words."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"<[^>]*>|&[a-z0-9#]+;", " ")
    words = texts.select(F.explode(F.split(plain, r"[^a-z]+")).alias("word")).where(F.length("word") > 0)
    counts = scratch.store(words.groupBy("word").count())
    total, least = counts.agg(F.sum("count"), F.min("count")).first()
    head, rest = split_at(counts, "word", F.col("count"), WORDS)
    if rest is not None:
        rest = rest.select("word", (-F.log(F.col("count") / F.lit(total))).alias("cost"))
    unknown = (-math.log(least / total) if total else 0.0) + 3.0
    return {r["word"]: -math.log(r["count"] / total) for r in head}, unknown, rest


def parts_of(host: str) -> Iterator[str]:
    """A host name's runs of letters."""
    for label in SPLIT.split(host):
        yield from re.findall(r"[^0-9]+", label)


def rare_words(hosts: DataFrame, rest: DataFrame) -> DataFrame:
    """(host, rare): the words of ``rest`` that lie within each distinct host, with their costs."""
    longest = rest.agg(F.max(F.length("word"))).first()[0]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for host in pdf["host"]:
                for part in parts_of(host):
                    for start in range(0, len(part), 64):
                        ends = lambda i: range(i + 1, min(len(part), i + longest) + 1)  # noqa: B023, E731
                        found = {part[i:j] for i in range(start, min(len(part), start + 64)) for j in ends(i)}
                        yield pd.DataFrame({"host": host, "word": sorted(found)})

    found = hosts.select("host").distinct().mapInPandas(pieces, "host string, word string").join(rest, "word")
    return found.groupBy("host").agg(F.map_from_entries(F.collect_set(F.struct("word", "cost"))).alias("rare"))


def segmented(name: str, cost: dict[str, float], unknown: float | None = None, longest: int | None = None) -> list[str]:
    """Words of a concatenated name: least total cost; letters outside all words cost the most.

    Of equal splits the one with the longest last word wins. Runs of digits are words.
    ``unknown`` is the cost of such a letter and ``longest`` the length of the longest word.
    """
    out: list[str] = []
    unknown = max(cost.values(), default=0.0) + 3.0 if unknown is None else unknown
    longest = max(map(len, cost), default=1) if longest is None else longest
    for part in re.findall(r"[0-9]+|[^0-9]+", name):
        if part[0].isdigit():
            out.append(part)
            continue
        best = [(0.0, 0)] + [(math.inf, 0)] * len(part)
        for end in range(1, len(part) + 1):
            for start in range(max(0, end - max(longest, 1)), end):
                word = part[start:end]
                step = cost.get(word, unknown if len(word) == 1 else math.inf)
                if best[start][0] + step < best[end][0] - 1e-12:
                    best[end] = (best[start][0] + step, start)
        at, words = len(part), []
        while at:
            words.append(part[best[at][1] : at])
            at = best[at][1]
        out += reversed(words)
    return out


def host_tokens(host: str, cost: dict[str, float], unknown: float, longest: int) -> list[str]:
    """h: words of the host's labels."""
    return [f"h:{w}" for label in SPLIT.split(host) if label for w in segmented(label, cost, unknown, longest)]


def path_tokens(path: str) -> list[str]:
    """p: tokens of the path (digits as one)."""
    return [f"p:{'#' if t.isdigit() else t}" for t in SPLIT.split(path.lower()) if t]


def judged(pages: DataFrame, rules: list[tuple[str, str]], words: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, score, tokens) of every row of ``pages`` (page_id, url, ``words``).

    ``rules`` are (verdict, host/path) pairs with verdicts allow and block. ``score`` is the
    method's probability of block, given for all rows; it decides where ``rule`` is null, and a
    tie or an empty model allows. A null url, or one without ://, has an empty host and path and
    no tokens. Repeated rows each keep a row; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    verdict_of = {rule: verdict for verdict, rule in rules}
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    cost, unknown, rest = word_costs(pages, words, scratch)
    longest = max(map(len, cost), default=1)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for pdf in batches:
            tokens = []
            for host, path, rare in zip(pdf["host"], pdf["path"], pdf["rare"], strict=True):
                if host not in known:
                    if len(known) > 100_000:
                        known.clear()
                    own = dict(rare) if rare is not None else {}
                    known[host] = host_tokens(host, ChainMap(own, cost) if own else cost, unknown, max([longest, *map(len, own)]))
                tokens.append(known[host] + path_tokens(path))
            yield pdf.drop(columns="rare").assign(tokens=tokens)

    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if rest is None:
        rows = rows.withColumn("rare", F.lit(None).cast("map<string,double>"))
    else:
        rows = rows.join(rare_words(rows, rest), "host", "left").select("page_id", "host", "path", "rule", "rare")
    rows = rows.mapInPandas(cut, "page_id long, host string, path string, rule string, tokens array<string>")
    rows = scratch.store(rows.withColumn("_row", F.monotonically_increasing_id()))
    truth = F.create_map(*[F.lit(x) for k, v in verdict_of.items() for x in (k, v)])[F.col("rule")] if rules else F.lit(None).cast("string")
    # Copies of a url teach once.
    taught = rows.where("rule IS NOT NULL").select("host", "path", "tokens", truth.alias("verdict")).dropDuplicates(["host", "path"])
    n = {r["verdict"]: r["n"] for r in taught.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    counts = taught.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.when(F.col("verdict") == "block", 1)).alias("b"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("a")
    )
    counts = scratch.store(counts)
    sums = counts.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    rows_in, others = split_at(counts, "token", F.col("b") + F.col("a"), TOKENS)
    kinds = (sums[2] or 0) + 1
    over = {"b": (sums[0] or 0) + SMOOTH * kinds, "a": (sums[1] or 0) + SMOOTH * kinds}
    odds = {r["token"]: math.log((r["b"] + SMOOTH) / over["b"]) - math.log((r["a"] + SMOOTH) / over["a"]) for r in rows_in}
    prior = math.log((n.get("block", 0) + SMOOTH) / (n.get("allow", 0) + SMOOTH))

    if others is None:
        rows = rows.withColumn("rest", F.lit(0.0))
    else:
        ratio = F.log((F.col("b") + SMOOTH) / over["b"]) - F.log((F.col("a") + SMOOTH) / over["a"])
        each = rows.select("_row", F.explode("tokens").alias("token")).join(others.select("token", ratio.alias("odds")), "token")
        rows = rows.join(each.groupBy("_row").agg(F.sum("odds").alias("rest")), "_row", "left").fillna(0.0, ["rest"])

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tokens, rest in batches:
            logit = np.array([prior + sum(odds.get(t, 0.0) for t in ts) for ts in tokens], dtype=np.float64) + rest.to_numpy()
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -500, 500))))

    rows = rows.withColumn("score", F.pandas_udf("double")(score)(F.col("tokens"), F.col("rest")))
    return rows.withColumn("verdict", F.coalesce(truth, F.when(F.col("score") > 0.5, "block").otherwise("allow"))).select(
        "page_id", "host", "path", "rule", "verdict", "score", "tokens"
    )
