"""The training-data operators against brute force, libraries or held-out labels, on small inputs."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, extraction, fingerprint, langid, metric_join, mixing, sharding, toxicity, urls
from tidemark.llm.queries import URL_RULES, vocabulary_path

DATA = os.environ.get("TESTDATA", "/root/testdata")
DOCS = "doc_id long, text string, extra int, score double"
ODD = [
    (1, None, 1, 0.0), (2, "", 1, 0.0), (3, " \n\t", 1, 0.0), (4, "one two three. Four!", 1, 0.0), (4, "one two three. Four!", 2, 0.0),
    (5, "é ß İ ΣΑΣ 日本", 1, 0.0), (6, "x" * 50_000, 1, 0.0), (7, "ab " * 20_000, 1, 0.0), (None, "no id", 1, 0.0), (8, "<|endoftext|> a <|startoftext|>", 1, 0.0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1. Shards

def test_shards_are_near_equal_gapless_and_keep_texts_together(spark):
    rng = random.Random(1)
    rows = [(i, "t%d " % (i % 900) * rng.randint(1, 40), 0, 0.0) for i in range(3000)] + [(5000 + i, "hot " * 30, 0, 0.0) for i in range(1500)]
    got = sharding.sharded(spark.createDataFrame(rows, DOCS), 6).toPandas().sort_values("doc_id").reset_index(drop=True)
    text = {d: t for d, t, *_ in rows}
    assert len(got) == len(rows)
    assert (got["size"] == [len(text[d].encode()) + 8 for d in got.doc_id]).all()
    assert (got.text_crc32 == [zlib.crc32(text[d].encode()) for d in got.doc_id]).all()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 6 and sums.max() < 1.02 * sums.mean() and sums.min() > 0.98 * sums.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    spread = got.assign(text=[text[d] for d in got.doc_id]).groupby("text").shard.nunique()
    assert set(spread[spread > 1].index) <= {"hot " * 30}  # larger than a shard's share


def test_shards_of_odd_rows(odd, empty):
    got = sharding.sharded(odd, 3).toPandas()
    assert len(got) == len(ODD) and got["size"].min() == 8 and set(got.law) == {"bytes"}
    assert sharding.sharded(empty, 3).count() == 0


# 2. Languages

@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="no test tables")
def test_language_held_out_accuracy(spark):
    from __spark_entry__ import queries

    d = f"{DATA}/sf0.01"
    got = queries()["op2_language_id"](spark, d).toPandas().set_index("doc_id")
    true = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    held = got[got.held_out]
    assert (held.lang_pred == true[held.index]).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_odd_rows(spark, odd, empty):
    model = langid.fit(spark.createDataFrame([("a", "aba bab abba"), ("b", "xyz zyx yxz"), (None, "q"), ("b", None)], "label string, text string"))
    got = {r["doc_id"]: r["f"] for r in odd.select("doc_id", langid.predicted(F.col("text"), model).alias("f")).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und"
    assert got[7]["lang_pred"] == "a" and got[6]["lang_pred"] in "ab"
    none = langid.fit(empty.select(F.lit("x").alias("label"), "text"))
    assert {r[0] for r in odd.select(langid.predicted(F.col("text"), none)["lang_pred"]).collect()} == {"und"}


def test_presence_covers_whole_texts_across_chunks(monkeypatch):
    text = "abcdefg hij" * 50
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert (langid.presence(text) == whole).all()


# 3. BPE

def test_bpe_equals_the_library(odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    for r in bpe.encode_documents(odd, vocabulary_path()).collect():
        want = [lib.encode(t or "", add_special_tokens=False).ids for d, t, *_ in ODD if d == r["doc_id"]]
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert ids in want and r["n_tokens"] == len(ids)
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)


def test_bpe_random_words_and_both_trees():
    from tokenizers import Tokenizer

    lib, encoder = Tokenizer.from_file(vocabulary_path()), bpe.Encoder(bpe.Vocabulary.read(vocabulary_path()))
    rng = random.Random(2)
    for length in (1, 2, 3, 17, 63, 64, 65, 200):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "!?.", "éü", "aé1!'s"):
            text = "".join(rng.choice(letters) for _ in range(length))
            assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text
    piece = b"international"
    assert encoder.alone(piece) == encoder.together([piece], 16)[0]


def test_bpe_empty_table(empty):
    assert bpe.encode_documents(empty, vocabulary_path()).count() == 0


# 4. Extraction

PAGE = (
    "<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>{0} menu</ul></nav><div class='cookie-notice'>Accept</div>"
    "<div id=content><h1>Head {0}</h1><p>First  <b>bold{0}</b> &amp; more<p>Second\n{0}<br>line<script>var a='<p>no</p>'</script><p>Follow us</div>"
    "<div class=\"comments\"><p>I agree {0}</p></div><form><input>Search {0}</form><footer>(c) {0}</footer></body>"
)


def test_wrapper_takes_varying_slots(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(f"v{i}")) for i in range(6)]
    rows += [(10, "http://h.example/x", None), (11, None, ""), (12, "nohost", "<p>alone &lt;b&gt;"), (13, "http://o.example/", "plain text"), (0, "http://h.example/0", PAGE.format("v0"))]
    got = {r["page_id"]: r["text"] for r in extraction.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Head v{i}\nFirst boldv{i} & more\nSecond v{i} line"
    assert got[10] == "" and got[11] == "" and got[12] == "alone <b>" and got[13] == "plain text"
    assert extraction.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_matching_is_the_largest_ordered_match():
    leaf = lambda x: (x, (), None)
    a = ("r", (leaf("a"), ("b", (leaf("c"), leaf("d")), None), leaf("e")), None)
    b = ("r", (("b", (leaf("d"),), None), leaf("a"), leaf("e")), None)
    assert extraction.matching(a, b) == (4, [(1, 0), (2, 2)])


def test_an_article_after_many_blocks_is_found():
    page = "<body><div>" + "".join(f"<div><a>link {i}</a></div>" for i in range(900)) + "<article><p>Head {0}<p>" + "text {0} " * 50 + "</article></div>"
    for wrapper in (None, extraction.learned([page.format(k) for k in "abcd"])):
        assert extraction.extracted(page.format("z"), wrapper) == "Head z\n" + " ".join(["text z"] * 50)


def test_long_lists_match_as_short_ones(monkeypatch):
    rng = random.Random(7)
    tree = lambda depth: (rng.choice("ab"), tuple(tree(depth - 1) for _ in range(rng.randint(0, 6))) if depth else (), None)
    for _ in range(60):
        a, b = (("r", tuple(tree(2) for _ in range(rng.randint(0, 25))), None) for _ in range(2))
        monkeypatch.setattr(extraction, "CELLS", 160_000)
        size = extraction.matching(a, b)[0]
        whole = {(i, j): extraction.matching(x, y)[0] for i, x in enumerate(a[1]) for j, y in enumerate(b[1])}
        monkeypatch.setattr(extraction, "CELLS", 12)
        got, pairs = extraction.matching(a, b)
        assert got == size == 1 + sum(whole[p] for p in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_deep_and_broken_pages():
    assert extraction.extracted("<div>" * 3000 + "deep" + "</div>" * 10, None) == "deep"
    assert extraction.extracted("a < b <p>c</q></div>d<!-- x", None) == "a < b\nc d".replace("c d", "cd")


# 5. Fingerprints

def test_peeling_recovers_any_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 20, 300, 5000):
        shared, a, b = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (500, n, n // 2))
        mine, theirs = fingerprint.difference(np.concatenate([shared, a]), np.concatenate([shared, b]))
        assert sorted(mine) == sorted(a.tolist()) and sorted(theirs) == sorted(b.tolist())


def test_versions_against_plain_python(spark, odd, empty):
    texts = [(i, " ".join(f"w{(i * 7 + j) % 97}." for j in range(i % 60))) for i in range(200)]
    got = fingerprint.versions(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).toPandas().sort_values("doc_id")
    assert len(got) == 200
    for (i, t), r in zip(texts, got.itertuples(), strict=True):
        following = texts[(i + 1) % 200][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert r.edited == edited
        for other, near in ((edited, r.near_edited), (following, r.near_next)):
            a, b = (set(fingerprint.digests(x).tolist()) for x in (t, other))
            assert near == (len(a & b) / len(a | b) if a | b else 1.0)
    n, sketch = fingerprint.Sketch.read(got.fingerprint.iloc[50])
    assert n == len(fingerprint.digests(texts[50][1])) and sketch.text(n) == got.fingerprint.iloc[50]
    assert fingerprint.versions(odd).count() == len(ODD)
    assert fingerprint.versions(empty).count() == 0


def test_ranges_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 500)
    texts = [(i * 3, f"text {i}") for i in range(300)]
    got = fingerprint.versions(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: hashlib.sha256(r["edited"].encode()).hexdigest() for r in got} == {
        d: hashlib.sha256(fingerprint.edited(t, texts[(i + 1) % 300][1]).encode()).hexdigest() for i, (d, t) in enumerate(texts)
    }


# 6. Mixing

def test_rates_meet_targets_and_bounds(spark):
    words = {"x": "good fine nice", "y": "bad poor ugly", "z": "red blue green"}
    rows = [(i, " ".join(words[k].split()[(i + j) % 3] for j in range(20 + i % 30))) for i, k in enumerate("xyz" * 60)]
    labelled = [(i, k) for i, k in enumerate("xyz" * 20)] + [(None, "x"), (3, None)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    table = spark.createDataFrame(labelled, "doc_id long, domain string")
    got = mixing.mixed(docs, table, {"x": 0.5, "y": 0.3, "z": 0.2}).toPandas().set_index("doc_id")
    assert len(got) == 182 and (got.rate >= 0).all() and got.n_words[900] == 0
    assert [got.domain[i] for i in range(180)] == list("xyz" * 60)
    total = got.n_words.sum()
    for k, share in {"x": 0.5, "y": 0.3, "z": 0.2}.items():
        assert abs((got.rate * got.n_words * got.posterior.map(lambda p, k=k: p[k])).sum() - share * total) < 1e-3 * total
    kept = mixing.mixed(docs, table, {"x": 0.5, "y": 0.3, "z": 0.2}, keep_all=True).toPandas()
    assert (kept.rate >= 1).all()


def test_softmax_finds_calibrated_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3)) * [1.0, 50.0, 0.01]
    logit = np.column_stack((np.zeros(4000), 1.0 + 2.0 * x[:, 0] - 0.04 * x[:, 1], -1.0 + 100.0 * x[:, 2]))
    true = np.exp(logit) / np.exp(logit).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=p) for p in true])
    w = mixing.softmax_fit(x, y, 3, np.ones(4000))
    p = np.exp(w[:, 0] + x @ w[:, 1:].T)
    p /= p.sum(axis=1, keepdims=True)
    assert np.abs(p - true).mean() < 0.03 and np.abs(p.mean(axis=0) - np.bincount(y) / 4000).max() < 0.01
    assert np.allclose(np.exp(mixing.softmax_fit(x[:2], y[:2], 3, np.ones(2))[:, 0]).sum(), 1)


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="no test tables")
def test_mixing_meets_its_targets_with_honest_posteriors(spark):
    from tidemark.llm.queries import domain

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").select("doc_id", domain().alias("domain"))
    away = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0  # never shown to the classifier
    weights = {"high": 0.8, "low": 0.15, "toxic": 0.05}
    got = mixing.mixed(docs, labels.where(~away), weights).toPandas().set_index("doc_id")
    words = got.n_words * got.rate
    for k, share in weights.items():
        assert abs((words * [dict(p)[k] for p in got.posterior]).sum() / words.sum() - share) < 0.01
    assert got.rate.max() < 10
    held = labels.where(away).toPandas().set_index("doc_id").domain
    sure = np.array([dict(got.posterior[i])[k] for i, k in held.items()])
    prior = held.value_counts(normalize=True)
    assert -np.log(sure).mean() < -(prior * np.log(prior)).sum()
    low = held[held == "low"].index
    assert (got.domain[low] == "low").mean() > 0.5


def test_mixing_without_labels_or_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {r["rate"] for r in mixing.mixed(odd, none, {"x": 1.0}).collect()} == {1.0}
    some = spark.createDataFrame([(4, "x"), (7, "y")], "doc_id long, domain string")
    assert mixing.mixed(odd, some, {"x": 1.0}).count() == len(ODD)
    assert mixing.mixed(empty, some, {"x": 1.0}).count() == 0


# 7. Metric join

def test_range_join_matches_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "PER_PIVOT", 40)
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1):
        centres = rng.normal(size=(12, 8))
        for i in range(200):
            v = centres[i % 12] + rng.normal(size=8) * 0.12
            rows.append((label * 1000 + i, [float(x) for x in v * rng.uniform(0.5, 2)], label))
    rows += [(2000 + i, rows[0][1], 0) for i in range(30)]  # copies
    rows += [(3000, None, 0), (3001, [0.0] * 8, 0), (3002, [float("nan")] * 8, 0), (3003, rows[0][1], None), (3004, [float("inf")] + [1.0] * 7, 0), (3005, [], 0), (3006, [1.0], 0), (3007, [1.0, None], 0)]
    got = {r["vec_id"]: r for r in metric_join.range_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    usable = [(i, np.array(v, dtype=np.float32).astype(float), k) for i, v, k in rows if k is not None and v and len(v) == 8 and np.isfinite(v).all() and any(v)]
    ids = np.array([i for i, *_ in usable])
    x = np.stack([v / np.linalg.norm(v) for _, v, _ in usable])
    near = (x @ x.T >= 0.98) & np.equal.outer([k for *_, k in usable], [k for *_, k in usable])
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        low = np.minimum(np.where(near, label[None, :], 10**9).min(axis=1), label)
        if (low == label).all():
            break
        label = low
    for i, n, c in zip(ids, near.sum(axis=1), label, strict=True):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, c, c == i)
    for i in range(3000, 3008):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_range_join_of_no_rows(spark):
    assert metric_join.range_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# 8. URLs

def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "http://A.Example.COM/en/x?y#z"), (2, "https://www.example.com/en/1"), (3, "x://m.www.example.com/en/"), (4, "http://example.com"),
        (5, "ftp://a.net/fr/://b"), (6, "nothing"), (7, None), (8, "http://a.net/frx/"), (9, "http://a.com?x=/"), (10, "http://notexample.com/en/1"), (10, "http://notexample.com/en/1"),
    ]
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame([(i, u, "word text") for i, u in rows], "page_id long, url string, html string"), URL_RULES).collect()}
    want = {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        3: ("m.www.example.com", "/en/", "www.example.com/en/", "allow"), 4: ("example.com", "", None, None), 5: ("a.net", "/fr/://b", "net/fr/", "block"),
        6: ("", "", None, None), 7: ("", "", None, None), 8: ("a.net", "/frx/", None, None), 9: ("a.com", "", None, None), 10: ("notexample.com", "/en/1", "com/", "allow"),
    }
    for i, (host, path, rule, verdict) in want.items():
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urls.judged(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0


def test_rare_words_and_tokens_count_as_common_ones(spark, monkeypatch):
    html = "news news news shop shop telecommunications garden flower flower river"
    names = ["telecommunicationsnews", "flowershop", "gardenriver", "rivernews", "shop1garden"]
    rows = [(i, f"http://{n}.com/{w}/x{i % 3}", html) for i, (n, w) in enumerate((n, w) for n in names for w in ("sale", "sport", "art"))]
    rows += [(50 + i, f"http://{n}.net/fr/{w}/{w}", html) for i, (n, w) in enumerate((n, w) for n in names for w in ("casino", "win", "sale"))]
    rows += [(90, "http://flowershop.org/casino", html), (91, "http://telecommunicationsnews.org/art/win", html), (90, "http://flowershop.org/casino", html), (92, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = lambda: sorted((r["page_id"], round(r["score"], 9), r["verdict"], r["tokens"]) for r in urls.judged(pages, URL_RULES).collect())
    whole = found()
    assert next(t for i, *_, t in whole if i == 91)[:2] == ["h:telecommunications", "h:news"]
    monkeypatch.setattr(urls, "WORDS", 2)
    monkeypatch.setattr(urls, "TOKENS", 3)
    assert len(whole) == len(rows) and found() == whole


def test_segmentation_is_the_cheapest_split():
    import itertools

    cost = {"a": 3.0, "ab": 3.5, "b": 2.0, "abc": 9.0, "c": 1.0, "bc": 2.5}
    for name in map("".join, itertools.product("abc", repeat=5)):
        splits = []
        for cuts in itertools.product([0, 1], repeat=4):
            words, start = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    words.append(name[start:i])
                    start = i
            if all(w in cost for w in words):
                splits.append(sum(cost[w] for w in words))
        assert abs(sum(cost[w] for w in urls.segmented(name, cost)) - min(splits)) < 1e-9
    assert urls.segmented("ab12q", cost) == ["ab", "12", "q"]


# 9. Toxicity

@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.1"), reason="no test tables")
def test_toxicity_held_out(spark):
    from __spark_entry__ import queries

    d = f"{DATA}/sf0.1"
    got = queries()["op9_toxicity"](spark, d).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id").toxic
    both = got[got.held_out].join(labels, how="inner")
    assert both[both.toxic == 1].predicted.mean() > 0.75
    assert both[both.toxic == 0].predicted.mean() < 0.02


def toxic_index(spark):
    rows = [(i, f"{'vile rude ' * (i % 2)}plain word{i % 5} day{i % 7}") for i in range(400)]
    labels = [(i, i % 2) for i in range(400)] + [(None, 1), (2, None)]
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")), rows


def test_a_hot_null_text_is_spread_over_shards(spark):
    rows = [(i, None if i % 3 == 0 else f"long text number {i} " * 40, 0, 0.0) for i in range(3000)]
    got = sharding.sharded(spark.createDataFrame(rows, DOCS), 6).toPandas()
    assert sorted(got.doc_id) == list(range(3000))
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    hot = got[got.doc_id % 3 == 0].groupby("shard").size()
    assert len(hot) > 1 and hot.max() < 900
    size = got.groupby("shard")["size"].sum()
    assert size.max() < 1.05 * size.mean()


def test_nearest_examples_are_exact(spark, odd):
    index, rows = toxic_index(spark)
    texts = dict(rows)
    examples = [dict(zip(*map(list, index.vector(texts[i])), strict=True)) for i in index.ids]
    assert len({index.label[k] for k in range(len(examples))}) == 2
    for _, text in [*rows[:40], (0, "rude and vile"), (0, "vile")]:
        term, weight = index.vector(text)
        score = [sum(w * e.get(t, 0.0) for t, w in zip(term, weight, strict=True)) for e in examples]
        best = sorted((s for s in score if s > 0), reverse=True)[: toxicity.NEAREST]
        assert np.allclose([s for s, _ in index.nearest(term, weight)], best)
    got = odd.select("doc_id", toxicity.scored(F.col("text"), index).alias("f")).collect()
    assert len(got) == len(ODD) and all(0 <= r["f"]["score"] <= 1 for r in got)
    assert index.probability(index.raw(index.vector("vile rude person"))[0]) > 0.5 > index.probability(index.raw(index.vector("plain day1"))[0])


def test_toxicity_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    index = toxicity.fit(odd, none)
    assert {r[0] for r in odd.select(toxicity.scored(F.col("text"), index)["predicted"]).collect()} == {0}
    assert empty.select(toxicity.scored(F.col("text"), index)["score"]).count() == 0
    one = spark.createDataFrame([(4, 1), (7, 1)], "doc_id long, toxic int")
    assert odd.select(toxicity.scored(F.col("text"), toxicity.fit(odd, one))).count() == len(ODD)


def test_few_labels_teach_and_no_term_is_left_out(spark):
    rows = [(i, "vile rude awful" if i % 2 else "kind plain good") for i in range(14)]
    rows = [(i, f"{t} {w}") for (i, t), w in zip(rows, "abcdefghijklmn", strict=True)]
    docs = spark.createDataFrame([*rows, (20, "so vile"), (21, "so kind"), (22, "unheard"), (23, None)], "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert set(index.terms.place) == {f for _, t in rows for w in t.split() for f in toxicity.terms_of(w)}
    got = {r[0]: r[1] for r in docs.select("doc_id", toxicity.scored(F.col("text"), index)["predicted"]).collect()}
    assert got == {i: i % 2 for i in range(14)} | {20: 1, 21: 0, 22: 0, 23: 0}
    held = toxicity.document_counts(docs, index.terms)
    assert held[index.terms.place["vile"]] == 8 and held[index.terms.place["a"]] == 1


def test_texts_scored_together_are_scored_as_if_alone(spark, monkeypatch):
    index, rows = toxic_index(spark)
    assert "place" not in vars(index.terms)  # the driver holds the terms as one buffer, not as a dictionary
    texts = [t for _, t in rows[:30]] + ["", "unheard", "vile " * 50 + "word1", "rude and vile day3", "Plain WORD2"]
    monkeypatch.setattr(toxicity, "COMMON", 4)  # so that matrices and lists both take part
    monkeypatch.setattr(toxicity, "PORTION", 8)
    for name in ("common", "dense", "postings"):
        vars(index).pop(name, None)
    assert [len(p) for p in toxicity.portions(texts)] == [8, 8, 8, 8, 3]
    together = [row for part in toxicity.portions(texts) for row in index.judged(part).to_pylist()]
    assert together == [index.judged([t]).to_pylist()[0] for t in texts]
    assert together[31]["evidence"] == [] and together[30]["predicted"] == 0
    examples = [dict(zip(*map(list, index.vector(dict(rows)[i])), strict=True)) for i in index.ids]
    for text, got in zip(texts, together, strict=True):
        term, weight = index.vector(text)
        score = [sum(w * e.get(t, 0.0) for t, w in zip(term, weight, strict=True)) for e in examples]
        best = sorted((s for s in score if s > 0), reverse=True)[: toxicity.NEAREST]
        assert np.allclose([e["cosine"] for e in got["evidence"]], best)


def test_fitting_languages_holds_no_presence_rows_of_the_whole_sample(spark):
    """3,000 texts by 8,192 places as numbers would be 98 MB of the driver's memory."""
    import tracemalloc

    draw = random.Random(4)
    texts = [(lang, " ".join("".join(draw.choices(letters, k=5)) for _ in range(20))) for lang, letters in (("a", "abcde"), ("b", "eghij"), ("c", "acxyz")) for _ in range(1000)]
    labelled = spark.createDataFrame(texts, "label string, text string")
    tracemalloc.start()
    try:
        model = langid.fit(labelled)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.languages == ["a", "b", "c"]
    assert most < 60e6
