"""The pipeline's stages on the smallest tables, each against its operator or brute force."""

import os

import numpy as np
import pytest
from test_ngram_join import brute

import corpus_pipeline as P
from tidemark.llm.common import Scratch, table
from tidemark.llm.queries import vocabulary_path

D = f"{os.environ.get('TESTDATA', '/root/testdata')}/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_stages_keep_what_they_should(spark):
    from tokenizers import Tokenizer

    scratch, docs, kept = Scratch(spark), table(spark, D, "documents"), []
    for _, stage in P.STAGES:
        kept.append(docs)
        docs = scratch.store(stage(spark, docs, D))
    first, clean, known, single, mixed = kept
    assert [n for n, _ in P.STAGES] == ["toxicity", "language_id", "ngram_jaccard_join", "mixing_to_weights", "bpe_encoding"]
    assert all(x.columns == first.columns for x in (clean, known, single, mixed))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, D, "labels").collect()}
    gone = set(ids(first)) - set(ids(clean))
    assert sum(labels.get(i, 1) for i in gone) >= 0.7 * len(gone)
    assert sum(1 for i in ids(clean) if labels.get(i) == 0) >= 0.97 * sum(1 for i in ids(first) if labels.get(i) == 0)
    assert ids(known) == [r["doc_id"] for r in clean.orderBy("doc_id").collect() if any(c.isalpha() for c in r["text"] or "")]
    want = brute([(r["doc_id"], r["text"]) for r in known.orderBy("doc_id").collect()])
    assert ids(single) == [d for d, _, c in want if d == c]
    assert set(ids(mixed)) == set(ids(single))  # repeated at most, never dropped
    lib = Tokenizer.from_file(vocabulary_path())
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    out = docs.collect()
    assert sorted(r["doc_id"] for r in out) == ids(mixed)
    for r in out[:40]:
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids_lose_no_text_and_keep_no_copy(spark, tmp_path):
    word = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [
        (None, word("a")), (None, word("a")), (None, word("b")), (1, word("c")), (1, word("c")), (None, word("c")),
        (2, word("d")), (2, word("e")), (3, word("e")), (3, word("f")), (4, word("d")), (4, word("g")),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    single = Scratch(spark).store(P.one_of_each_group(spark, docs, str(tmp_path)))
    first = lambda df: sorted(((r["doc_id"], r["text"].split()[0]) for r in df.collect()), key=str)
    want = sorted([(None, "a0"), (None, "b0"), (1, "c0"), (2, "d0"), (2, "e0"), (3, "f0"), (4, "g0")], key=str)
    assert single.columns == docs.columns and first(single) == want
    mixed = P.mixed_to_weights(spark, single, str(tmp_path))
    assert mixed.columns == docs.columns and sorted(set(first(mixed)), key=str) == want


def test_columns_named_like_the_stages_own(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} and some more text {i}", 0.5, 1, "r", 2.0) for i in range(20)], "doc_id long, text string, rate double, n_words int, row string, p_0 double")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 20, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mixed = P.mixed_to_weights(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == set(range(20)) and mixed.first().rate == 0.5
