"""Corpus pipeline: toxicity, language, near duplicates, mixing, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, mixing, ngram_join, queries, toxicity
from tidemark.llm.common import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the toxicity classifier rejects; it learns from the labels that are not held out."""
    index = queries.learned_toxicity(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(F.col("text"), index)
    return docs.withColumn("_found", found).where("_found.predicted = 0").select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language (no letter)."""
    found = langid.predicted(F.col("text"), queries.learned_languages(docs))
    return docs.withColumn("_found", found).where("_found.lang_pred <> 'und'").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate component: of the smallest id, of equal ids by the text's hash.

    Components are found and chosen by row and not by id, so a null or repeated id loses no text
    and keeps no copy. A row with an id is preferred to one without. Texts without a word link
    with nothing and all stay.
    """
    rows = Scratch(spark).store(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = ngram_join.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col("_row"))
    order = rows.select("_row", order.alias("_order"))
    keep = found.select(F.col("doc_id").alias("_row"), "component_id").join(order, "_row")
    keep = keep.groupBy("component_id").agg(F.min_by("_row", "_order").alias("_row")).select("_row")
    return rows.join(keep, "_row", "left_semi").select(*docs.columns)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents until 85 % of the expected words are of high quality, 15 % of low.

    No row is dropped: each carries its own rate, at least 1, whose fraction is settled by a hash
    of the id, or of the text where the id is null. Rows travel whole in one column, so no name
    of theirs can clash. Repeated rows have the same rate; no rows and no labels change nothing.
    """
    quality = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    labelled = table(spark, sf_dir, "labels").select("doc_id", quality.alias("domain"))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    rates = mixing.mixed(rows, labelled, {"high": 0.85, "low": 0.15}, keep_all=True, carried=["row"])
    times = mixing.copies(F.col("rate"), F.coalesce(F.col("row.doc_id"), F.xxhash64("row.text")))
    return rates.select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document, ids as little-endian unsigned 32-bit integers."""
    return bpe.encode_documents(docs, queries.vocabulary_path()).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic), ("language_id", known_language), ("ngram_jaccard_join", one_of_each_group),
    ("mixing_to_weights", mixed_to_weights), ("bpe_encoding", tokens),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on documents, each written as Parquet and read again by the next."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir))
    return docs
