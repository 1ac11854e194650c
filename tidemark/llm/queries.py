"""Registered queries of the training-data operators: thin readers around each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, conversation, divergence, extraction, fingerprint, langid, metric_join, mixing, ngram_join, sharding, suffix_dedup, toxicity, urls
from tidemark.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_sampled_splitters")
def op1(spark: SparkSession, d: str) -> DataFrame:
    """Every document in one of 24 shards of near-equal bytes."""
    return sharding.sharded(table(spark, d, "documents"), 24)


@query("op4_wrapper_induction")
def op4(spark: SparkSession, d: str) -> DataFrame:
    """Main text of every page."""
    return extraction.main_texts(table(spark, d, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op5_invertible_sketch")
def op5(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likenesses."""
    found = fingerprint.versions(table(spark, d, "documents"))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


@query("op7_metric_range_join")
def op7(spark: SparkSession, d: str) -> DataFrame:
    """Links and components of embeddings with cosine 0.98 or more within a label."""
    return metric_join.range_components(table(spark, d, "embeddings"))


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, d: str) -> DataFrame:
    """Components of documents whose word 5-gram sets have Jaccard 0.8 or more."""
    return ngram_join.jaccard_components(table(spark, d, "documents"))


def learned_languages(docs: DataFrame) -> langid.LanguageModel:
    """Fitted on the documents that are not held out."""
    return langid.fit(docs.where(~held_out()).select(F.col("lang").alias("label"), "text"))


@query("op2_language_id")
def op2(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, d, "documents")
    found = docs.select("doc_id", held_out().alias("held_out"), langid.predicted(F.col("text"), learned_languages(docs)).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_bpe_tokens")
def op3(spark: SparkSession, d: str) -> DataFrame:
    """Token counts and digests of every document's ids and of their decoded text."""
    found = bpe.encode_documents(table(spark, d, "documents"), vocabulary_path())
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256")
    )


def domain():
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


@query("op6_soft_mixing")
def op6(spark: SparkSession, d: str) -> DataFrame:
    """Rates at which documents come to 80 % high, 15 % low and 5 % toxic words."""
    labelled = table(spark, d, "labels").select("doc_id", domain().alias("domain"))
    return mixing.mixed(table(spark, d, "documents"), labelled, {"high": 0.80, "low": 0.15, "toxic": 0.05})


def learned_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Index:
    """Fitted on the labels that are not held out."""
    return toxicity.fit(docs, labels.where(~held_out()))


URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


@query("op8_host_segmentation")
def op8(spark: SparkSession, d: str) -> DataFrame:
    """Every page's url under fixed rules, and by the classifier where none fits."""
    return urls.judged(table(spark, d, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op9_toxicity")
def op9(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every document, learned from labels that are not held out."""
    docs = table(spark, d, "documents")
    index = learned_toxicity(docs, table(spark, d, "labels"))
    found = docs.select("doc_id", held_out().alias("held_out"), toxicity.scored(F.col("text"), index).alias("found"))
    return found.select("doc_id", "held_out", "found.score", "found.predicted", "found.evidence")


@query("op11_conversation_repair")
def op11(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation, damaged by a fixed draw, with its faults and its cheapest repair."""
    return conversation.summaries(conversation.repaired(conversation.damaged(table(spark, d, "conversations"))))


@query("op12_suffix_dedup")
def op12(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the 50-byte strings that a smaller doc_id has."""
    found = suffix_dedup.without_repeats(table(spark, d, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op13_source_divergence", r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), words AS (
    SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
    SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), grp AS (
    SELECT DISTINCT lang, source FROM d
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
    SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source
), share AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * s.v) AS p
    FROM grp g JOIN kept k USING (lang) JOIN sizes s USING (lang)
    LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), lang_share AS (
    SELECT x.lang, x.term, 1 + (1000000000::HUGEINT * (x.n + 5)) // (t.total + 5 * s.v) AS q
    FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term) x
    JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) t USING (lang) JOIN sizes s USING (lang)
), distance AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN distance x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT s.lang, s.source, 'term', s.term, (s.p - l.q)::BIGINT FROM share s JOIN lang_share l USING (lang, term) WHERE s.n > 0 AND s.p > l.q
), ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
""")
def op13(spark: SparkSession, d: str) -> DataFrame:
    """Divergence of every source from the others of its language and its most typical terms."""
    return divergence.divergences(table(spark, d, "documents"))
