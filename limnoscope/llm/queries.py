"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnoscope.llm import (
    chunk_dedup, conversation_repair, embedding_dedup, hard_negatives, jaccard_join, language_model, mixing, packing, pii,
    repetition, suffix_dedup, token_counts, toxicity,
)
from limnoscope.llm.common import fold, read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a model of nine tenths of them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = language_model.fit(docs.where(fold(F.col("doc_id"), 10) != 0).select(F.col("text").cast("string")))
    scored = language_model.score(docs, model, counts)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"),
                         "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition inside every document, and whether it is kept."""
    return (repetition.repetition_rules(read_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "n_covered", "longest_repeat"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0))
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score",
                                    (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of at most 4096."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=4096, closing=1)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for evener shares of languages and qualities; domains are those of the labelled documents."""
    docs = read_table(spark, sf_dir, "documents")
    domains = (read_table(spark, sf_dir, "labels").join(docs.select("doc_id", "lang"), "doc_id")
               .select("doc_id", F.concat_ws("/", "lang", "quality").alias("domain")))
    mix, rates = mixing.fit_mix(docs, domains)
    posteriors = F.array(*[F.col(f"p{i}") for i in range(len(mix.classifier.domains))])
    return rates.select("doc_id", "n_tokens", posteriors.alias("posteriors"), "rate",
                        F.array(*[F.lit(d) for d in mix.classifier.domains]).alias("domains"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets reach a Jaccard similarity of 0.9."""
    return (jaccard_join.jaccard_classes(read_table(spark, sf_dir, "documents"), size=3, percent=90)
            .select("doc_id", "n_shingles", "component_id"))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' repeated chunks, all but the first of each, and what is left of the texts."""
    return chunk_dedup.chunk_report(read_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents covered by a 400-byte string that starts elsewhere too, removed."""
    return suffix_dedup.removal_report(read_table(spark, sf_dir, "documents"), length=400).drop("spans")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of embeddings whose cosine is at least 0.9."""
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults of known kinds, chosen by a hash of conversation and turn; nulls are one space.

    Dropped turns stay as rows with ``present`` false, so that their conversation is not forgotten.
    """
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), code.alias("code"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    rows = damaged(read_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, present=F.col("present"))[0]


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding; every seventh one counts as of the next label."""
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: counts and digest of the base spans, and all spans."""
    found = pii.personal_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[c.alias(name) for name, c in pii.digest_columns().items()])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_language_model": op2_language_model,
    "op3_repetition": op3_repetition,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_chunk_dedup": op8_chunk_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_pii": op13_pii,
}

ORACLES: dict[str, str] = {
    "op7_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM shingles),
flat AS (SELECT doc_id, unnest(s) AS t FROM shingles),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM flat x JOIN flat y ON x.t = y.t AND x.doc_id < y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b
  WHERE 100 * k >= 90 * (m.n_shingles + n.n_shingles - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT sizes.doc_id, n_shingles, least(sizes.doc_id, (SELECT min(b) FROM reach WHERE a = sizes.doc_id)) AS component_id
FROM sizes""",
}
