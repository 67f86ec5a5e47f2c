"""From documents to packed training sequences: five stages, each one operator over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``; all but the last return the
columns of ``documents``. A table without rows passes through all stages.
"""

from __future__ import annotations

import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnoscope.llm import jaccard_join, mixing, packing, suffix_dedup, toxicity
from limnoscope.llm.common import free_names, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learned from the labels, is below one half."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    score, = free_names(docs, "_score")
    return model.score(docs, score_col=score).where(F.col(score) < 0.5).drop(score)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles reach a Jaccard similarity of 0.8."""
    return jaccard_join.keep_one(docs, size=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 240 bytes (about 40 words) that begin elsewhere too; every document stays."""
    cleaned = suffix_dedup.remove_repeats(docs, length=240)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                                     .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cleaned


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated towards evener shares of quality domains; no document is left out, none comes more than four times."""
    domains = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("domain"))
    mix, _ = mixing.fit_mix(docs, domains, budget=1.25, least=1.0, most=4.0)
    return mix.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: The stages learn models and pack by a plan; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stages are kept in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pipeline-")
    folder = f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
