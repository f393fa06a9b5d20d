"""A training-data pipeline over ``documents``: five stages, each one operator, each working on what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``n_chars`` follows the text. No SQL expresses all stages, so ORACLE_SQL is None and a test runs a plain version.

Defined results: a null text fails the quality rules, so no later stage sees one from ``run``; a stage given one
alone follows its operator. Rows equal in id and text are one document to line dedup and decontamination, and only one
of them stays at near-dedup. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespine.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from pagespine.llm._common import BATCH_ROWS, materialise, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior, or the base rule, rejects go."""
    return quality_rules.judge(docs).filter("q_kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an equal or nearly equal earlier line makes redundant go from the texts."""
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar five-word shingles (Jaccard 0.8 or more) stays, that with the smallest id."""
    return simhash.keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also a re-parameterised one, go."""
    flagged = decontaminate.flag(docs, table(spark, sf_dir, "benchmark"), items_out="__found", tokens_out="__tokens")
    return flagged.filter("size(__found) = 0").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays as byte-level BPE ids, with digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    shared = bpe.tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    done = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), shared)
    done = done.select("doc_id", "lang", "source", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")
    return materialise(done, "stage-byte_level_bpe", BATCH_ROWS)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
