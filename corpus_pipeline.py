"""The training-data pipeline: from documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet and reads it again.
All stages but the last return the columns of documents.

1. quality_rules: documents that the rules or the likelihood ratio reject go.
2. line_dedup: later copies of repeated line runs are cut out; a document of which no word is left goes. ``n_chars``
   follows the text.
3. ngram_join: of each group of similar documents the one of the smallest doc_id stays. Similar are documents whose sets
   of five words have a Jaccard index of 0.8 or more; the query of op1 has three words and 0.9.
4. decontaminate: documents that hold benchmark windows go.
5. bpe: token ids of what is left.

Stages judge rows, not ids: of rows that share a doc_id, or have none, each goes or stays by its own text; equal rows of
one doc_id become one in stage 3, and rows without a doc_id are near copies of nothing. Null and empty texts fail the
rules of stage 1. Other columns stay, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from tidemark.llm.common import table, written

#: Words of a shingle and least Jaccard index of near copies.
NEAR_SHINGLE, NEAR = 5, (80, 100)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs)
    touched = F.size("runs") > 0
    cut = cut.where(~touched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        length = F.when(touched, F.length("text")).otherwise(F.col("row.n_chars"))
        new["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, NEAR, NEAR_SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian 32-bit integers)."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", dedup_lines),
    ("ngram_join", keep_one_of_similar),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: SQL has neither the hashed likelihood ratio nor the tokenizer; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
