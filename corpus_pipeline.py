"""Training-data pipeline over `documents`: five stages, each one corpus operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. Only the columns of `documents` are
carried; further columns are ignored. Null texts count as empty in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, decontaminate, neardup, quality, secrets
from tagloom.llm.common import Scratch, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "word_bpe_49k.json"


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    docs = docs.select(*COLUMNS)
    field = quality.fit_on(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, field, keep=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return neardup.deduplicate(docs.select(*COLUMNS))


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark unless the value is a widely copied example."""
    docs = docs.select(*COLUMNS)
    found = secrets.scan(docs, repo=F.concat(docs["source"], F.lit("/"), docs["lang"]), keep=["lang", "source", "n_chars"], redacted=True)
    count = F.when(F.size("live") > 0, F.char_length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", count.alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, by document."""
    return bpe.encode_decode(docs.select(*COLUMNS), public_tokenizers.path(VOCABULARY), keep=["lang", "source"])


STAGES = [("quality_classifier", filter_quality), ("minhash_near_dedup", drop_near_copies), ("benchmark_decontamination", drop_test_items), ("secret_scans", redact_secrets), ("bpe_encoding", encode)]

#: The trained classifier and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
