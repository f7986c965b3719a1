"""The corpus pipeline: quality, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that the next one works on; the last gives the pieces of
the packed sequences. SQL cannot express the stages; tests/llm/test_pipeline.py holds each against a brute-force version.

Defined cases, in every stage: a null id or text stays null (a null text has no words, so the quality stage rejects it); an
empty table gives one; rows that repeat id and text count as copies, of which one stays; columns beside doc_id and text
come back as they were, whatever their names, but for n_chars, which follows the text where it changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import packing, quality_rules, secrets, shingle_join, substring_dedup
from proofline.llm._common import documents, materialise, table, with_own_columns

ORACLE_SQL = None
WORDS = 51
CACHED_WORDS = 80_000  # workers of earlier stages still hold memory


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return with_own_columns(docs, lambda d: quality_rules.score(d, model).where("kept"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return shingle_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of 400 bytes or more, or of more than 50 words of an earlier document."""
    return _counted(substring_dedup.dedup(docs, words=WORDS), docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return _counted(secrets.mask(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    return packing.pack(docs, "word_bpe_49k.json", cached=CACHED_WORDS).drop("ids")


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return changed
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


STAGES = [("quality_rules", quality_stage), ("shingle_join", near_duplicate_stage), ("substring_dedup", substring_stage), ("secrets", secret_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
