"""Corpus cleaning pipeline: each stage works on all that its predecessor kept.

Stages take ``(spark, docs, sf_dir)`` and, but for the last, return the columns
of ``documents``.  Between stages the rows are written as Parquet and read
again.  Null texts and ids, repeated rows and empty tables are handled as the
operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm import decontaminate, line_dedup, packing, part_enum, toxicity
from attrition.llm.common import staged

#: What near copies share in the stage (op7 has its own).
NEAR_PERCENT, NEAR_WORDS = 80, 5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go but for their first place; so do documents of which nothing else is left.

    ``n_chars`` follows the text of a document that lost lines.
    """
    clean = line_dedup.drop_boilerplate(docs)
    clean = clean.filter((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: ``NEAR_PERCENT`` of the shingles of ``NEAR_WORDS`` words are shared."""
    return part_enum.keep_representatives(docs, percent=NEAR_PERCENT, k=NEAR_WORDS)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest in pieces of power-of-two lengths."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_test_items),
    ("packing", packed),
]

#: Models, MinHash and a tokenizer have no SQL form; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
