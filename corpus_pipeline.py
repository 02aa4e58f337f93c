"""A training corpus from raw documents: five stages, one operator each.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written and read again as the next one's ``docs``; what it was made of is then
deleted. All but the last return the
columns of documents; where a stage changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.llm import decontaminate, langid, packing, pii, simhash
from factflow.llm.common import bound_batches, discard, scratch, settle, table


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or of no language that was learned, go."""
    bound_batches(spark)
    return langid.keep_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    bound_batches(spark)
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of benchmark words or more go; from others the
    benchmark's passages are cut."""
    bound_batches(spark)
    return _recounted(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    bound_batches(spark)
    return _recounted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences."""
    bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: No stage but the packing's bookkeeping can be told in SQL; tests/llm holds
#: the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch() as left:
            before, docs = docs, settle(stage(spark, docs, sf_dir))
            left.append(docs)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
