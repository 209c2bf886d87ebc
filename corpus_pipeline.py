"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, BPE.

Each stage is a function (spark, docs, sf_dir) -> DataFrame.  All but the last keep
the columns of documents; the result of each is written as Parquet and read again as
the next one's docs.

Null and empty texts pass toxicity with the score of no features, hold no line, share
one fingerprint (so one of them stays), hold no benchmark item and encode to no ids.
Rows that repeat a doc_id count as copies of each other; rows with a null doc_id stay.
Further columns are carried along, whatever their names; an empty table gives an empty
one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, decontaminate, line_dedup, near_copies, simhash, toxicity
from plumbline.llm.common import removed, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    return line_dedup.dedup_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links and of near copies by five-word shingles."""
    return simhash.keep_one_of_each(docs, more=near_copies.near_links(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return bpe.encode_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A classifier, fingerprints of XXH64 and BPE are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage has read goes once its own result is written; the last result stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
