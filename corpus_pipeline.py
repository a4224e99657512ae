"""A corpus pipeline over `documents`: quality, near copies, test leaks, personal data, packing.

Each stage works on all that its predecessor kept. It is written as Parquet and read again as the
next one's documents; all stages but the last return the columns of documents, further ones included.

A null text counts as empty: it is judged as an empty one, equals other empty texts, copies nothing, stays null
when personal data is replaced, and is packed as its end token. Rows without doc_id stay, as they can't be named
as anyone's copy; rows that repeat a doc_id stand or fall together as copies and are otherwise judged one by one.
Empty documents give empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.llm import decontaminate, nbsvm, packing, pii, simhash
from revspark.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go. It learns as op7 does, without every fifth label."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = nbsvm.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return model.score(docs, *docs.columns, name="_quality_stage_score").where("_quality_stage_score >= 0.3").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of every group of near copies stays: similarity 0.8 over shingles of five words."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that copies a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes <kind>; n_chars follows the text. Every document stays."""
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 1024 tokens, as op5 returns them."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality", quality),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL can't express the classifier, the alignment or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
