"""A corpus from raw documents to packed sequences, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, packing, quality, shared, simhash


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the quality classifier rejects go."""
    return quality.keep_good(docs, shared.table(spark, sf_dir, "labels"))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts the longest stays, then the smallest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near copies the smallest doc_id stays."""
    return simhash.drop_near_copies(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of all documents, each with its sequence and offset."""
    return packing.pack_documents(docs, shared.TOKENIZER)


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", without_exact_copies),
    ("simhash_near_dedup", without_near_copies),
    ("best_fit_packing", packed_sequences),
]

#: SQL can express neither the trained classifier nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the shared checkpoint folder, each until the next is written."""
    docs, before = shared.table(spark, sf_dir, "documents"), None
    folder = f"{shared.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            shared.remove(spark, before)
        before = path
    return docs
