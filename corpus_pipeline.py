"""Corpus pipeline: documents to packed training sequences, one stage after the other, each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

* quality: documents whose calibrated score is under the threshold go.
* near_dedup: of each component of near-duplicates the document with the least doc_id stays.
* passages: bytes of passages that an earlier document has too go from the text; no document goes.
* mixing: all rows, stored in the order of the mixture of sources.
* packing: windows of the stored order are packed into sequences; one row for each piece of a document.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import mixing, near_dedup, packing, passages, quality
from lanewise.llm.common import durable, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.cut_texts(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("quality", good), ("near_dedup", distinct), ("passages", cut), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None      # classifier, suffix sorting and packing have no SQL twin; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
