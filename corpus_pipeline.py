"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents, and all take empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.common import written
from cellweave.llm.mixing import mixed_documents
from cellweave.llm.ngram_join import one_of_each
from cellweave.llm.ordinal import keep_selected
from cellweave.llm.pieces import sentence_pieces
from cellweave.llm.quality_rules import keep_by_rules


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are judged by their size; without labels all stay."""
    return keep_selected(docs, _labels(spark, sf_dir))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts have no words and go; without labels only the base rule rejects."""
    return keep_by_rules(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of least doc_id; texts without words all stay."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets, to a whole document: a row for each copy that the mix takes, shard by shard. A null source
    is one of its own; texts without words are never taken."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, as digests of its ids and of what they decode to, with their number; a null text is an empty one."""
    return sentence_pieces(docs, remembered=150_000)  # the executors' memory is shared with four stages' leftovers


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", mix),
    ("sentence_pieces", encode),
]

#: SQL can express neither the fitted classifier nor MinHash nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
