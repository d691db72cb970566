"""The registered queries opN_<name>: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .mixing import mixed_sizes
from .ngram_join import ngram_join
from .ordinal import quality_classifier
from .pieces import sentence_pieces
from .quality_rules import quality_rules
from .token_counts import token_counts
from .token_files import token_files
from .topk import top_k
from .url_filter import url_filter
from .warc import warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_read(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(_read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_read(spark, sf_dir, "pages")).drop("trust", "distrust")


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces(_read(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc(_read(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_files, op3_source_mixing, op4_url_filter, op5_sentence_pieces, op6_ngram_join, op7_quality_classifier, op8_warc, op9_top_k, op10_token_counts)}
ORACLE_SQL = {"op1_quality_rules": sql.op1(), "op4_url_filter": sql.op4(), "op8_warc": sql.op8(), "op9_top_k": sql.op9()}
