"""Queries on the dealt text problems 7 to 9, each over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import encode, mix, split


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return mix.mix(docs, table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).filter(F.col("piece_no") == 0).select("doc_id")


QUERIES = {f.__name__: f for f in (p7_ids, p8_mix, p8_shares, p9_found, p9_pieces)}
#: Tokenizers are beyond SQL; the tests hold these against whole-text encoding and brute force.
SQL: dict[str, str] = {}
