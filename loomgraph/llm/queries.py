"""Queries of the operators on training text over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import read
from . import encode, licenses, mixing, subjects


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_column(read(spark, d, "documents"), "doc_id", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    reader = licenses.train_reader(read(spark, d, "license_list"))
    return licenses.resolve_licenses(read(spark, d, "files"), read(spark, d, "licenses"), read(spark, d, "registry"), reader)


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    """Files and repositories by license, conflicts and unknowns among them."""
    return p4_found(spark, d).groupBy("scope", "license").count().withColumnRenamed("count", "items")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "source_weights"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "source_weights"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.find_subjects(read(spark, d, "documents"), read(spark, d, "subject_examples"))


def p8_makeup(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the corpus: documents of each subject, and their share of all documents."""
    return subjects.makeup(p8_found(spark, d), read(spark, d, "documents"), read(spark, d, "subjects"))


QUERIES = {"p4_found": p4_found, "p4_summary": p4_summary, "p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_makeup": p8_makeup}
SQL: dict[str, str] = {}
