"""Queries on languages. A fitted model can't be written in SQL; tests measure it on held-out sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexisift.llm import languages
from lexisift.sources.tables import table


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return languages.language_segments(documents, languages.fit_model(documents, table(spark, d, "lang_sample")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.wrongly_labelled(p8_segments(spark, d))


QUERIES = {f.__name__: f for f in (p8_found, p8_segments)}
SQL: dict[str, str] = {}
