"""Queries on packing and the SQL of p6_found.

Tokens of a tokenizer can't be counted in SQL, so it counts words: no document is near enough to
the capacity for that to matter. Tests hold the others against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexisift.llm import packing
from lexisift.sources.tables import table


def _capacity(spark: SparkSession, d: str) -> int:
    return table(spark, d, "pack_container").agg({"capacity": "min"}).first()[0]


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), _capacity(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be split: those with a second piece."""
    return p6_packed(spark, d).filter("piece = 1").select("doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_packed(spark, d), _capacity(spark, d))


QUERIES = {f.__name__: f for f in (p6_found, p6_packed, p6_fill)}
SQL = {
    "p6_found": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+')) > (SELECT min(capacity) FROM pack_container)",
}
