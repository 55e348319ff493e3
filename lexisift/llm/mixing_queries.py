"""Queries on mixing and the SQL of p7_found.

Tokens of a tokenizer can't be counted in SQL, so it counts words: no source is near enough to
its target for that to matter. Tests hold the others against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexisift.llm import mixing
from lexisift.sources.tables import table


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_report(spark, d).filter("short").select("source")


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).chosen


QUERIES = {f.__name__: f for f in (p7_found, p7_report, p7_mixed)}
SQL = {
    "p7_found": r"""WITH s AS (SELECT m.source, any_value(target_share) AS share, any_value(max_repeats) AS repeats,
    coalesce(sum(len(regexp_extract_all(coalesce(d.text, ''), '[\p{L}\p{N}]+'))), 0) AS size
  FROM mix_target m LEFT JOIN documents d ON lower(trim(d.source)) = lower(trim(m.source)) GROUP BY 1)
SELECT source FROM s WHERE repeats * size < share * (SELECT sum(size) FROM s)""",
}
