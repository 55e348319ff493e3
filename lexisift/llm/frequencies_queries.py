"""Queries on the frequencies of terms and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexisift.llm import frequencies
from lexisift.sources.tables import table


def p3_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return frequencies.both_sides(table(spark, d, "postings"), table(spark, d, "query_token"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return frequencies.marked(p3_frequencies(spark, d), table(spark, d, "documents"), table(spark, d, "query_token"))


QUERIES = {f.__name__: f for f in (p3_found, p3_frequencies)}

_BOTH = """WITH f AS (
  SELECT collection, 'text' AS side, term_id, CAST(sum(f_dt) AS BIGINT) AS occurrences, count(DISTINCT doc_id) AS records
  FROM (SELECT DISTINCT collection, term_id, doc_id, f_dt FROM postings WHERE term_id > 1) GROUP BY 1, 2, 3
  UNION ALL
  SELECT collection, 'query', id, CAST(sum(coalesce(f_qt, 1)) AS BIGINT), count(DISTINCT qid)
  FROM (SELECT collection, qid, f_qt, unnest(token_ids) AS id FROM (SELECT DISTINCT * FROM query_token)) WHERE id > 1 GROUP BY 1, 2, 3)"""
SQL = {
    "p3_frequencies": f"{_BOTH} SELECT * FROM f",
    "p3_found": f"""{_BOTH}, n AS (SELECT collection, 'text' AS side, count(DISTINCT doc_id) AS of FROM documents GROUP BY 1
  UNION ALL SELECT collection, 'query', count(DISTINCT qid) FROM query_token GROUP BY 1)
SELECT collection, side, term_id, 'rare' AS mark FROM f WHERE occurrences <= 2
UNION ALL SELECT f.collection, f.side, term_id, 'common' FROM f JOIN n ON n.collection = f.collection AND n.side = f.side WHERE records > 0.2 * of""",
}
