"""Queries on the best items of each group and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexisift.llm import top_n
from lexisift.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n.top_n(table(spark, d, "doc_score"), table(spark, d, "client_row")).select("collection", "qid", "doc_id")


def p4_ranked(spark: SparkSession, d: str) -> DataFrame:
    return top_n.top_n(table(spark, d, "doc_score"), table(spark, d, "client_row"))


QUERIES = {f.__name__: f for f in (p4_found, p4_ranked)}

_RANKED = """WITH ks AS (SELECT collection, qid, max(k) AS k FROM client_row WHERE k > 0 GROUP BY 1, 2),
  best AS (SELECT collection, qid, doc_id, max(score) AS score FROM doc_score
    WHERE doc_id IS NOT NULL AND score IS NOT NULL AND isfinite(score) GROUP BY 1, 2, 3),
  ranked AS (SELECT collection, qid, doc_id, score, k,
    row_number() OVER (PARTITION BY collection, qid ORDER BY score DESC, doc_id) AS rank FROM best JOIN ks USING (collection, qid))"""
SQL = {
    "p4_found": f"{_RANKED} SELECT collection, qid, doc_id FROM ranked WHERE rank <= k",
    "p4_ranked": f"{_RANKED} SELECT collection, qid, doc_id, score, rank FROM ranked WHERE rank <= k",
}
