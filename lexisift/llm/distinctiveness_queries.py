"""Queries on the most characteristic terms and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexisift.llm import distinctiveness
from lexisift.sources.tables import table


def p2_weights(spark: SparkSession, d: str) -> DataFrame:
    return distinctiveness.most_characteristic(table(spark, d, "postings"), table(spark, d, "term_info"), table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_weights(spark, d).select("record_kind", "collection", "record_id", "term_id")


def p2_by_counts(spark: SparkSession, d: str) -> DataFrame:
    return distinctiveness.most_characteristic_by_counts(table(spark, d, "postings"))


def p2_records_by_counts(spark: SparkSession, d: str) -> DataFrame:
    return distinctiveness.records_by_counts(table(spark, d, "postings"), table(spark, d, "term_info"))


QUERIES = {f.__name__: f for f in (p2_found, p2_weights, p2_by_counts, p2_records_by_counts)}

_WEIGHED = """WITH p AS (SELECT DISTINCT collection, term_id, doc_id, f_dt FROM postings WHERE term_id > 1),
  n AS (SELECT collection, term_id, count(DISTINCT doc_id) AS n FROM p GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2),
  c AS (SELECT collection, count(DISTINCT doc_id) AS of FROM documents GROUP BY 1),
  r AS (SELECT 'document' AS record_kind, collection, doc_id AS record_id, term_id, f_dt AS f FROM p
    UNION ALL SELECT 'query', collection, qid, token_ids[1], sum(f_qt) FROM (SELECT DISTINCT * FROM term_info) WHERE len(token_ids) = 1 GROUP BY 2, 3, 4),
  w AS (SELECT record_kind, r.collection, record_id, r.term_id, floor(f * ln(CAST(of AS DOUBLE) / n) * 1e6 + 0.5) / 1e6 AS weight
    FROM r JOIN n ON n.collection = r.collection AND n.term_id = r.term_id JOIN c ON c.collection = r.collection WHERE f IS NOT NULL),
  best AS (SELECT *, row_number() OVER (PARTITION BY record_kind, collection, record_id ORDER BY weight DESC, term_id) AS i FROM w)"""
SQL = {
    "p2_found": f"{_WEIGHED} SELECT record_kind, collection, record_id, term_id FROM best WHERE i = 1",
    "p2_weights": f"{_WEIGHED} SELECT record_kind, collection, record_id, term_id, weight FROM best WHERE i = 1",
    "p2_by_counts": """WITH p AS (SELECT collection, term_id, doc_id, CAST(sum(f_dt) AS DOUBLE) AS f
    FROM (SELECT DISTINCT collection, term_id, doc_id, f_dt FROM postings WHERE term_id > 1 AND f_dt > 0) GROUP BY 1, 2, 3),
  t AS (SELECT collection, term_id, sum(f) AS c FROM p GROUP BY 1, 2), a AS (SELECT collection, sum(f) AS t FROM p GROUP BY 1),
  l AS (SELECT collection, doc_id, sum(f) AS w FROM p GROUP BY 1, 2),
  k AS (SELECT p.collection, p.doc_id, p.term_id, a.t, f AS k11, w - f AS k12, c - f AS k21, t - w - c + f AS k22
    FROM p JOIN t ON t.collection = p.collection AND t.term_id = p.term_id JOIN a ON a.collection = p.collection JOIN l ON l.doc_id = p.doc_id AND l.collection = p.collection),
  g AS (SELECT *, 2 * (CASE WHEN k11 > 0 THEN k11 * ln(k11 * t / ((k11 + k12) * (k11 + k21))) ELSE 0 END
    + CASE WHEN k12 > 0 THEN k12 * ln(k12 * t / ((k11 + k12) * (k12 + k22))) ELSE 0 END
    + CASE WHEN k21 > 0 THEN k21 * ln(k21 * t / ((k21 + k22) * (k11 + k21))) ELSE 0 END
    + CASE WHEN k22 > 0 THEN k22 * ln(k22 * t / ((k21 + k22) * (k12 + k22))) ELSE 0 END) AS g0 FROM k),
  s AS (SELECT *, floor((CASE WHEN k11 * (k21 + k22) < k21 * (k11 + k12) THEN -g0 ELSE g0 END) * 1e6 + 0.5) / 1e6 AS x FROM g)
SELECT collection, doc_id AS record_id, term_id, round(x, 3) AS llr
FROM (SELECT *, row_number() OVER (PARTITION BY collection, doc_id ORDER BY x DESC, term_id) AS i FROM s) WHERE i = 1""",
    "p2_records_by_counts": """WITH p AS (SELECT collection, term_id, doc_id, CAST(sum(f_dt) AS DOUBLE) AS f
    FROM (SELECT DISTINCT collection, term_id, doc_id, f_dt FROM postings WHERE term_id > 1 AND f_dt > 0 AND doc_id IS NOT NULL) GROUP BY 1, 2, 3),
  q AS (SELECT collection, qid, token_ids[1] AS term_id, CAST(sum(f_qt) AS DOUBLE) AS f FROM (SELECT DISTINCT * FROM term_info)
    WHERE len(token_ids) = 1 AND token_ids[1] > 1 AND qid IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(f_qt) > 0),
  c AS (SELECT collection, term_id, sum(f) AS c FROM p GROUP BY 1, 2), a AS (SELECT collection, sum(f) AS t FROM p GROUP BY 1),
  r AS (SELECT 'document' AS record_kind, collection, doc_id AS record_id, term_id, f, sum(f) OVER (PARTITION BY collection, doc_id) AS w, 1 AS inside FROM p
    UNION ALL SELECT 'query', collection, qid, term_id, f, sum(f) OVER (PARTITION BY collection, qid), 0 FROM q),
  k AS (SELECT record_kind, r.collection, record_id, r.term_id, f AS k11, w - f AS k12, coalesce(c, 0) - inside * f AS k21, coalesce(t, 0) - coalesce(c, 0) - inside * (w - f) AS k22
    FROM r LEFT JOIN c ON c.collection = r.collection AND c.term_id = r.term_id LEFT JOIN a ON a.collection = r.collection),
  g AS (SELECT *, k11 + k12 + k21 + k22 AS n, 2 * (CASE WHEN k11 > 0 THEN k11 * ln(k11 * n / ((k11 + k12) * (k11 + k21))) ELSE 0 END
    + CASE WHEN k12 > 0 THEN k12 * ln(k12 * n / ((k11 + k12) * (k12 + k22))) ELSE 0 END
    + CASE WHEN k21 > 0 THEN k21 * ln(k21 * n / ((k21 + k22) * (k11 + k21))) ELSE 0 END
    + CASE WHEN k22 > 0 THEN k22 * ln(k22 * n / ((k21 + k22) * (k12 + k22))) ELSE 0 END) AS g0 FROM k),
  s AS (SELECT *, floor((CASE WHEN k11 * (k21 + k22) < k21 * (k11 + k12) THEN -g0 ELSE g0 END) * 1e6 + 0.5) / 1e6 AS x FROM g)
SELECT record_kind, collection, record_id, term_id, round(x, 3) AS llr
FROM (SELECT *, row_number() OVER (PARTITION BY record_kind, collection, record_id ORDER BY x DESC, term_id) AS i FROM s) WHERE i = 1""",
}
