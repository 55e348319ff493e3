"""Queries on keys that hold most records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.operators import skew
from lexisift.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.recorded_wrongly(table(spark, d, "postings"), table(spark, d, "term_info"), table(spark, d, "client_row"))


def p5_term_documents(spark: SparkSession, d: str) -> DataFrame:
    return skew.term_document_counts(table(spark, d, "postings"))


def p5_request_totals(spark: SparkSession, d: str) -> DataFrame:
    postings, info = table(spark, d, "postings"), table(spark, d, "term_info")
    wanted = skew.query_terms(info).select("collection", "term_id").dropDuplicates()
    totals = skew.request_totals(info, skew.term_document_counts(postings, wanted))
    requests = table(spark, d, "client_row").select("collection", "qid", "req_id").filter("req_id IS NOT NULL").dropDuplicates()
    return skew.skew_join(requests, totals, ["collection", "qid"]).select("collection", F.col("req_id"), F.col("true_total"))


QUERIES = {f.__name__: f for f in (p5_found, p5_term_documents, p5_request_totals)}

_COUNTS = "n AS (SELECT collection, term_id, count(DISTINCT doc_id) AS n_docs FROM postings WHERE term_id > 1 GROUP BY 1, 2)"
_TOTALS = """
tot AS (SELECT t.collection, t.qid, CAST(sum(coalesce(n.n_docs, 0)) AS BIGINT) AS true_total
  FROM (SELECT DISTINCT collection, qid, token_ids[1] AS term_id FROM term_info WHERE len(token_ids) = 1) t
  JOIN (SELECT collection, qid FROM term_info GROUP BY 1, 2 HAVING max(coalesce(len(token_ids), 0)) <= 1) q
    ON q.collection = t.collection AND q.qid = t.qid
  LEFT JOIN n ON n.collection = t.collection AND n.term_id = t.term_id
  GROUP BY 1, 2)"""
SQL = {
    "p5_found": f"""WITH {_COUNTS}, {_TOTALS}
SELECT DISTINCT 'term' AS kind, i.collection, i.token_ids[1] AS key_id
FROM term_info i LEFT JOIN n ON n.collection = i.collection AND n.term_id = i.token_ids[1]
WHERE len(i.token_ids) = 1 AND i.f_dt <> coalesce(n.n_docs, 0)
UNION ALL
SELECT DISTINCT 'request', c.collection, c.req_id FROM client_row c
JOIN tot ON tot.collection = c.collection AND tot.qid = c.qid WHERE c.postings_total <> tot.true_total""",
    "p5_term_documents": f"WITH {_COUNTS} SELECT * FROM n",
    "p5_request_totals": f"""WITH {_COUNTS}, {_TOTALS}
SELECT DISTINCT c.collection, c.req_id, tot.true_total FROM client_row c
JOIN tot ON tot.collection = c.collection AND tot.qid = c.qid WHERE c.req_id IS NOT NULL""",
}
