"""Queries on percentiles and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexisift.llm import percentiles
from lexisift.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.long_tails(percentiles.by_period(table(spark, d, "client_row")))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.by_period(table(spark, d, "client_row"))


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.by_period(table(spark, d, "client_row")).select("period", "index_name", "ranker", "measure", "n")


def p1_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether the percentiles keep the promised bound; SQL says that all do."""
    return percentiles.within_bound(table(spark, d, "client_row"))


QUERIES = {f.__name__: f for f in (p1_found, p1_percentiles, p1_values, p1_within)}

_LONG = """WITH once AS (SELECT req_id, any_value(index_name) AS index_name, any_value(ranker) AS ranker, any_value(sent_at) AS sent_at,
    any_value(qry_time) AS qry_time, any_value(search_time) AS search_time FROM client_row WHERE req_id IS NOT NULL AND sent_at IS NOT NULL GROUP BY req_id),
  long AS (SELECT p.period, index_name, ranker, m.measure, m.x FROM once,
    LATERAL (SELECT unnest([strftime(sent_at, '%Y-%m-%d'), strftime(sent_at, '%Y-%m')]) AS period) p,
    LATERAL (SELECT unnest(['qry_time', 'search_time']) AS measure, unnest([qry_time, search_time]) AS x) m WHERE m.x >= 0)"""
SQL = {
    "p1_found": f"""{_LONG} SELECT period, index_name, ranker, measure FROM long GROUP BY 1, 2, 3, 4
HAVING count(*) >= 100 AND quantile_disc(x, 0.95) > 6 * quantile_disc(x, 0.5)""",
    "p1_values": f"{_LONG} SELECT period, index_name, ranker, measure, count(*) AS n FROM long GROUP BY 1, 2, 3, 4",
    "p1_within": f"{_LONG} SELECT period, index_name, ranker, measure, count(*) AS n, true AS within FROM long GROUP BY 1, 2, 3, 4",
}
