"""Results with names and texts, and the files that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.operators.analyze import documents_terms


def with_names(results: DataFrame, documents: DataFrame) -> DataFrame:
    """`results` with the `name` of each document, null where there is none."""
    return results.join(documents.select("doc_id", "name"), "doc_id", "left")


def trec_rows(results: DataFrame, documents: DataFrame, tag: str) -> DataFrame:
    """(collection, qid, q0, name, rank, score, tag): a run in the order of its columns but for the collection."""
    named = with_names(results, documents)
    return named.select("collection", "qid", F.lit("Q0").alias("q0"), "name", "rank", "score", F.lit(tag).alias("tag"))


def extract(documents: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, content): the terms of each document of `results`, once, in order, parted by blanks."""
    hit = documents.join(results.select("doc_id").distinct(), "doc_id", "left_semi")
    return documents_terms(hit).select("doc_id", F.array_join("terms", " ").alias("content"))


def extract_one(documents: DataFrame, doc_id: int) -> DataFrame:
    """(doc_id, content) of one document; the filter reaches the scan."""
    return documents_terms(documents.filter(F.col("doc_id") == doc_id)).select("doc_id", F.array_join("terms", " ").alias("content"))


def write_results(results: DataFrame, path: str) -> None:
    """CSV files `id;rank;docid;score` with a header, ordered by query and rank over all files."""
    columns = results.select(F.col("qid").alias("id"), "rank", F.col("doc_id").alias("docid"), "score")
    columns.orderBy("id", "rank").write.mode("overwrite").csv(path, sep=";", header=True)


def write_timings(timings: DataFrame, path: str) -> None:
    """CSV files `id;index;k;num_terms;time_ms` with a header."""
    timings.select("id", "index", "k", "num_terms", "time_ms").write.mode("overwrite").csv(path, sep=";", header=True)


def write_client_rows(rows: DataFrame, path: str) -> None:
    """CSV files without a header, a request and its counters a line, 15 fields parted by `;`."""
    fields = ["qid", "collection", "ranker", "index_name", "qry_mode", "k", "qry_len", "result_size", "qry_time", "search_time", "wt_search_space", "wt_nodes", "postings_evaluated", "postings_total", "client_time"]
    rows.select(*fields).write.mode("overwrite").csv(path, sep=";")


def write_trec(rows: DataFrame, path: str) -> None:
    """Tab-separated files without a header: qid Q0 name rank score tag, ordered by query and rank over all files."""
    rows.orderBy("qid", "rank").select("qid", "q0", "name", "rank", "score", "tag").write.mode("overwrite").csv(path, sep="\t")


def results_to_trec(spark, csv_path: str, documents: DataFrame, tag: str) -> DataFrame:
    """The rows of a run from CSV files as written by write_results()."""
    results = spark.read.schema("id bigint, rank bigint, docid bigint, score double").csv(csv_path, sep=";", header=True)
    named = results.join(documents.select(F.col("doc_id").alias("docid"), "name"), "docid", "left")
    return named.select(F.col("id").alias("qid"), F.lit("Q0").alias("q0"), "name", "rank", "score", F.lit(tag).alias("tag"))
