"""Searching as a service: requests in, answers out, as batches or a stream.

Requests are (collection, line) and, each if it has them, k, mode, profile, threshold and ids:
`mode` has bit 0 for AND and bit 1 for phrases; with `profile` the response has counters;
`threshold` is that of phrases; with `ids` the line's tokens are term ids. A request whose
line has an unknown term, or can't be read, is answered with an error.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexisift.operators import phrases, querying
from lexisift.operators.checkpoints import cut
from lexisift.sources.collection import Collection

#: Bits of a request's mode.
AND, PHRASES = 1, 2


@dataclass(frozen=True)
class Answers:
    """What a batch of requests is answered with.

    results: (collection, qid, line, k, mode, rank, doc_id, score); errors: (collection, qid, line,
    k, mode, error), qid null where the line has none; responses: a row per request, (collection,
    qid, line, k, mode, status, ranker, qry_len, result_size, postings_evaluated, postings_total),
    status being 1, or 0 for an error, counters null without `profile`.
    """

    results: DataFrame
    errors: DataFrame
    responses: DataFrame


@dataclass(frozen=True)
class SearchService:
    """Answers requests from one collection root; keeps no state between them."""

    collection: Collection
    ranker: str = "bm25"
    threshold: float = 10.0

    def answer(self, requests: DataFrame, k: int = 10, mode: int = 0, profile: bool = False) -> Answers:
        """Answers to requests, each at its own depth and mode.

        The arguments, and the service's threshold, hold where requests have no such column or
        a null in it. Equal requests are answered once; a qid may come with several lines,
        depths and modes. An empty batch gets no answer.
        """
        kinds = {"k": (k, "bigint"), "mode": (mode, "bigint"), "profile": (profile, "boolean"), "threshold": (self.threshold, "double"), "ids": (False, "boolean")}
        own = [F.coalesce(F.col(c) if c in requests.columns else F.lit(None), F.lit(default)).cast(kind).alias(c) for c, (default, kind) in kinds.items()]
        asked = cut(requests.select("collection", "line", *own).dropDuplicates().withColumn("request", F.monotonically_increasing_id()))
        readable = querying.split_lines(asked)
        bits = F.col("mode").bitwiseAND(F.lit(AND | PHRASES))
        modes = [tuple(x) for x in asked.groupBy(bits, "ids").agg(F.max("k"), F.max("profile")).collect()] or [(mode, False, k, profile)]  # eight at most
        found, counters, errors = [], [], []
        for of_mode, ids, deepest, counted in modes:
            some, dictionary = readable.filter((bits == of_mode) & (F.col("ids") == ids)), None if ids else self.collection.dictionary
            units = cut(self._units(some, dictionary, bool(of_mode & PHRASES)))
            results = self.collection.search(units, deepest, self.ranker, "and" if of_mode & AND else "or", bool(of_mode & PHRASES))
            found.append(results.withColumnRenamed("qid", "request"))
            lens = units.groupBy("qid").agg(F.count("*").alias("qry_len")).withColumnRenamed("qid", "request")
            if counted:
                told = self.collection.profile(units, bool(of_mode & PHRASES)).select(F.col("qid").alias("request"), "postings_evaluated", "postings_total")
                counters.append(lens.join(told, "request", "left"))
            else:
                counters.append(lens.selectExpr("*", "CAST(NULL AS bigint) AS postings_evaluated", "CAST(NULL AS bigint) AS postings_total"))
            errors.append(querying.rejected(asked.filter((bits == of_mode) & (F.col("ids") == ids)).select("request", "line"), dictionary))
        united = lambda parts: reduce(DataFrame.unionByName, parts)
        told = ["collection", "qid", "line", "k", "mode"]
        of_request = asked.join(readable.select("request", "qid"), "request", "left")
        results = united(found).drop("collection").join(of_request, "request").filter("rank <= k")
        failed = cut(united(errors).join(asked, "request"))
        sizes = results.groupBy("request").agg(F.count("*").alias("result_size"))
        status = F.when(F.col("error").isNull(), 1).otherwise(0).cast("bigint")
        rows = of_request.join(failed.select("request", "error"), "request", "left").join(united(counters), "request", "left").join(sizes, "request", "left")
        count = lambda c: F.when(status == 1, F.coalesce(c, F.lit(0))).alias(c)
        counter = lambda c: F.when(F.col("profile") & (status == 1), F.coalesce(c, F.lit(0))).alias(c)
        return Answers(
            results.select(*told, "rank", "doc_id", "score"),
            failed.select(*told, "error"),
            rows.select(*told, status.alias("status"), F.lit(self.ranker).alias("ranker"), count("qry_len"), count("result_size"), counter("postings_evaluated"), counter("postings_total")),
        )

    def _units(self, readable: DataFrame, dictionary: DataFrame | None, with_phrases: bool) -> DataFrame:
        """(collection, qid, unit, f_qt) of readable requests without unknown terms; their numbers stand for qids."""
        lines = readable.select("collection", "threshold", F.concat_ws(";", F.col("request").cast("string"), "content").alias("line"))
        if not with_phrases:
            return querying.parse(lines, dictionary, "reject", most_chars=None).select("collection", "qid", F.array("term_id").alias("unit"), "f_qt")
        return phrases.segment_queries(querying.in_order(lines, dictionary), self.collection.positions, self.collection.terms, self.collection.stats, self.threshold)

    def serve(
        self, requests: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 10, mode: int = 0, error_sink: Callable[[DataFrame, int], None] | None = None,
        response_sink: Callable[[DataFrame, int], None] | None = None,
    ) -> StreamingQuery:
        """Answers a stream of requests, as of answer(), a micro-batch at a time.

        sink(results, batch_id) writes the results of a batch, error_sink its errors and
        response_sink its responses; the same batch may come again after a failure, so they
        must write by batch_id. Without error_sink the number of errors is logged as a warning.
        """

        def batch(df: DataFrame, batch_id: int) -> None:
            answers = self.answer(df, k, mode)
            sink(answers.results, batch_id)
            if response_sink is not None:
                response_sink(answers.responses, batch_id)
            if error_sink is not None:
                error_sink(answers.errors, batch_id)
            elif n := answers.errors.count():
                logging.getLogger(__name__).warning("batch %d: %d requests in error, and no error_sink", batch_id, n)

        return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def run_client(service: SearchService, lines: Sequence[tuple[str, str]], runs: int = 1, k: int = 10, mode: int = 0, index_name: str = "lists") -> DataFrame:
    """A client's loop over (collection, line): each sent by itself `runs` times; a row per request as of exports.write_client_rows().

    Times are microseconds, means over the runs: client_time of the whole call, qry_time of
    parsing and searching, which here are one job, as search_time. A request in error has
    no row. Lines are sent one after the other, so give it a sample of queries.
    """
    spark, rows = service.collection.postings.sparkSession, []
    for collection, line in lines:
        request, spent, inner = spark.createDataFrame([(collection, line)], "collection string, line string"), 0.0, 0.0
        for _ in range(runs):
            began = time.perf_counter()
            answers = service.answer(request, k, mode, profile=True)
            searched = time.perf_counter()
            answers.results.collect()  # k rows
            inner += time.perf_counter() - searched
            spent += time.perf_counter() - began
        for r in answers.responses.filter("status = 1").collect():
            micros = lambda s: int(s * 1e6 / runs)
            rows.append((r["qid"], collection, r["ranker"], index_name, mode & AND, k, r["qry_len"], r["result_size"], micros(spent), micros(inner), 0, 0, r["postings_evaluated"], r["postings_total"], micros(spent)))
    kinds = "qid bigint, collection string, ranker string, index_name string, qry_mode bigint, k bigint, qry_len bigint, result_size bigint, qry_time bigint, search_time bigint"
    return spark.createDataFrame(rows, f"{kinds}, wt_search_space bigint, wt_nodes bigint, postings_evaluated bigint, postings_total bigint, client_time bigint")


def timings(client_rows: DataFrame) -> DataFrame:
    """(id, index, k, num_terms, time_ms) of run_client()'s rows, the mean over a query's rows."""
    per_query = client_rows.groupBy("qid", "index_name", "k", "qry_len").agg((F.avg("qry_time") / 1000).alias("time_ms"))
    return per_query.select(F.col("qid").alias("id"), F.col("index_name").alias("index"), "k", F.col("qry_len").alias("num_terms"), "time_ms")
