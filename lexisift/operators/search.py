"""Ranked search for a batch of queries in one job.

The batch's units are few and meet the statistics of their terms first. Then they are
broadcast, up to a counted number, to the postings, so that only postings of the batch's terms
are kept and none is shuffled. Postings carry their document's length and lie with all other
postings of the document (see Collection.save): the contributions of a query and document are
added where they are read, each task keeps its k best of each query, and only those are
shuffled. Every candidate is scored, so results are exact. Ties go to the smaller doc_id, on the
score rounded to 9 decimals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexisift.functions.rankers import RANKERS, Stats
from lexisift.operators.checkpoints import cut
from lexisift.operators.skew import skew_join

#: Units of a batch that are broadcast at most, about 150 bytes each; beyond it skew-safe shuffle joins are used.
BROADCAST_UNITS = 300_000
#: Up to so many different terms of a batch are given to the scan as a filter.
PUSHED_TERMS = 32

_UNIT = ["collection", "unit"]
_QUERY = ["collection", "qid"]
_TERM = ["collection", "term_id"]


def unit_key(ids) -> object:
    """A unit's ids as one string, a key that both sides of a join can hash."""
    return F.array_join(ids, " ")


def meet(fact: DataFrame, few: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """`fact` joined with `few` of counted `rows`, several for a key: by broadcast up to BROADCAST_UNITS, else by skew_join."""
    return fact.join(F.broadcast(few), keys) if rows <= BROADCAST_UNITS else skew_join(fact, few, keys, unique=False)


def of_terms(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """`postings`, filtered in the scan to the term ids of `wanted` if these are PUSHED_TERMS at most."""
    ids = [r[0] for r in wanted.select("term_id").distinct().limit(PUSHED_TERMS + 1).collect()]
    if not ids or len(ids) > PUSHED_TERMS:
        return postings
    return postings.filter(reduce(lambda a, b: a | b, [F.col("term_id") == i for i in ids]))  # a long IN would reach the files as a range only


@dataclass(frozen=True)
class Batch:
    """The queries of a search. Each has a number, `request`, that stands for it in joins and sums.

    requests: (request, collection, qid, qry_len); found: (collection, request, unit, term_id,
    f_qt, dfreq, cfreq, n_found, n_docs, n_symbols, avgdl), the units that occur at all; n: their
    number; postings: those to search. A phrase is a term with an id below 0, given for this batch.
    """

    requests: DataFrame
    found: DataFrame
    n: int
    postings: DataFrame

    def named(self, rows: DataFrame) -> DataFrame:
        """`rows` with (collection, qid) in the place of `request`."""
        keys = self.requests.select("request", *_QUERY)
        joined = rows.join(F.broadcast(keys) if self.n <= BROADCAST_UNITS else keys, "request")
        return joined.select(*_QUERY, *(c for c in rows.columns if c != "request"))

    def matches(self, *columns) -> DataFrame:
        """(request, doc_id, f_dt, w_d, columns), a row for each query, unit and document that has it; columns: of the units."""
        return meet(self.postings, self.found.select(*_TERM, "request", *columns), _TERM, self.n).drop(*_TERM)


def batch(queries: DataFrame, postings: DataFrame, terms: DataFrame, stats: DataFrame, phrase_lists: DataFrame | None = None, buckets: int | None = None) -> Batch:
    """The batch of queries (collection, qid, unit, f_qt); the other arguments as of search().

    Where postings lie in buckets by document, phrases, far fewer, are brought to them, so that
    all rows of a document are in one task.
    """
    unit = F.struct(unit_key(F.col("unit")).alias("unit"), F.when(F.size("unit") == 1, F.get("unit", F.lit(0))).alias("term_id"), "f_qt")
    grouped = queries.groupBy(*_QUERY).agg(F.collect_list(unit).alias("units"))  # a query's units: bounded by its length
    numbered = cut(grouped.withColumn("request", F.monotonically_increasing_id()))
    asked = numbered.select("collection", "request", F.inline("units"))
    single = asked.filter("term_id IS NOT NULL")
    found = meet(terms.select(*_TERM, "dfreq", "cfreq"), single, _TERM, single.count())
    lists = of_terms(postings, single).select(*_TERM, "doc_id", "f_dt", "w_d")
    if phrase_lists is not None:
        keyed = phrase_lists.select("collection", unit_key(F.col("unit")).alias("unit"), "doc_id", "f_dt", "w_d")
        phrases = keyed.groupBy(*_UNIT).agg(F.count("*").alias("dfreq"), F.sum("f_dt").alias("cfreq"))
        phrases = cut(phrases.withColumn("term_id", -1 - F.monotonically_increasing_id()))
        found = found.unionByName(asked.filter("term_id IS NULL").drop("term_id").join(phrases, _UNIT))
        few = phrases.select(*_UNIT, "term_id")
        as_terms = (keyed.join(F.broadcast(few), _UNIT) if few.count() <= BROADCAST_UNITS else skew_join(keyed, few, _UNIT)).select(lists.columns)
        lists = lists.unionByName(as_terms.repartition(buckets, "doc_id") if buckets else as_terms)
    rows = found.join(stats.select("collection", "n_docs", "n_symbols", "avgdl"), "collection")
    rows = cut(rows.withColumn("n_found", F.count("*").over(Window.partitionBy("request"))))
    return Batch(numbered.select("request", *_QUERY, F.size("units").cast("bigint").alias("qry_len")), rows, rows.count(), lists)


def scores(asked: Batch, ranker: str = "bm25", mode: str = "or") -> DataFrame:
    """(request, doc_id, score, n_matched): every document with a unit of the query (`or`), or all its found ones (`and`)."""
    if mode not in ("or", "and"):
        raise ValueError(f"unknown mode: {mode}")
    chosen, s = RANKERS[ranker], Stats.of_columns()
    of_unit = (chosen.of_unit(s) if chosen.of_unit else F.lit(1.0)).alias("of_unit")
    sums = [F.sum(chosen.contribution(s, F.col("of_unit"))).alias("score"), F.count("*").alias("n_matched")]
    if chosen.doc_weight:
        sums.append(F.max(F.col("n_found") * chosen.doc_weight(s)).alias("weight"))  # equal for a query and document
    if mode == "and":
        sums.append(F.max("n_found").alias("n_found"))
    rows = asked.matches("f_qt", "dfreq", "cfreq", "n_found", "n_docs", "n_symbols", "avgdl", of_unit)
    summed = rows.groupBy("request", "doc_id").agg(*sums)
    kept = summed.filter("n_matched = n_found") if mode == "and" else summed
    return kept.select("request", "doc_id", (F.col("score") + F.col("weight") if chosen.doc_weight else F.col("score")).alias("score"), "n_matched")


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """(request, rank, doc_id, score): the k best of each request, cut per task before the shuffle."""
    order = Window.partitionBy("request").orderBy(F.rint(F.col("score") * 1e9).desc(), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("request", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


def candidates(queries: DataFrame, postings: DataFrame, terms: DataFrame, stats: DataFrame, ranker: str = "bm25", mode: str = "or", phrase_lists: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """(collection, qid, doc_id, score, n_matched): all candidates of a search, as of search()."""
    asked = batch(queries, postings, terms, stats, phrase_lists, buckets)
    return asked.named(scores(asked, ranker, mode))


def search(queries: DataFrame, postings: DataFrame, terms: DataFrame, stats: DataFrame, k: int = 10, ranker: str = "bm25", mode: str = "or", phrase_lists: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """(collection, qid, rank, doc_id, score) for a batch of queries.

    queries: (collection, qid, unit, f_qt); postings: (collection, term_id, doc_id, f_dt, w_d);
    terms and stats: statistics of terms and collections; phrase_lists: as of
    phrases.phrase_postings(), for units of several ids, which count for nothing without it;
    buckets: those of the postings by doc_id, if they lie in such.
    Units that occur nowhere don't count, not even for `and`. A query that finds nothing has
    no row; empty tables give none.
    """
    asked = batch(queries, postings, terms, stats, phrase_lists, buckets)
    return asked.named(top_k(scores(asked, ranker, mode), k))


def search_one(query: DataFrame, postings: DataFrame, terms: DataFrame, stats: DataFrame, k: int = 10, ranker: str = "bm25", mode: str = "or", phrase_lists: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """search() for a single query: each task keeps its k best rows by a heap, without a sort of all; ValueError for several queries."""
    asked = batch(query, postings, terms, stats, phrase_lists, buckets)
    if asked.requests.limit(2).count() > 1:
        raise ValueError("more than one query")
    best = scores(asked, ranker, mode).orderBy(F.rint(F.col("score") * 1e9).desc(), "doc_id").limit(k)
    return asked.named(top_k(best, k))


def profile(queries: DataFrame, postings: DataFrame, terms: DataFrame, stats: DataFrame, phrase_lists: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """(collection, qid, qry_len, n_found, postings_total, postings_evaluated): what a search has to read and scores.

    postings_total: the lengths of the found units' lists, from the statistics;
    postings_evaluated: different documents in them. Queries that find nothing have zeros.
    """
    asked = batch(queries, postings, terms, stats, phrase_lists, buckets)
    totals = asked.found.groupBy("request").agg(F.count("*").alias("n_found"), F.sum("dfreq").alias("postings_total"))
    docs = asked.matches().groupBy("request", "doc_id").agg(F.lit(1).alias("one"))
    evaluated = docs.groupBy("request").agg(F.count("*").alias("postings_evaluated"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = asked.requests.join(totals, "request", "left").join(evaluated, "request", "left")
    return joined.select(*_QUERY, "qry_len", zero("n_found"), zero("postings_total"), zero("postings_evaluated"))


def list_bounds(postings: DataFrame, terms: DataFrame, stats: DataFrame, ranker: str = "bm25") -> DataFrame:
    """(collection, term_id, max_score, max_doc_weight): for each list the largest contribution for f_qt = 1 and the largest document weight.

    A bound for a query multiplies max_score by its f_qt. The statistics of a term are joined
    at even load, whatever the length of its list.
    """
    chosen, s = RANKERS[ranker], Stats.of_columns()
    per_term = terms.select(*_TERM, "dfreq", "cfreq").join(stats.select("collection", "n_docs", "n_symbols", "avgdl"), "collection")
    n = terms.count()
    lists = postings.select(*_TERM, "doc_id", "f_dt", "w_d")
    rows = (lists.join(F.broadcast(per_term), _TERM) if n <= BROADCAST_UNITS else skew_join(lists, per_term, _TERM)).withColumn("f_qt", F.lit(1))
    weight = chosen.doc_weight(s) if chosen.doc_weight else F.lit(0.0)
    of_unit = chosen.of_unit(s) if chosen.of_unit else F.lit(1.0)
    return rows.groupBy(*_TERM).agg(F.round(F.max(chosen.contribution(s, of_unit)), 6).alias("max_score"), F.round(F.max(weight), 6).alias("max_doc_weight"))
