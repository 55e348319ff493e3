"""How characteristic a term is of a record, by log-likelihood ratios.

A 2x2 table holds the term's count and all other counts, in the record and in the remaining
collection. Two forms of the test are given:

- both rows are samples: the statistic is 2 * sum(O * ln(O / E)) over all four cells;
- the collection's rate is known: the expected counts of the record come from the collection's
  row alone, whose own cells are as expected then. For a record that is told by the term only,
  (f, 0) against the collection's (n, N - n) documents with and without it, half of that is
  f * ln(N / n), the weight that rankings add up. It is the limit of the first form for a
  growing collection row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.operators.checkpoints import cut
from lexisift.operators.skew import count_distinct_per_key, skew_join

#: A table of terms is broadcast up to this number of rows, about 100 bytes each; beyond it a skew-safe shuffle join is used.
BROADCAST_TERMS = 150_000

_TERM = ["collection", "term_id"]
_RECORD = ["record_kind", "collection", "record_id"]


def log_likelihood_ratio(k11: Column, k12: Column, k21: Column, k22: Column, rate_known: bool = False) -> Column:
    """2 * sum(O * ln(O / E)) of a 2x2 table, the record's row first, the term's column first.

    Negative where the record has less than its share. Empty cells add 0. rate_known: the
    collection's row is no sample but gives the rates of both columns; null if it is empty.
    """
    k11, k12, k21, k22 = (k.cast("double") for k in (k11, k12, k21, k22))
    record, rest = k11 + k12, k21 + k22
    if rate_known:
        cells = [(k11, (k11 / record) / (k21 / rest)), (k12, (k12 / record) / (k22 / rest))]
    else:
        total, with_term, without = record + rest, k11 + k21, k12 + k22
        cells = [(k11, k11 * total / (record * with_term)), (k12, k12 * total / (record * without)), (k21, k21 * total / (rest * with_term)), (k22, k22 * total / (rest * without))]
    g = 2 * reduce(Column.__add__, [F.when(k > 0, k * F.ln(ratio)).otherwise(0.0) for k, ratio in cells])
    return F.when(k11 * rest < k21 * record, -g).otherwise(g)


def document_records(postings: DataFrame) -> DataFrame:
    """(record_kind, collection, record_id, term_id, f): documents and their terms; repeated rows stay."""
    kind, record = F.lit("document").alias("record_kind"), F.col("doc_id").alias("record_id")
    return postings.select(kind, "collection", record, "term_id", F.col("f_dt").alias("f")).filter("term_id > 1 AND record_id IS NOT NULL AND f IS NOT NULL")


def query_records(term_info: DataFrame) -> DataFrame:
    """(record_kind, collection, record_id, term_id, f): queries and their one-id terms, `f_qt` added over distinct rows."""
    columns = ["collection", "qid", "tok_pos", "token_ids", "f_qt", "sp_dt", "ep_dt", "f_dt"]
    rows = term_info.select(*columns).dropDuplicates().filter((F.size("token_ids") == 1) & F.col("qid").isNotNull())
    f = rows.groupBy("collection", F.col("qid").alias("record_id"), F.get("token_ids", F.lit(0)).alias("term_id")).agg(F.sum("f_qt").alias("f"))
    return f.filter("term_id > 1 AND f IS NOT NULL").select(F.lit("query").alias("record_kind"), "collection", "record_id", "term_id", "f")


def term_rates(postings: DataFrame, documents: DataFrame, least: int = 2) -> DataFrame:
    """(collection, term_id, n, of): in how many of the collection's documents a term is, of how many; `least` of them at least."""
    n = count_distinct_per_key(postings.select(*_TERM, "doc_id").filter("term_id > 1 AND doc_id IS NOT NULL"), _TERM, "doc_id", "n").filter(F.col("n") >= least)
    of = documents.filter("doc_id IS NOT NULL").groupBy("collection").agg(F.count_distinct("doc_id").alias("of"))
    return n.join(of, "collection")


def _look_up(rows: DataFrame, terms: DataFrame) -> DataFrame:
    if terms.count() <= BROADCAST_TERMS:
        return rows.join(F.broadcast(terms), _TERM)
    return skew_join(rows, terms, _TERM)


def _best(weighed: DataFrame, weight: Column) -> DataFrame:
    """Each record's term of the highest weight, rounded to 6 decimals; ties go to the smaller term_id."""
    top = weighed.groupBy(*_RECORD).agg(F.max(F.struct(F.floor(weight * 1e6 + 0.5).alias("w"), (-F.col("term_id")).alias("neg"))).alias("top"))
    return top.filter("top.w IS NOT NULL").select(*_RECORD, (-F.col("top.neg")).alias("term_id"), (F.col("top.w") / 1e6).alias("weight"))


def most_characteristic(postings: DataFrame, term_info: DataFrame, documents: DataFrame) -> DataFrame:
    """(record_kind, collection, record_id, term_id, weight): each query's and document's most characteristic term, at known rates.

    postings, term_info, documents: as the tables of these names. Only terms in at least two
    documents of the collection count; records without one are left out. Repeated rows count
    once: the best of a document is the same with and without its repeats, so only the
    counts need distinct rows. Rows with null keys or frequencies don't count; empty
    tables give no rows.
    """
    rates = cut(term_rates(postings, documents))
    weight = log_likelihood_ratio(F.col("f"), F.lit(0), F.col("n"), F.col("of") - F.col("n"), rate_known=True) / 2
    texts = _best(_look_up(document_records(postings), rates), weight)
    return texts.unionByName(_best(skew_join(query_records(term_info), rates, _TERM), weight))


def most_characteristic_by_counts(postings: DataFrame) -> DataFrame:
    """(collection, record_id, term_id, llr): each document's term with the largest signed log-likelihood ratio.

    The table compares the term's occurrences in the document with those in the remaining
    collection. A collection of one document leaves nothing to compare with: its llr is 0.
    """
    return _documents_by_counts(*_counts(postings)).select("collection", "record_id", "term_id", F.round("weight", 3).alias("llr"))


def records_by_counts(postings: DataFrame, term_info: DataFrame) -> DataFrame:
    """(record_kind, collection, record_id, term_id, llr): the same for documents and queries.

    A query, its one-id terms as of query_records(), is no part of the collection and is
    compared with all of it. A term that the collection lacks counts too, as 0 there.
    """
    once, terms = _counts(postings)
    both = _documents_by_counts(once, terms).unionByName(_queries_by_counts(query_records(term_info).filter("f > 0"), terms))
    return both.select(*_RECORD, "term_id", F.round("weight", 3).alias("llr"))


def _counts(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collection, term_id, record_id, f) of the documents, and (collection, term_id, in_all) of their collections."""
    rows = postings.select("collection", "term_id", F.col("doc_id").alias("record_id"), F.col("f_dt").alias("f")).filter("term_id > 1 AND record_id IS NOT NULL AND f > 0")
    once = rows.repartition("collection", "term_id", "record_id").dropDuplicates().groupBy("collection", "term_id", "record_id").agg(F.sum("f").alias("f"))
    return once, cut(once.groupBy(*_TERM).agg(F.sum("f").alias("in_all")))


def _totals(terms: DataFrame) -> DataFrame:
    return terms.groupBy("collection").agg(F.sum("in_all").alias("of_all"))


def _documents_by_counts(once: DataFrame, terms: DataFrame) -> DataFrame:
    lengths = once.groupBy("collection", "record_id").agg(F.sum("f").alias("w_d"))
    counted = _look_up(once, terms.join(_totals(terms), "collection")).join(lengths, ["collection", "record_id"])
    f, w, c, t = (F.col(x) for x in ("f", "w_d", "in_all", "of_all"))
    llr = log_likelihood_ratio(f, w - f, c - f, t - w - c + f)
    return _best(counted.withColumn("record_kind", F.lit("document")), llr)


def _queries_by_counts(records: DataFrame, terms: DataFrame) -> DataFrame:
    lengths = records.groupBy("collection", "record_id").agg(F.sum("f").alias("w_d"))
    counted = skew_join(records, terms, _TERM, "left").join(lengths, ["collection", "record_id"]).join(_totals(terms), "collection", "left")
    f, w, c, t = (F.coalesce(x, F.lit(0)) for x in ("f", "w_d", "in_all", "of_all"))
    return _best(counted, log_likelihood_ratio(f, w - f, c, t - c))
