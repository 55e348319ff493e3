"""From documents to tokens, postings and statistics, each per collection.

Lengths count one symbol for the end of a document, and a collection one more for its own
end; both enter the scores. Separators themselves are never stored.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexisift.operators.checkpoints import cut, written
from lexisift.operators.skew import skew_join

#: Terms of a dictionary that are broadcast at most, about 60 bytes each; beyond it a skew-safe shuffle join is used.
BROADCAST_TERMS = 1_000_000
#: A term: a maximal run of letters or digits.
TERM = r"([\p{L}\p{N}]+)"
#: What NFC may replace: combining marks, Hangul parts, and signs with a preferred form.
CHANGED_BY_NFC = r"[\p{M}\u0340-\u0387\u1100-\u11FF\u1F71-\u1FFD\u2000\u2001\u2126\u212A\u212B\u2329\u232A\uF900-\uFAFF]"


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """`text` in NFC. Only texts with combining marks, Hangul parts or signs that NFC replaces leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(CHANGED_BY_NFC), text)), text)


def terms_of(text: Column) -> Column:
    """array<string>: the terms of `text` in order; empty for null and empty texts."""
    return F.regexp_extract_all(F.lower(nfc(F.coalesce(text, F.lit("")))), F.lit(TERM), 1)


def normalise_query(line: Column) -> Column:
    """A query line in lower case, without ' and full stops, with blanks for hyphens."""
    return F.translate(F.translate(F.lower(line), "'.", ""), "-", " ")


def documents_terms(documents: DataFrame) -> DataFrame:
    """(collection, doc_id, terms), a row per document with its terms in order; null doc_ids are left out."""
    return documents.filter("doc_id IS NOT NULL").select("collection", "doc_id", terms_of(F.col("text")).alias("terms"))


def tokens(documents: DataFrame) -> DataFrame:
    """(collection, doc_id, pos, term), positions from 0. No shuffle."""
    return documents_terms(documents).select("collection", "doc_id", F.posexplode("terms").alias("pos", "term")).withColumn("pos", F.col("pos").cast("bigint"))


def postings(documents: DataFrame) -> DataFrame:
    """(collection, term, doc_id, f_dt). Counted within each document's array before anything is shuffled by document and term."""
    return tokens(documents).groupBy("collection", "term", "doc_id").agg(F.count("*").alias("f_dt"))


def clean_postings(rows: DataFrame) -> DataFrame:
    """(collection, term_id, doc_id, f_dt) of a delivered list: distinct rows, without separators."""
    return rows.select("collection", "term_id", "doc_id", "f_dt").filter("term_id > 1 AND doc_id IS NOT NULL AND f_dt IS NOT NULL").dropDuplicates()


def doc_lengths(documents: DataFrame) -> DataFrame:
    """(collection, doc_id, w_d): tokens + 1. A document without terms has length 1. No shuffle."""
    return documents_terms(documents).select("collection", "doc_id", (F.size("terms") + 1).cast("bigint").alias("w_d"))


def doc_lengths_of(lists: DataFrame, documents: DataFrame) -> DataFrame:
    """(collection, doc_id, w_d) from clean postings instead of texts; documents without postings have length 1."""
    sums = lists.groupBy("collection", "doc_id").agg(F.sum("f_dt").alias("n"))
    all_docs = documents.filter("doc_id IS NOT NULL").select("collection", "doc_id")
    return all_docs.join(sums, ["collection", "doc_id"], "left").select("collection", "doc_id", (F.coalesce("n", F.lit(0)) + 1).cast("bigint").alias("w_d"))


def collection_stats(lengths: DataFrame) -> DataFrame:
    """(collection, n_docs, n_symbols, avgdl, min_w_d): n_symbols = sum(w_d) + 1, avgdl = n_symbols / n_docs."""
    return lengths.groupBy("collection").agg(
        F.count("*").alias("n_docs"), (F.sum("w_d") + 1).alias("n_symbols"), ((F.sum("w_d") + 1) / F.count("*")).alias("avgdl"), F.min("w_d").alias("min_w_d"),
    )


def term_stats(lists: DataFrame, term: str = "term") -> DataFrame:
    """(collection, term, dfreq, cfreq, max_tf) of postings, counted per task before the shuffle."""
    return lists.groupBy("collection", term).agg(F.count("*").alias("dfreq"), F.sum("f_dt").alias("cfreq"), F.max("f_dt").alias("max_tf"))


def collection_info(documents: DataFrame) -> DataFrame:
    """(collection, n_symbols, n_docs, n_terms, avg_len): `avg_len` is the whole part of n_symbols / n_docs. Texts are read once."""
    per_term = tokens(documents).groupBy("collection", "term").agg(F.count("*").alias("n"))
    counted = per_term.groupBy("collection").agg(F.count("*").alias("n_terms"), F.sum("n").alias("n"))
    sizes = documents.filter("doc_id IS NOT NULL").groupBy("collection").agg(F.count("*").alias("n_docs")).join(counted, "collection", "left")
    return sizes.withColumn("n_symbols", F.coalesce("n", F.lit(0)) + F.col("n_docs") + 1).select(
        "collection", "n_symbols", "n_docs", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.expr("n_symbols div n_docs").alias("avg_len")
    )


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(collection, w_d, n_docs)."""
    return lengths.groupBy("collection", "w_d").agg(F.count("*").alias("n_docs"))


def length_ranks(lengths: DataFrame) -> DataFrame:
    """(collection, doc_id, w_d, length_rank): documents renumbered from 0 by (w_d, doc_id).

    A window over a collection, or over the documents of a common length, would bring them
    into one task. Instead the documents are range-partitioned in that order; each is numbered
    within its partition, and the number of those of its collection in earlier partitions is
    added. Read twice, so the ordered rows are written once.
    """
    order = ["collection", "w_d", "doc_id"]
    placed = lengths.select(*order).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    within = cut(placed.withColumn("i", F.row_number().over(Window.partitionBy("part", "collection").orderBy("w_d", "doc_id")) - 1))
    earlier = Window.partitionBy("collection").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    before = within.groupBy("collection", "part").agg(F.count("*").alias("n")).select("collection", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return within.join(before, ["collection", "part"]).select("collection", "doc_id", "w_d", (F.col("i") + F.col("before")).cast("bigint").alias("length_rank"))


def ngrams(documents: DataFrame, n: int) -> DataFrame:
    """(collection, gram, n_occurrences): every sequence of n terms, overlaps included, never across documents."""
    at = F.sequence(F.lit(1), F.size("terms") - (n - 1))
    grams = documents_terms(documents).filter(F.size("terms") >= n).select("collection", F.explode(F.transform(at, lambda i: F.slice("terms", i, n))).alias("gram"))
    return grams.groupBy("collection", "gram").agg(F.count("*").alias("n_occurrences"))


def terms_and_pairs(documents: DataFrame) -> DataFrame:
    """(collection, first, second, n): how often each term occurs, `second` being null, and each two neighbouring terms. Texts are read once."""
    at = F.sequence(F.lit(1), F.size("terms"))
    pair = lambda i: F.struct(F.element_at("terms", i).alias("first"), F.get("terms", i).alias("second"))  # noqa: E731  get counts from 0
    with_next = F.transform(at, pair)
    alone = F.transform("terms", lambda t: F.struct(t.alias("first"), F.lit(None).cast("string").alias("second")))
    rows = documents_terms(documents).filter(F.size("terms") > 0).select("collection", F.inline(F.concat(alone, F.filter(with_next, lambda x: x["second"].isNotNull()))))
    return rows.groupBy("collection", "first", "second").agg(F.count("*").alias("n"))


def positions(documents: DataFrame, dictionary: DataFrame, buckets: int | None = None) -> DataFrame:
    """(collection, term_id, doc_id, positions, w_d): where each term stands in each document, from 0, in ascending order.

    dictionary: (term, term_id), unique; terms that it lacks are left out, but count for
    w_d. Texts are cut into terms where they are read; with `buckets` the terms are brought
    there by doc_id, and nothing is shuffled after that.
    """
    terms = documents_terms(documents)
    each = (terms.repartition(buckets, "doc_id") if buckets else terms).select("collection", "doc_id", F.posexplode("terms").alias("pos", "term"))
    placed = with_lengths(each.groupBy("collection", "doc_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions")), F.size("positions"))
    known = dictionary.select("term", "term_id")
    told = placed.join(F.broadcast(known), "term") if known.count() <= BROADCAST_TERMS else skew_join(written(placed), known, ["term"])
    return told.select("collection", "term_id", "doc_id", "positions", "w_d")


def with_lengths(lists: DataFrame, f_dt: Column | None = None) -> DataFrame:
    """`lists`, a row per document and term, with w_d: the sum of the document's f_dt, and one.

    f_dt: occurrences, the column of this name if not given. A document's rows meet in one
    task: they are as many as it has different terms.
    """
    of_document = Window.partitionBy("collection", "doc_id")
    return lists.withColumn("w_d", (F.sum(F.col("f_dt") if f_dt is None else f_dt).over(of_document) + 1).cast("bigint"))
