"""Per-key work at even load when a few keys hold most rows.

Heavy keys are found with a frequent-items sketch. Rows of a heavy key stay where they are
and meet the other side by broadcast; all other rows take an ordinary shuffle join; both
results are united. A key is heavy from twice an average partition: no other key can make a
task run far longer, and there are half as many heavy keys as partitions at most (500 where
these are few), which bounds the broadcast side, never the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.operators.checkpoints import cut

#: A key is heavy from so many average partitions' rows ...
HEAVY_PARTITIONS = 2
#: ... or from this share of all rows, if that is less, ...
HEAVY_SHARE = 0.002
#: ... and this number of rows.
HEAVY_ROWS = 20_000
#: Slices of a heavy key where the other side has several rows for it.
SLICES = 32

_SLICE = "__skew_slice"
_TERM = ["collection", "term_id"]


def key_hash(keys: Sequence[str]) -> Column:
    """One bigint per key. Keys that collide merely share their route."""
    return F.xxhash64(*(F.col(f"`{k}`") for k in keys))


def heavy_share(spark: SparkSession) -> float:
    """The share of all rows from which a key is heavy, by the number of shuffle partitions."""
    return min(HEAVY_SHARE, HEAVY_PARTITIONS / int(spark.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float | None = None, least: int | None = None) -> list[int]:
    """Hashes of the keys that hold at least `share` (heavy_share()) of the rows and `least` (HEAVY_ROWS) rows.

    One pass with a mergeable frequent-items sketch, whose counts are off by a quarter of
    the share at most; the driver receives 1 / share pairs (hash, count) at most, so no
    heavy key is left out. An empty table has none. A key is missed or added only near the
    threshold, which changes the route of its rows, never the result.
    """
    share = heavy_share(df.sparkSession) if share is None else share
    most = ceil(1 / share)
    items = min(1_000_000, max(64, ceil(4 / (0.375 * share))))
    row = df.select(key_hash(keys).alias("h")).selectExpr(f"approx_top_k(h, {min(most, items)}, {items}) AS top", "count(*) AS n").first()
    limit = max(HEAVY_ROWS if least is None else least, share * row["n"])
    return [x["item"] for x in row["top"] or [] if x["count"] >= limit and x["item"] is not None]


def skew_join(fact: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner", heavy: list[int] | None = None, unique: bool = True) -> DataFrame:
    """`fact` joined with `dim` on `keys` (`inner`, `left` or `left_semi`), any key of `fact` being heavy.

    fact: any number of rows per key. dim: one row per key if `unique`, else any number.
    Heavy keys: with `unique`, their rows of `dim` (1 / heavy_share() and colliding hashes at most)
    are broadcast and the rows of `fact` are not shuffled. Without it, the rows of `fact`
    are cut into SLICES and those of `dim` repeated for each slice. Other keys: a shuffle
    join. Null keys match nothing, as in SQL. Columns besides the keys must differ in name
    between the two sides, else ValueError; empty sides give empty or null-filled results.
    """
    clash = (set(map(str.lower, fact.columns)) & set(map(str.lower, dim.columns))) - set(map(str.lower, keys))
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unknown join: {how}")
    heavy = heavy_keys(fact, keys) if heavy is None else heavy
    if not heavy:
        return fact.join(dim, list(keys), how)
    is_heavy = key_hash(keys).isin(heavy)
    cold = fact.filter(~is_heavy).join(dim.filter(~is_heavy), list(keys), how)
    if unique or how == "left_semi":
        few = dim.filter(is_heavy)
        hot = fact.filter(is_heavy).join(F.broadcast(few.dropDuplicates(list(keys)) if how == "left_semi" else few), list(keys), how)
    else:
        cut = fact.filter(is_heavy).withColumn(_SLICE, F.pmod(F.monotonically_increasing_id(), F.lit(SLICES)))
        many = dim.filter(is_heavy).withColumn(_SLICE, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SLICES - 1).cast("bigint"))))
        hot = cut.join(many, [*keys, _SLICE], how).drop(_SLICE)
    return cold.unionByName(hot.select(cold.columns))


def count_distinct_per_key(df: DataFrame, keys: Sequence[str], value: str, name: str = "n") -> DataFrame:
    """(keys, name): the number of distinct non-null `value` per key, at even load.

    Rows are spread by key and value, so that a heavy key is spread over all tasks; the
    counts are added per task before the small second shuffle. Rows that are partitioned by
    the keys already are not shuffled. Keys whose values are all null count 0; null keys
    form a group, as in SQL. An empty table gives no rows.
    """
    pairs = df.select(*keys, value).dropDuplicates()
    return pairs.groupBy(*keys).agg(F.count(value).alias(name))


def term_document_counts(postings: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(collection, term_id, n_docs): in how many documents of `postings` each term is.

    postings: (collection, term_id, doc_id, ...); repeated rows count once, rows with a null
    `doc_id` don't count, separators (ids 0 and 1) are no terms. wanted: (collection,
    term_id), unique: only these are counted; a wanted term without postings is not in the
    result.

    Each posting is shuffled once: those of long lists, which meet the wanted terms by
    broadcast, by term and document, so that they are spread over all tasks; those of other
    lists by term, where they are joined and counted without another shuffle.
    """
    rows = postings.select("collection", "term_id", "doc_id").filter("term_id > 1 AND doc_id IS NOT NULL")
    if wanted is None:
        return count_distinct_per_key(rows, _TERM, "doc_id", "n_docs")
    terms = wanted.select(*_TERM)
    heavy = heavy_keys(rows, _TERM)
    is_heavy = key_hash(_TERM).isin(heavy)
    cold = rows.filter(~is_heavy).join(terms.filter(~is_heavy), _TERM, "left_semi") if heavy else rows.join(terms, _TERM, "left_semi")
    counted = count_distinct_per_key(cold, _TERM, "doc_id", "n_docs")
    if not heavy:
        return counted
    hot = rows.filter(is_heavy).join(F.broadcast(terms.filter(is_heavy)), _TERM, "left_semi")  # as many terms as keys are heavy, and colliding hashes
    return counted.unionByName(count_distinct_per_key(hot, _TERM, "doc_id", "n_docs"))


def query_terms(term_info: DataFrame) -> DataFrame:
    """(collection, qid, term_id), distinct, of the queries whose tokens all have one id at most.

    Queries with a phrase (a token of several ids) are left out; null and empty tokens and
    null ids count for nothing.
    """
    rows = term_info.select("collection", "qid", "token_ids")
    per_query = rows.groupBy("collection", "qid").agg(
        F.max(F.coalesce(F.size("token_ids"), F.lit(0))).alias("longest"),
        F.collect_set(F.when(F.size("token_ids") == 1, F.get("token_ids", F.lit(0)))).alias("ids"),
    )  # a query's distinct terms: bounded by the length of a query
    return per_query.filter("longest <= 1").select("collection", "qid", F.explode("ids").alias("term_id"))


def request_totals(term_info: DataFrame, counts: DataFrame) -> DataFrame:
    """(collection, qid, true_total): the postings a query without phrases has to read.

    counts: as of term_document_counts, for the terms of these queries at least. A term
    without postings adds 0.
    """
    terms = skew_join(query_terms(term_info), counts, ["collection", "term_id"], "left")
    return terms.groupBy("collection", "qid").agg(F.sum(F.coalesce("n_docs", F.lit(0))).cast("bigint").alias("true_total"))


def recorded_wrongly(postings: DataFrame, term_info: DataFrame, client_row: DataFrame) -> DataFrame:
    """(kind, collection, key_id): what the logs recorded otherwise than the postings have it.

    kind `term`: a one-id token with some non-null recorded `f_dt` that is not its number of
    documents (0 if in none). kind `request`: a `req_id` with some non-null
    `postings_total` that is not the sum of those numbers over its query's terms; queries
    with a phrase or without any term are left out. Repeated rows count once, rows without
    a `req_id` don't count, empty tables give no rows.
    """
    single = term_info.filter(F.size("token_ids") == 1).select("collection", F.get("token_ids", F.lit(0)).alias("term_id"), "f_dt").filter("term_id IS NOT NULL")
    recorded = single.groupBy("collection", "term_id").agg(F.min("f_dt").alias("low"), F.max("f_dt").alias("high"))
    counts = cut(term_document_counts(postings, recorded))  # read twice; one row per term that was looked up
    terms = (
        recorded.join(counts, ["collection", "term_id"], "left")
        .withColumn("n", F.coalesce("n_docs", F.lit(0)))
        .filter("low <> n OR high <> n")
        .select(F.lit("term").alias("kind"), "collection", F.col("term_id").alias("key_id"))
    )
    requests = client_row.select("collection", "qid", "req_id", "postings_total").filter("postings_total IS NOT NULL AND req_id IS NOT NULL")
    wrong = (
        skew_join(requests, request_totals(term_info, counts), ["collection", "qid"])
        .filter("postings_total <> true_total")
        .select(F.lit("request").alias("kind"), "collection", F.col("req_id").alias("key_id"))
        .dropDuplicates()
    )
    return terms.unionByName(wrong)
