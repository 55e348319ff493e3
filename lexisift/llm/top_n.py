"""The N best items of every group, by lower bounds of each partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexisift.operators.checkpoints import cut
from lexisift.operators.skew import skew_join

#: A task ranks so many rows at once.
CHUNK_ROWS = 500_000
#: Rows that a task keeps from one chunk for the next.
KEEP_ROWS = 1_000_000
#: Different N for which bounds are kept exactly; with more, N is rounded up to a power of two.
EXACT_RANKS = 16
#: A group's survivors are ranked in so many slices before the last ranking.
SLICES = 32
#: The table of bounds is broadcast up to this number of groups, about 100 bytes each; beyond it a skew-safe shuffle join is used.
BROADCAST_GROUPS = 200_000

_GROUP = ["collection", "qid"]


def depths(requests: DataFrame) -> DataFrame:
    """(collection, qid, k): how many items each group keeps, the largest non-null `k` of its requests.

    Groups without a positive `k` are left out. Repeats of a group are joined per task
    before the shuffle, so that a group with a third of the rows does no harm.
    """
    return requests.filter("k > 0 AND qid IS NOT NULL AND collection IS NOT NULL").groupBy(*_GROUP).agg(F.max("k").alias("k"))


def usable(scores: DataFrame) -> DataFrame:
    """(collection, qid, doc_id, score) of the rows that can be ranked: no nulls, a finite score."""
    finite = "score > double('-infinity') AND score < double('infinity')"  # NaN is above infinity
    return scores.select(*_GROUP, "doc_id", "score").filter(f"collection IS NOT NULL AND qid IS NOT NULL AND doc_id IS NOT NULL AND {finite}")


def _ranked(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Distinct items by group, best first; their ranks in it, from 1."""
    best = t.group_by(["collection", "qid", "doc_id"], use_threads=False).aggregate([("score", "max")])
    codes = best.column("collection").combine_chunks().dictionary_encode().indices.to_numpy()
    qid, doc, score = (best.column(c).to_numpy() for c in ("qid", "doc_id", "score_max"))
    order = np.lexsort((doc, -score, qid, codes))
    codes, qid = codes[order], qid[order]
    new = np.ones(len(order), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (qid[1:] != qid[:-1])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    best = pa.table({"collection": best.column("collection"), "qid": best.column("qid"), "doc_id": best.column("doc_id"), "score": best.column("score_max")})
    return best.take(pa.array(order)), np.arange(len(order)) - start + 1


def local_bounds(rows: DataFrame, ranks: list[int]) -> DataFrame:
    """(collection, qid, rank, score, doc_id): for each task and group, its local item of each rank in `ranks`.

    rows: as of usable(). An item counts once, with its highest score in the task, and ties
    go to the smaller `doc_id`; so at least `rank` items of the group are as good as the
    bound. A group with fewer local items gives no bound at that rank.
    """
    out = T.StructType([*(rows.schema[c] for c in _GROUP), T.StructField("rank", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("doc_id", T.LongType())])
    deepest = max(ranks)

    def bounds(t: pa.Table, rank: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.isin(rank, ranks))
        few = t.take(pa.array(at)).combine_chunks()
        columns = [few.column("collection"), few.column("qid"), pa.chunked_array([pa.array(rank[at])]), few.column("score"), few.column("doc_id")]
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], names=out.names)

    def together(held: list[pa.RecordBatch], kept: pa.Table | None) -> pa.Table:
        read = [pa.table(b.columns, names=b.schema.names) for b in held]  # without the schema's not-null marks
        return pa.concat_tables(read + ([kept] if kept is not None else []))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kept = [], 0, None
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < CHUNK_ROWS:
                continue
            t, rank = _ranked(together(held, kept))
            kept = t.take(pa.array(np.flatnonzero(rank <= deepest)))
            held, n = [], 0
            if kept.num_rows > KEEP_ROWS:  # what has been seen stands for itself
                yield bounds(t, rank)
                kept = None
        if n or kept is not None:
            yield bounds(*_ranked(together(held, kept)))

    return rows.mapInArrow(task, out)


def top_n(scores: DataFrame, requests: DataFrame) -> DataFrame:
    """(collection, qid, doc_id, score, rank): the best `k` items of each group, ties to the smaller `doc_id`.

    scores: (collection, qid, doc_id, score, ...), any number of rows per group and item; an
    item counts once, with its highest score. requests: (collection, qid, k, ...).

    Each task's local k-th best item is a valid bound. The best bound of each group is
    joined, rows below it are dropped before any shuffle, and the survivors are ranked: in
    slices first, so that no task gets a large group whole, then the best k of each slice.
    A group without k distinct items in any one task has no bound and keeps all its rows.
    Rows with a null key or `doc_id`, or a null, NaN or infinite score, and groups without
    a `k` are left out. Empty tables give no rows.
    """
    ks = cut(depths(requests))
    top = [r["k"] for r in ks.select("k").distinct().orderBy("k").limit(EXACT_RANKS + 1).collect()]
    if not top:
        return usable(scores).filter("false").withColumn("rank", F.lit(0).cast("bigint"))
    if len(top) <= EXACT_RANKS:
        ranks, rank_of = top, F.col("k")
    else:
        most = ks.agg(F.max("k")).first()[0]
        ranks = [2**i for i in range(max(1, (most - 1).bit_length()) + 1)]
        rank_of = F.array_min(F.filter(F.array(*map(F.lit, ranks)), lambda r: r >= F.col("k"))).cast("bigint")
    rows = usable(scores)
    best = local_bounds(rows, ranks).groupBy(*_GROUP, "rank").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("neg"))).alias("bound"))
    bounds = cut(
        ks.withColumn("rank", rank_of).join(best, [*_GROUP, "rank"], "left")
        .select(*_GROUP, "k", F.col("bound.score").alias("low"), (-F.col("bound.neg")).alias("low_doc"))
    )
    if bounds.count() <= BROADCAST_GROUPS:
        with_bound = rows.join(F.broadcast(bounds), _GROUP)
    else:
        with_bound = skew_join(rows, bounds, _GROUP)
    left = with_bound.filter("low IS NULL OR score > low OR (score = low AND doc_id <= low_doc)")
    sliced = left.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    order = [F.col("score").desc(), F.col("doc_id")]
    items = sliced.repartition(*_GROUP, "slice").groupBy(*_GROUP, "slice", "doc_id").agg(F.max("score").alias("score"), F.max("k").alias("k"))
    best_of_slice = items.withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP, "slice").orderBy(*order))).filter("rank <= k")
    ranked = best_of_slice.withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP).orderBy(*order)).cast("bigint")).filter("rank <= k")
    return ranked.select(*_GROUP, "doc_id", "score", "rank")
