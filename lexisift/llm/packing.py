"""Filling containers of fixed capacity with documents, balanced by cost."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.tokens import VOCABULARY, token_count

#: Documents that are packed together. A bucket leaves at most about one container unfilled.
BUCKET_DOCUMENTS = 20_000
#: Cost of a piece of n tokens: LINEAR * n + n * n / capacity. The square is the attention within it.
LINEAR = 1.0


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """For each piece, the index of its sequence. No sequence gets more than `capacity` tokens.

    Pieces are taken in descending order (ties: as given) and go to the sequence of the lowest
    cost that has room. As many sequences are open from the start as the total needs; another
    is opened where none has room. A sequence without room for a piece waits until the pieces
    are small enough, so that each step costs a heap operation.
    """
    if sizes.max(initial=0) > capacity:
        raise ValueError("a piece is larger than the capacity")
    n_open = max(1, -(-int(sizes.sum()) // capacity))
    room = [capacity] * n_open
    by_cost = [(0.0, i) for i in range(n_open)]
    waiting: list[tuple[int, float, int]] = []
    of = np.zeros(len(sizes), np.int64)
    for at in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[at])
        while waiting and -waiting[0][0] >= size:
            _, cost, i = heappop(waiting)
            heappush(by_cost, (cost, i))
        while by_cost and room[by_cost[0][1]] < size:
            cost, i = heappop(by_cost)
            heappush(waiting, (-room[i], cost, i))
        if by_cost:
            cost, i = heappop(by_cost)
        else:
            cost, i = 0.0, len(room)
            room.append(capacity)
        room[i] -= size
        of[at] = i
        heappush(by_cost, (cost + LINEAR * size + size * size / capacity, i))
    return of


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, tokens): documents of up to `capacity` tokens whole, larger ones cut every `capacity` tokens."""
    last = F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0)).cast("bigint")
    cut = sized.select("doc_id", F.col("tokens").alias("all"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity), F.col("all") - F.col("piece") * capacity).cast("bigint").alias("tokens"))


def pack(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, doc_id, piece, tokens): each document's container, or those of its pieces.

    documents: (doc_id, text, ...), `doc_id` unique; texts are tokenised whole. Documents larger
    than `capacity` tokens, and only those, are split. Null and empty texts have 0 tokens and
    take no room. Documents with a null `doc_id` are left out; an empty table gives no rows.

    Only (doc_id, piece, tokens) are shuffled, to buckets of about BUCKET_DOCUMENTS documents
    by a hash of `doc_id`, whose number follows the table's, and each is packed by assign().
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = documents.filter("doc_id IS NOT NULL")
    buckets = max(1, -(-rows.count() // BUCKET_DOCUMENTS))
    sized = rows.select("doc_id", token_count(F.col("text"), vocabulary).alias("tokens"))
    parted = pieces(sized, capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))

    def bucket(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        of = assign(t.column("tokens").to_numpy(), capacity)
        container = t.column("bucket").to_numpy() * (1 << 32) + of
        return pa.table([pa.array(container), t.column("doc_id"), t.column("piece"), t.column("tokens")], names=["container_id", "doc_id", "piece", "tokens"])

    return parted.groupBy("bucket").applyInArrow(bucket, "container_id bigint, doc_id bigint, piece bigint, tokens bigint")


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """(n_containers, n_documents, n_pieces, tokens, fill, mean_cost, highest_cost): one row, how full the containers are and how even their costs.

    A container's cost is that by which assign() balances. `fill` and costs are null if there
    are no containers.
    """
    cost = LINEAR * F.col("tokens") + F.col("tokens") * F.col("tokens") / capacity
    containers = packed.groupBy("container_id").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.count_if(F.col("piece") == 0).alias("documents"), F.sum(cost).alias("cost")
    )
    return containers.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("documents"), F.lit(0)).alias("n_documents"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("n_pieces"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.try_divide(F.sum("tokens"), F.count("*") * capacity).alias("fill"), F.avg("cost").alias("mean_cost"), F.max("cost").alias("highest_cost"),
    )
