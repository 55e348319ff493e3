"""Mixing sources to target shares of the total size."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexisift.llm.cube import flight, landing
from lexisift.llm.tokens import VOCABULARY, token_count
from lexisift.operators.checkpoints import cut

#: Units of a source in one flight.
BUCKET_DOCUMENTS = 50_000
#: A table of targets is a configuration: with more rows than this it is refused.
MOST_SOURCES = 10_000


def normal_name(source: Column) -> Column:
    """A source's name without case and outer blanks."""
    return F.lower(F.regexp_replace(source, r"^[\s ]+|[\s ]+$", ""))


@dataclass(frozen=True)
class Mix:
    """sizes: (doc_id, source, tokens) of the documents of targeted sources; plan: a row per target; chosen: (doc_id, source, tokens, copies)."""

    sizes: DataFrame
    plan: DataFrame
    chosen: DataFrame

    def report(self) -> DataFrame:
        """(source, target_share, max_repeats, size, wanted, reached, actual_share, short), a row per target.

        `wanted` and `reached` are tokens; `short`: less is reached than is wanted, with max_repeats
        copies of everything. Both are told from the documents that were chosen.
        """
        reached = self.chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"))
        rows = self.plan.join(reached, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
        all_taken = F.col("reached") == F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)) * F.col("size")
        in_all = F.sum("reached").over(Window.partitionBy(F.lit(1)))  # MOST_SOURCES rows at most
        return rows.withColumn("in_all", in_all).select(
            "source", "target_share", "max_repeats", "size", "wanted", "reached",
            F.coalesce(F.try_divide("reached", "in_all"), F.lit(0.0)).alias("actual_share"), (all_taken & (F.col("reached") < F.col("wanted"))).alias("short"),
        )


def mix(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY, total: int | None = None) -> Mix:
    """Documents and copies such that each source gives its target share of the total tokens.

    documents: (doc_id, text, source, ...); targets: (source, target_share, max_repeats), names
    compared without case and outer blanks; two targets of the same name are a ValueError.
    total: the tokens to mix, those of all targeted sources if not given. A source that is
    wanted r times its size is taken floor(r) times whole, and a balanced sample of the rest
    once more; none is taken more than `max_repeats` times. Texts are tokenised whole; null
    and empty ones have 0 tokens. Documents without a source or `doc_id` take no part. A
    source without documents has size 0. Empty tables give empty results.

    The sample of a source is drawn by the cube method: flights in buckets of about
    BUCKET_DOCUMENTS, whose number follows the source's size; then, level by level, flights
    over the two units at most that each bucket leaves, BUCKET_DOCUMENTS of them at once,
    until one bucket is left; its last two units are landed. So no task gets more units
    than a bucket has, whatever the size of the source. Number and tokens are balanced for
    each source, and the same seed gives the same sample.
    """
    aims = targets.select(F.col("source").alias("spelled"), "target_share", "max_repeats", normal_name(F.col("source")).alias("name"))
    rows = aims.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES or len({r["name"] for r in rows}) < len(rows):
        raise ValueError("targets: too many rows, or two of the same name")
    named = documents.select("doc_id", "text", normal_name(F.col("source")).alias("name")).filter("doc_id IS NOT NULL")
    aimed = named.join(F.broadcast(aims.select("name", "spelled")), "name")  # MOST_SOURCES rows at most
    sizes = cut(aimed.select("doc_id", F.col("spelled").alias("source"), token_count(F.col("text"), vocabulary).alias("tokens")))

    per_source = {r["source"]: r for r in sizes.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("n")).collect()}
    total = sum(r["size"] for r in per_source.values()) if total is None else total
    plan, parts = [], []
    for r in rows:
        size, n = (per_source[r["spelled"]]["size"], per_source[r["spelled"]]["n"]) if r["spelled"] in per_source else (0, 0)
        wanted = (r["target_share"] or 0.0) * total
        most = max(0, r["max_repeats"] or 0)
        times = float(min(wanted / size, most)) if size else 0.0
        plan.append((r["spelled"], r["target_share"], r["max_repeats"], size, float(wanted)))
        parts.append((r["spelled"], int(times), times - int(times), max(1, -(-n // BUCKET_DOCUMENTS))))
    spark = documents.sparkSession
    plan_rows = spark.createDataFrame(plan, "source string, target_share double, max_repeats bigint, size bigint, wanted double")
    how = spark.createDataFrame(parts, "source string, whole bigint, p double, buckets bigint")

    units = sizes.join(F.broadcast(how), "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
    fixed = units.filter("p = 0").select("doc_id", "source", "tokens", F.col("whole").alias("copies"))
    columns = "doc_id bigint, source string, tokens bigint, whole bigint, bucket bigint, p double"

    def fly(t: pa.Table, last: bool) -> pa.Table:
        t = t.sort_by("doc_id")
        x = t.column("tokens").to_numpy()
        order = np.random.default_rng([seed, len(x), int(x.sum())]).permutation(len(x))
        p = np.empty(len(x))
        p[order] = flight(x[order], t.column("p").to_numpy()[order], seed + len(x))
        return t.select(["doc_id", "source", "tokens", "whole", "bucket"]).append_column("p", pa.array(landing(x, p) if last else p))

    def first(t: pa.Table) -> pa.Table:
        return fly(t, False)

    def final(t: pa.Table) -> pa.Table:
        return fly(t, True)

    open_, settled, most = units.filter("p > 0"), [], max((r[3] for r in parts), default=1)
    while most > 1:
        flown = cut(open_.groupBy("source", "bucket").applyInArrow(first, columns))
        settled.append(flown.filter("p = 0 OR p = 1"))
        together = max(2, BUCKET_DOCUMENTS // 2)  # buckets that leave two units each
        open_ = flown.filter("p > 0 AND p < 1").withColumn("bucket", F.floor(F.col("bucket") / together))
        most = -(-most // together)
    settled.append(open_.groupBy("source", "bucket").applyInArrow(final, columns))
    drawn = reduce(DataFrame.unionByName, settled).select("doc_id", "source", "tokens", (F.col("whole") + F.col("p").cast("bigint")).alias("copies"))
    return Mix(sizes, plan_rows, fixed.unionByName(drawn).filter("copies > 0"))
