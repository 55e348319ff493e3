"""Percentiles per group over very many numbers, from summaries that can be combined."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisift.llm import rank_summary as rs
from lexisift.operators.checkpoints import cut
from lexisift.operators.skew import skew_join

#: Rank error of any percentile, as a share of the group's number of values.
EPS = 0.004
#: Percentiles that a report holds.
PROBABILITIES = (0.5, 0.9, 0.95, 0.99)
#: A task summarises so many rows at once.
CHUNK_ROWS = 1_000_000
#: So many tasks' summaries of a group meet in one merge; beyond that levels are put between.
FAN_IN = 64

_SUMMARY = T.StructType(
    [
        T.StructField("level", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("uncertainty", T.LongType()),
        T.StructField("v", T.ArrayType(T.DoubleType())),
        T.StructField("g", T.ArrayType(T.LongType())),
        T.StructField("d", T.ArrayType(T.LongType())),
        T.StructField("percentiles", T.ArrayType(T.DoubleType())),
    ]
)
_ARROW = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]


def _fields(s: rs.Summary, asked: Sequence[float]) -> list:
    return [s.level, s.n, s.uncertainty, s.v, s.g, s.d, [rs.quantile(s, p) for p in asked]]


def _summary_columns(rows: list[list]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_ARROW)]


def _read(t: pa.Table) -> list[rs.Summary]:
    def lists(name: str) -> list[np.ndarray]:
        column = t.column(name).combine_chunks()
        flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        at = at - at[0] if len(at) else at
        return [flat[i:j] for i, j in zip(at[:-1], at[1:])]

    return [rs.Summary(v, g, d, n, level) for v, g, d, n, level in zip(lists("v"), lists("g"), lists("d"), t.column("n").to_pylist(), t.column("level").to_pylist())]


def summaries(df: DataFrame, keys: Sequence[str], measures: Sequence[str], eps: float = EPS) -> DataFrame:
    """(keys, measure, level, n, uncertainty, v, g, d, percentiles): partial summaries, one or more per task and group.

    df: the key columns and the numeric `measures`; other columns are ignored. Null and NaN
    are no values; a group without values of a measure has no row. Null keys form a group.
    Nothing is shuffled; a task holds CHUNK_ROWS rows at most.
    """
    kinds = [df.schema[k] for k in keys]
    out = T.StructType([*kinds, T.StructField("measure", T.StringType()), *_SUMMARY.fields])

    def one(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        grouped = chunk.group_by(list(keys), use_threads=False).aggregate([(m, "list") for m in measures])
        for m in measures:
            lists = grouped.column(f"{m}_list").combine_chunks()
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            made = [rs.exact(flat[i - at[0] : j - at[0]]) for i, j in zip(at[:-1], at[1:])]
            keep = [i for i, s in enumerate(made) if s.n]
            if keep:
                key_columns = [grouped.column(k).combine_chunks().take(pa.array(keep)) for k in keys]
                rows = [_fields(rs.compress(made[i], eps), ()) for i in keep]
                yield pa.RecordBatch.from_arrays([*key_columns, pa.array([m] * len(keep)), *_summary_columns(rows)], names=out.names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK_ROWS:
                yield from one(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from one(pa.Table.from_batches(held))

    return df.select(*keys, *(F.col(m).cast("double").alias(m) for m in measures)).mapInArrow(task, out)


def merged(parts: DataFrame, keys: Sequence[str], eps: float = EPS, asked: Sequence[float] = PROBABILITIES, tasks: int = 1) -> DataFrame:
    """`parts`, one row per group: the summaries of equal `keys` (and `measure`) as one, with its percentiles.

    parts: as of summaries() or merged(), whose further key columns are left out; so days
    become months. tasks: how many tasks made `parts`; with more than FAN_IN, levels of
    merges over FAN_IN tasks each are put between until so many are left. A merge holds some
    hundred tuples of each part. No rows give no rows.
    """
    by = [*keys, "measure"]
    if tasks > FAN_IN:
        between = parts.withColumn("__of", F.spark_partition_id())
        while tasks > FAN_IN:
            between = _met(between.withColumn("__of", F.floor(F.col("__of") / FAN_IN).cast("int")), [*by, "__of"], eps, ())
            tasks = -(-tasks // FAN_IN)
        parts = between
    return _met(parts, by, eps, asked)


def _met(parts: DataFrame, by: Sequence[str], eps: float, asked: Sequence[float]) -> DataFrame:
    """One level of merges: a row per group of `by`."""
    out = T.StructType([*(parts.schema[k] for k in by), *_SUMMARY.fields])

    def group(t: pa.Table) -> pa.Table:
        s = rs.merge(_read(t), eps)
        return pa.Table.from_arrays([*(t.column(k).combine_chunks().slice(0, 1) for k in by), *_summary_columns([_fields(s, asked)])], names=out.names)

    return parts.select(*by, *_SUMMARY.names[:6]).groupBy(*by).applyInArrow(group, out)


def once(requests: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(index_name, ranker, day, month, measures), a row per `req_id`: its earliest log row.

    Null and negative measures become null; rows without `req_id` or `sent_at` are left out.
    Equal rows of a request are joined per task and then where its `req_id` is sent.
    """
    kept = ["req_id", "index_name", "ranker", "sent_at", *measures]
    rows = requests.select(*kept, "logged_at").filter("req_id IS NOT NULL AND sent_at IS NOT NULL")
    earliest = rows.groupBy("req_id").agg(F.min_by(F.struct(*kept[1:]), F.struct("logged_at", *kept[1:])).alias("x")).select("x.*")
    return earliest.select(
        "index_name", "ranker", F.date_format("sent_at", "yyyy-MM-dd").alias("day"), F.date_format("sent_at", "yyyy-MM").alias("month"),
        *(F.when(F.col(m) >= 0, F.col(m)).alias(m) for m in measures),
    )


def by_period(requests: DataFrame, measures: Sequence[str] = ("qry_time", "search_time"), eps: float = EPS) -> DataFrame:
    """(period, index_name, ranker, measure, n, rank_error, p50, p90, p95, p99), by day and by month of `sent_at`.

    requests: rows as of client_row; a `req_id` counts once. Months are merged from the
    summaries of their days. rank_error: the largest error of a rank that the summary can
    have, as a share of n; at most eps.
    """
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = summaries(once(requests, measures), ["day", "month", "index_name", "ranker"], measures, eps)
    days = cut(merged(parts, ["day", "month", "index_name", "ranker"], eps, tasks=tasks))
    months = merged(days, ["month", "index_name", "ranker"], eps)
    report = lambda df, period: df.select(
        F.col(period).alias("period"), "index_name", "ranker", "measure", "n",
        F.when(F.col("n") > F.size("v"), F.col("uncertainty") / (2 * F.col("n"))).otherwise(0.0).alias("rank_error"),
        *(F.col("percentiles")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(PROBABILITIES)),
    )
    return report(days, "day").unionByName(report(months, "month"))


def long_tails(report: DataFrame, times: float = 6, least: int = 100) -> DataFrame:
    """(period, index_name, ranker, measure) whose 95th percentile is more than `times` the median, of at least `least` values."""
    return report.filter((F.col("n") >= least) & (F.col("p95") > times * F.col("p50"))).select("period", "index_name", "ranker", "measure")


def within_bound(requests: DataFrame, measures: Sequence[str] = ("qry_time", "search_time"), eps: float = EPS) -> DataFrame:
    """(period, index_name, ranker, measure, n, within): whether all percentiles of by_period() are as near to the exact ranks as promised.

    All values are counted: a check of by_period(), at the cost of a full shuffle of the
    values. Periods and measures as of by_period(); groups of null names are compared too.
    """
    group = ["period", "index_name", "ranker", "measure"]
    key = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n")) for c in group)).alias("__group")
    measured = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures)))
    long = once(requests, measures).select("index_name", "ranker", F.explode(F.array("day", "month")).alias("period"), measured.alias("m")).select("period", "index_name", "ranker", "m.*")
    counts = long.filter("x IS NOT NULL AND NOT isnan(x)").groupBy(key, "x").agg(F.count("*").alias("rows"))
    answers = by_period(requests, measures, eps).withColumn("__group", key)
    joined = skew_join(counts, answers, ["__group"])
    n, rows = F.col("n"), F.col("rows")
    errors = []
    for p in PROBABILITIES:
        rank, answer = F.greatest(F.lit(1), F.ceil(n * p - 1e-9)), F.col(f"p{round(100 * p)}")
        below, up_to = F.sum(F.when(F.col("x") < answer, rows).otherwise(0)), F.sum(F.when(F.col("x") <= answer, rows).otherwise(0))
        errors.append(F.greatest(below + 1 - F.first(rank), F.first(rank) - up_to))
    checked = joined.groupBy("__group", *group, "n").agg((F.greatest(*errors) <= eps * F.first("n")).alias("near"), (F.sum("rows") == F.first("n")).alias("whole"))
    return checked.select(*group, "n", (F.col("near") & F.col("whole")).alias("within"))
