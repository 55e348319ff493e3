"""Queries: parsing lines, policies for unknown terms, units to search for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A client sends no line of this length or more. A batch has no limit: it gives None for `most_chars`.
MOST_LINE_CHARS = 1024


def _read(lines: DataFrame, column: str, most_chars: int | None) -> DataFrame:
    """(other columns, column, qid, content, error), every line; error is null where it can be read."""
    others = [c for c in lines.columns if c not in (column, "qid", "content", "error")]
    line, parts = F.col(column), F.split(F.col(column), ";", 2)
    qid = F.when(line.contains(";"), F.get(parts, F.lit(0)).try_cast("bigint"))
    too_long = F.lit(False) if most_chars is None else F.coalesce(F.length(line) >= most_chars, F.lit(False))
    error = F.when(too_long, "line too long").when(qid.isNull(), "unreadable line")
    return lines.select(*others, column, qid.alias("qid"), F.get(parts, F.lit(1)).alias("content"), error.alias("error"))


def split_lines(lines: DataFrame, column: str = "line", most_chars: int | None = MOST_LINE_CHARS) -> DataFrame:
    """(other columns, qid, content) of lines `qid;tok tok ...`.

    The id stands before the first `;`. Lines of `most_chars` characters or more, without
    a `;`, or whose id is no whole number, are left out; unreadable() has them.
    """
    return _read(lines, column, most_chars).filter("error IS NULL").drop(column, "error")


def unreadable(lines: DataFrame, column: str = "line", most_chars: int | None = MOST_LINE_CHARS) -> DataFrame:
    """(other columns, column, qid, error): the lines that split_lines() leaves out, and why; qid is null where there is none."""
    return _read(lines, column, most_chars).filter("error IS NOT NULL").drop("content")


def parse(lines: DataFrame, dictionary: DataFrame | None, unknown: str = "drop", column: str = "line", most_chars: int | None = MOST_LINE_CHARS) -> DataFrame:
    """(other columns, qid, term_id, f_qt): the terms of each query and how often it has them.

    Tokens are parted by single blanks, so that two blanks in a row give an empty, unknown
    token. dictionary: (term, term_id), unique terms; without it the tokens are ids already,
    and what is no whole number is unknown. unknown: `drop` leaves unknown tokens out,
    `reject` leaves out each query that has one. Queries are told apart by `qid` and the
    other columns.
    """
    if unknown not in ("drop", "reject"):
        raise ValueError(f"unknown policy: {unknown}")
    queries = split_lines(lines, column, most_chars)
    keys = [c for c in queries.columns if c != "content"]
    toks = queries.select(*keys, F.explode(F.split("content", " ", -1)).alias("term"))
    if dictionary is None:
        mapped = toks.withColumn("term_id", F.col("term").try_cast("bigint"))
    else:
        mapped = toks.join(dictionary.select("term", "term_id"), "term", "left")
    counted = mapped.groupBy(*keys, "term_id").agg(F.count("*").alias("f_qt"))
    if unknown == "reject":
        bad = counted.filter("term_id IS NULL").select(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"__{k}") for k in keys))
        same = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) == F.col(f"__{k}") for k in keys]
        counted = counted.join(bad, same, "left_anti")
    return counted.filter("term_id IS NOT NULL")


def rejected(lines: DataFrame, dictionary: DataFrame | None, column: str = "line", most_chars: int | None = MOST_LINE_CHARS) -> DataFrame:
    """(other columns, qid, error): the queries that policy `reject` leaves out, and why, and a row for each line that can't be read."""
    queries = split_lines(lines, column, most_chars)
    keys = [c for c in queries.columns if c != "content"]
    kept = parse(lines, dictionary, "reject", column, most_chars).select(*keys).distinct()
    unknown = queries.select(*keys).distinct().join(kept, keys, "left_anti").withColumn("error", F.lit("unknown term"))
    return unknown.unionByName(unreadable(lines, column, most_chars).drop(column))


def in_order(lines: DataFrame, dictionary: DataFrame | None, column: str = "line") -> DataFrame:
    """(other columns, qid, ids): the term ids of each query in the order of its line, without the queries that have an unknown token."""
    queries = split_lines(lines, column, None)
    keys = [c for c in queries.columns if c != "content"]
    toks = queries.select(*keys, F.posexplode(F.split("content", " ", -1)).alias("at", "term"))
    mapped = toks.withColumn("term_id", F.col("term").try_cast("bigint")) if dictionary is None else toks.join(dictionary.select("term", "term_id"), "term", "left")
    each = mapped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "term_id"))).alias("ids"))  # a line's tokens
    return each.filter(~F.exists("ids", lambda x: x["term_id"].isNull())).withColumn("ids", F.transform("ids", lambda x: x["term_id"]))


def premapped(lines: DataFrame, dictionary: DataFrame, column: str = "line") -> DataFrame:
    """(other columns, line): the lines as a client sends them to a service of ids, `qid;id id ...`; queries with an unknown token are left out."""
    told = in_order(lines, dictionary, column)
    others = [c for c in lines.columns if c != column]
    return told.select(*others, F.concat_ws(";", F.col("qid").cast("string"), F.array_join(F.col("ids").cast("array<string>"), " ")).alias(column))


def units(query_token: DataFrame, phrases: bool = True) -> DataFrame:
    """(collection, qid, unit, f_qt): what each parsed query looks for, a unit being an array of term ids.

    Distinct rows count; a null `f_qt` is one. Null and empty tokens, null ids and separators
    (0 and 1) are left out, equal units of a query are added up. Without `phrases` only
    units of one id stay.
    """
    rows = query_token.select("collection", "qid", "tok_pos", "token_ids", "f_qt").dropDuplicates()
    usable = (F.size("token_ids") > 0) & ~F.exists("token_ids", lambda x: x.isNull() | (x < 2))
    if not phrases:
        usable &= F.size("token_ids") == 1
    return rows.filter(usable).groupBy("collection", "qid", F.col("token_ids").alias("unit")).agg(F.sum(F.coalesce("f_qt", F.lit(1))).alias("f_qt"))


def sample(queries: DataFrame, n: int, seed: int = 4711) -> DataFrame:
    """(collection, qid, term_ids): `n` queries of each collection drawn by a hash, with their distinct term ids in order."""
    ids = queries.groupBy("collection", "qid").agg(F.sort_array(F.collect_set("term_id")).alias("term_ids"))
    order = Window.partitionBy("collection").orderBy(F.md5(F.concat_ws(" ", F.col("qid").cast("string"), F.lit(str(seed)))), "qid")
    return ids.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= n).drop("i")
