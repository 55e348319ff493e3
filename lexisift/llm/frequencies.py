"""How often every distinct value occurs, and in how many records."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisift.llm.burst_trie import CONTAINER, BurstTrie, decided, route
from lexisift.operators.checkpoints import cut

#: A task counts so many rows at once before they go into its tries.
CHUNK_ROWS = 500_000
#: A task sends its tries on when they hold so many terms.
HELD_TERMS = 2_000_000
#: A prefix with more entries than this, over all tasks, is split by its next character ...
ROUTE_ENTRIES = 100_000
#: ... or, beyond ROUTE_ENTRIES * MOST_ROUTES entries in all, with more than the total / MOST_ROUTES: this bounds the table of prefixes.
MOST_ROUTES = 65_536

_GROUP = "__group"
_SUBTREE = T.StructType(
    [
        T.StructField(_GROUP, T.StringType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("rests", T.ArrayType(T.StringType())),
        T.StructField("occurrences", T.ArrayType(T.LongType())),
        T.StructField("records", T.ArrayType(T.LongType())),
    ]
)
_COUNTED = T.StructType([T.StructField(_GROUP, T.StringType()), T.StructField("term", T.StringType()), T.StructField("occurrences", T.LongType()), T.StructField("records", T.LongType())])
_LISTS = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _subtrees(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _LISTS)], names=_SUBTREE.names)


def _local(batches: Iterator[pa.RecordBatch], chunk_rows: int, held_terms: int, container: int) -> Iterator[pa.RecordBatch]:
    """One trie per group over a task's rows; gives its containers."""
    tries: dict[str, BurstTrie] = defaultdict(lambda: BurstTrie(limit=container))
    held, n, terms = [], 0, 0

    def into_tries() -> int:
        t = pa.Table.from_batches(held).group_by([_GROUP, "term"], use_threads=False).aggregate([("occurrences", "sum"), ("occurrences", "count")])
        for g, term, o, r in zip(*(t.column(c).to_pylist() for c in (_GROUP, "term", "occurrences_sum", "occurrences_count"))):
            tries[g].add(term, o, r)
        return t.num_rows

    def out() -> Iterator[pa.RecordBatch]:
        rows = []
        for g, trie in tries.items():
            for c in trie.containers():
                rows.append((g, *c))
                if len(rows) == 2000:
                    yield _subtrees(rows)
                    rows = []
        if rows:
            yield _subtrees(rows)
        tries.clear()

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= chunk_rows:
            terms += into_tries()
            held, n = [], 0
            if terms >= held_terms:
                yield from out()
                terms = 0
    if n:
        into_tries()
    yield from out()


def _branches(subtrees: DataFrame) -> dict[str, int]:
    """For each prefix with too many entries for one route, how many characters all its containers' prefixes share.

    Level by level: the prefixes that are too large are counted by the character behind the
    shared ones, so that characters that don't branch cost nothing, however many they are. A
    level is one pass over the containers' prefixes. The driver receives the large prefixes only.
    """
    sizes = cut(subtrees.groupBy("prefix").agg(F.sum(F.size("rests")).alias("n")))
    all_ = sizes.agg(F.sum("n").alias("n"), F.min("prefix").alias("low"), F.max("prefix").alias("high")).first()
    limit = max(ROUTE_ENTRIES, (all_["n"] or 0) // MOST_ROUTES)
    found: dict[str, int] = {}
    large = {"": all_} if (all_["n"] or 0) > limit else {}
    while large:
        found |= {prefix: len(commonprefix([r["low"], r["high"]])) for prefix, r in large.items()}
        frontier = {p: found[p] for p in large}

        def below(batches: Iterator[pa.RecordBatch], branches=dict(found), frontier=frontier) -> Iterator[pa.RecordBatch]:
            for b in batches:
                prefixes, counts = b.column(0).to_pylist(), b.column(1).to_pylist()
                to = [decided(p, branches) for p in prefixes]
                rows = [(t, p, n) for t, p, n in zip(to, prefixes, counts) if t is not None and _parent(t, branches) in frontier]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["child", "prefix", "n"])

        counted = sizes.mapInArrow(below, "child string, prefix string, n bigint").groupBy("child").agg(F.sum("n").alias("n"), F.min("prefix").alias("low"), F.max("prefix").alias("high"))
        large = {r["child"]: r for r in counted.filter(F.col("n") > limit).collect()}
    return found


def _parent(to: str, branches: dict[str, int]) -> str:
    """The prefix in `branches` that the route `to` comes from."""
    at = ""
    while (following := to[: branches[at] + 1]) != to:
        at = following
    return at


def count_terms(rows: DataFrame, keys: Sequence[str], term: str = "term", occurrences: str = "occurrences") -> DataFrame:
    """(keys, term, occurrences, records): the sums over `rows` for every distinct term.

    rows: one row per group, term and record, with how often the record has the term; the
    keys are strings without the sign U+001F, other columns are ignored. Rows with a null term don't count, a null
    number of occurrences is none of them but still a record. Terms are compared as
    strings, exactly.

    Each task counts its rows in burst tries. Their containers are subtrees that are sent
    by adaptive prefix: a prefix with many entries over all tasks is split by its next
    character. A worker merges the matching subtrees of one route at a time. A term that
    holds most rows is one entry of each task.
    """
    group = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(k)), F.lit("n")) for k in keys)) if keys else F.lit("v")
    told = rows.filter(F.col(term).isNotNull()).select(group.alias(_GROUP), F.col(term).cast("string").alias("term"), F.coalesce(F.col(occurrences), F.lit(0)).cast("bigint").alias("occurrences"))
    limits = CHUNK_ROWS, HELD_TERMS, CONTAINER
    subtrees = cut(told.mapInArrow(lambda batches: _local(batches, *limits), _SUBTREE))
    branches = _branches(subtrees)
    routed_type = T.StructType([T.StructField("route", T.StringType()), *_SUBTREE.fields])

    def by_route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for g, prefix, rests, os, rs in zip(*(c.to_pylist() for c in b.columns)):
                whole = decided(prefix, branches)
                if whole is not None:
                    rows.append((whole, g, prefix, rests, os, rs))
                    continue
                parts: dict[str, tuple[list, list, list]] = {}
                for rest, o, r in zip(rests, os, rs):
                    part = parts.setdefault(route(prefix + rest, branches), ([], [], []))
                    for column, x in zip(part, (rest, o, r)):
                        column.append(x)
                rows += [(to, g, prefix, *part) for to, part in parts.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.string(), *_LISTS])], names=routed_type.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(g: str, trie: BurstTrie) -> Iterator[pa.RecordBatch]:
            for prefix, rests, os, rs in trie.containers():
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(rests)), pa.array([prefix + r for r in rests]), pa.array(os, pa.int64()), pa.array(rs, pa.int64())], names=_COUNTED.names)

        def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for p in parts:
                held.append(p)
                n += p.num_rows
                if n >= 20_000:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, n = [], 0
            if n:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        def all_parts() -> Iterator[pa.RecordBatch]:
            now, trie = None, None
            for b in batches:
                for to, g, prefix, rests, os, rs in zip(*(c.to_pylist() for c in b.columns)):
                    if (to, g) != now:
                        if trie is not None:
                            yield from counted(now[1], trie)
                        now, trie = (to, g), BurstTrie(to, limits[2])
                    trie.extend((prefix + r for r in rests), os, rs)
            if trie is not None:
                yield from counted(now[1], trie)

        yield from joined(all_parts())

    routed = subtrees.mapInArrow(by_route, routed_type).repartition(_GROUP, "route").sortWithinPartitions("route", _GROUP)
    counted = routed.mapInArrow(merge, _COUNTED)
    parts = F.split(_GROUP, "\x1f")
    named = [F.when(F.substring(parts[i], 1, 1) == "v", F.expr(f"substring(split({_GROUP}, '\x1f')[{i}], 2)")).alias(k) for i, k in enumerate(keys)]
    return counted.select(*named, "term", "occurrences", "records")


def in_texts(postings: DataFrame) -> DataFrame:
    """(collection, term_id, record, occurrences), a row per document and term, of distinct postings.

    Separators (ids 0 and 1) are no terms. Rows are spread by term and document, so that a
    long list is spread over all tasks.
    """
    rows = postings.select("collection", "term_id", F.col("doc_id").alias("record"), F.col("f_dt").alias("occurrences")).filter("term_id > 1 AND record IS NOT NULL")
    return rows.repartition("collection", "term_id", "record").dropDuplicates().groupBy("collection", "term_id", "record").agg(F.sum("occurrences").alias("occurrences"))


def in_queries(tokens: DataFrame) -> DataFrame:
    """(collection, term_id, record, occurrences), a row per query and term, of distinct token rows.

    Each id of a token occurs `f_qt` times, once where that is null. Null and empty tokens,
    null ids and separators count for nothing.
    """
    rows = tokens.select("collection", "qid", "tok_pos", "token_ids", "token_strs", "f_qt").filter("qid IS NOT NULL").dropDuplicates()
    each = rows.select("collection", F.explode("token_ids").alias("term_id"), F.col("qid").alias("record"), F.coalesce("f_qt", F.lit(1)).alias("occurrences"))
    return each.filter("term_id > 1").groupBy("collection", "term_id", "record").agg(F.sum("occurrences").alias("occurrences"))


def both_sides(postings: DataFrame, tokens: DataFrame) -> DataFrame:
    """(collection, side, term_id, occurrences, records) over texts and queries. Empty tables give no rows."""
    sides = in_texts(postings).withColumn("side", F.lit("text")).unionByName(in_queries(tokens).withColumn("side", F.lit("query")))
    counted = count_terms(sides.withColumn("term", F.col("term_id").cast("string")), ["collection", "side"])
    return counted.select("collection", "side", F.col("term").cast("bigint").alias("term_id"), "occurrences", "records")


def marked(frequencies: DataFrame, documents: DataFrame, tokens: DataFrame, rare: int = 2, common: float = 0.2) -> DataFrame:
    """(collection, side, term_id, mark): terms with at most `rare` occurrences, or in more than `common` of the records.

    frequencies: as of both_sides(). A term can have both marks. A collection that has no
    documents, or no queries, has no common terms on that side.
    """
    texts = documents.filter("doc_id IS NOT NULL").groupBy("collection").agg(F.count_distinct("doc_id").alias("of")).withColumn("side", F.lit("text"))
    queries = tokens.groupBy("collection").agg(F.count_distinct("qid").alias("of")).withColumn("side", F.lit("query"))
    with_n = frequencies.join(texts.unionByName(queries), ["collection", "side"], "left")
    marks = F.filter(F.array(F.when(F.col("occurrences") <= rare, "rare"), F.when(F.col("records") > common * F.col("of"), "common")), lambda m: m.isNotNull())
    return with_n.select("collection", "side", "term_id", F.explode(marks).alias("mark"))
