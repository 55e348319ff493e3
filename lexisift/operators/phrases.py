"""Phrases: where they occur, and how a query is cut into them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexisift.operators.checkpoints import cut
from lexisift.operators.search import BROADCAST_UNITS, meet, of_terms
from lexisift.operators.skew import skew_join
from lexisift.operators.spans import count_in_texts

_UNIT = ["collection", "unit"]
_PLACE = [*_UNIT, "doc_id"]
_TERM = ["collection", "term_id"]


def phrase_postings(positions: DataFrame, terms: DataFrame, phrases: DataFrame) -> DataFrame:
    """(collection, unit, doc_id, f_dt, w_d): the documents that hold each phrase, and how often, overlaps included. Computed once.

    positions: (collection, term_id, doc_id, positions, w_d), where each term stands in each
    document, in ascending order; terms: (collection, term_id, dfreq, ...), their statistics;
    phrases: (collection, unit), a unit being an array of term ids of any length from 1. A
    phrase with a null id, or one that occurs nowhere, has no row. No text is read.

    A phrase starts from its rarest term: the documents of that one, with the places where the
    phrase would begin, are found first. They meet the positions of its other terms, and
    those beginnings stay that all terms agree on. Terms and documents are met as in a search.
    """
    units = phrases.select("collection", "unit").filter((F.size("unit") > 0) & ~F.exists("unit", lambda x: x.isNull())).distinct()
    steps = units.select("collection", "unit", F.posexplode("unit").alias("i", "term_id"))
    each = Window.partitionBy("collection", "unit")
    counted = meet(terms.select(*_TERM, "dfreq"), steps, _TERM, steps.count())
    whole = counted.withColumn("n", F.count("*").over(each)).filter(F.col("n") == F.size("unit"))  # every id occurs
    ranked = cut(whole.withColumn("rarity", F.row_number().over(each.orderBy("dfreq", "i"))).withColumn("unit", F.array_join("unit", " ")).select("collection", "unit", "term_id", "i", "n", "rarity"))
    size = ranked.count()

    def begins(of: DataFrame, name: str) -> DataFrame:
        told = meet(of_terms(positions, of).select(*_TERM, "doc_id", "positions", "w_d"), of, _TERM, size)
        return told.select(*_PLACE, "w_d", "n", F.transform("positions", lambda p: (p - F.col("i")).cast("int")).alias(name))

    first = cut(begins(ranked.filter("rarity = 1"), "begins"))
    rest = ranked.filter("rarity > 1")
    needed = first.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    if needed <= BROADCAST_UNITS:  # only the rarest term's documents are looked up in the other lists
        told = first.select(*_PLACE).join(rest.select(*_UNIT, "term_id", "i"), _UNIT)
        looked_up = of_terms(positions, rest).select(*_TERM, "doc_id", "positions").join(F.broadcast(told), [*_TERM, "doc_id"])
        others = looked_up.select(*_PLACE, F.transform("positions", lambda p: (p - F.col("i")).cast("int")).alias("more"))
    else:
        others = begins(rest, "more").select(*_PLACE, "more")
    both = first.select(*_PLACE, "w_d", "n", "begins", F.lit(None).cast("array<int>").alias("more")).unionByName(
        others.select(*_PLACE, F.lit(None).cast("int").alias("w_d"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<int>").alias("begins"), "more")
    )
    met = both.groupBy(*_PLACE).agg(F.max("w_d").alias("w_d"), F.max("n").alias("n"), F.first("begins", True).alias("begins"), F.collect_list("more").alias("more"))
    agreed = met.filter(F.size("more") == F.col("n") - 1).withColumn("begins", F.aggregate("more", F.col("begins"), F.array_intersect))
    ids = F.split("unit", " ").cast("array<bigint>")
    return cut(agreed.filter(F.size("begins") > 0).select("collection", ids.alias("unit"), "doc_id", F.size("begins").cast("bigint").alias("f_dt"), F.col("w_d").cast("bigint").alias("w_d")))


def segment(ids: Sequence[int], count: Callable[[int, int], int], size: int, threshold: float) -> list[tuple[int, int]]:
    """`ids` cut into phrases from left to right: (begin, end) of each part, end excluded.

    count(b, e): occurrences of ids[b:e] in the collection of `size` symbols. From a start
    that isn't a very common word (above 1 % of the symbols), the span grows; its
    association is ln P(span) - ln(P(last) * product of P(each)), the last word counting
    twice. A span under the threshold after one that reached it ends the phrase before
    its last word; under it from the beginning, the span goes on growing. A span that
    occurs nowhere is under any threshold.
    """
    parts, start, n = [], 0, len(ids)

    def ratio(b: int, e: int) -> float:
        joint, singles = count(b, e), [count(i, i + 1) for i in range(b, e)]
        if not joint or not all(singles):
            return -math.inf
        return math.log(joint / size) - sum(math.log(n / size) for n in singles) - math.log(singles[-1] / size)

    while start < n:
        reached, end = False, None
        if count(start, start + 1) * 100 <= size:
            for last in range(start + 1, n):
                if ratio(start, last + 1) >= threshold:
                    reached = True
                elif reached:
                    end = last
                    break
        if end is None:
            end = n if reached else start + 1
        parts.append((start, end))
        start = end
    return parts


def spans(queries: DataFrame) -> DataFrame:
    """(collection, unit): every run of neighbouring ids of the queries (collection, qid, ids), distinct."""
    begins = queries.filter(F.size("ids") > 0).select("collection", "ids", F.explode(F.sequence(F.lit(1), F.size("ids"))).alias("b"))
    runs = begins.select("collection", "ids", "b", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("b") + 1)).alias("n"))
    return runs.select("collection", F.slice("ids", F.col("b"), F.col("n")).alias("unit")).distinct()


def count_spans(queries: DataFrame, positions: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(collection, unit, n): how often each span of the queries (collection, qid, ids) that segment() asks for occurs, those that do.

    Single ids are told by the statistics. Longer spans that begin with a very common word are
    never asked for. Of the others, pairs are counted, then those longer spans whose
    neighbours, as far as they were counted, all occur together somewhere: few of the many.
    """
    wanted = cut(spans(queries))
    one = wanted.filter(F.size("unit") == 1).withColumn("term_id", F.col("unit")[0])
    counts = cut(meet(terms.select(*_TERM, F.col("cfreq").alias("n")), one, _TERM, one.count()).select("collection", "unit", "n"))
    begins = counts.join(stats.select("collection", "n_symbols"), "collection").filter(F.col("n") * 100 <= F.col("n_symbols")).select("collection", F.col("unit")[0].alias("first"))
    asked = cut(wanted.filter(F.size("unit") > 1).withColumn("first", F.col("unit")[0]).join(begins, ["collection", "first"]).drop("first"))

    def counted(of: DataFrame) -> DataFrame:
        return cut(phrase_postings(positions, terms, of).groupBy("collection", "unit").agg(F.sum("f_dt").alias("n")))

    pairs = counted(asked.filter(F.size("unit") == 2))
    neighbours = F.transform(F.sequence(F.lit(1), F.size("unit") - 1), lambda i: F.slice("unit", i, 2))
    each = asked.filter(F.size("unit") > 2).select("collection", "unit", F.explode(neighbours).alias("pair")).withColumn("first", F.col("pair")[0])
    due = each.join(begins, ["collection", "first"]).join(pairs.select("collection", F.col("unit").alias("pair"), "n"), ["collection", "pair"], "left")
    possible = due.groupBy("collection", "unit").agg(F.count_if(F.col("n").isNull()).alias("missing")).filter("missing = 0").select("collection", "unit")
    return counts.unionByName(pairs).unionByName(counted(possible))


def segment_queries(queries: DataFrame, positions: DataFrame, terms: DataFrame, stats: DataFrame, threshold: float = 10.0) -> DataFrame:
    """(collection, qid, unit, f_qt): the phrases that each query (collection, qid, ids) is cut into, equal ones counted together.

    queries may have a column `threshold` of their own, which holds where it isn't null.
    Only spans of these queries are counted, from positions and terms as of phrase_postings();
    the cutting runs where each query's counts are. A query's spans grow with the square of
    its length. stats: (collection, n_symbols, ...).
    """
    asked = _asked(queries, threshold)
    return _segmented(asked, count_spans(asked, positions, terms, stats), stats)


def segment_in_texts(queries: DataFrame, documents: DataFrame, dictionary: DataFrame, threshold: float = 10.0) -> DataFrame:
    """As segment_queries(), counted in the texts of documents (collection, doc_id, text) with dictionary (term, term_id), without an index.

    For large batches: the texts are read once for all spans, whatever their number up to
    spans.TREE_IDS, and nothing is written for a document.
    """
    asked = cut(_asked(queries, threshold))
    return _segmented(asked, *count_in_texts(asked, documents, dictionary))


def _asked(queries: DataFrame, threshold: float) -> DataFrame:
    own = F.coalesce(F.col("threshold") if "threshold" in queries.columns else F.lit(None), F.lit(threshold)).cast("double").alias("threshold")
    return queries.filter(F.size("ids") > 0).select("collection", "qid", "ids", own)


def _segmented(asked: DataFrame, counts: DataFrame, stats: DataFrame) -> DataFrame:
    """`asked` cut by counts (collection, unit, n) of its spans; spans without a row occur nowhere."""
    begins = asked.select("*", F.explode(F.sequence(F.lit(1), F.size("ids"))).alias("b"))
    runs = begins.select("*", F.explode(F.sequence(F.col("b") + 1, F.size("ids") + 1)).alias("e"))
    counted = runs.withColumn("unit", F.slice("ids", F.col("b"), F.col("e") - F.col("b"))).join(counts, ["collection", "unit"], "left")
    per_query = counted.groupBy("collection", "qid", "ids", "threshold").agg(F.collect_list(F.struct("b", "e", F.coalesce("n", F.lit(0)).alias("n"))).alias("counts"))
    told = per_query.join(stats.select("collection", "n_symbols"), "collection")

    def parted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for collection, qid, ids, least, found, size in zip(f["collection"], f["qid"], f["ids"], f["threshold"], f["counts"], f["n_symbols"]):
                n_of = {(x["b"] - 1, x["e"] - 1): x["n"] for x in found}
                parts = segment(ids, lambda b, e, n_of=n_of: n_of[b, e], size, least)
                rows += [(collection, qid, list(map(int, ids[b:e]))) for b, e in parts]
            yield pd.DataFrame(rows, columns=["collection", "qid", "unit"])

    parts = told.mapInPandas(parted, "collection string, qid bigint, unit array<bigint>")
    return parts.groupBy("collection", "qid", "unit").agg(F.count("*").alias("f_qt"))


def bigram_association(grams: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(collection, first, second, n_occurrences, association) by the measure that segment() uses.

    grams: (collection, first, second, n), counts of terms, `second` being null, and of
    neighbouring pairs, as of analyze.terms_and_pairs(); read several times. n_docs:
    (collection, n_docs).
    """
    one = grams.filter("second IS NULL")
    sizes = one.groupBy("collection").agg(F.sum("n").alias("n_terms")).join(n_docs, "collection").select("collection", (F.col("n_terms") + F.col("n_docs") + 1).alias("n_symbols"))
    pairs = grams.filter("second IS NOT NULL").select("collection", "first", "second", F.col("n").alias("n_occurrences"))
    rows = skew_join(skew_join(pairs, one.select("collection", "first", F.col("n").alias("n_first")), ["collection", "first"]), one.select("collection", F.col("first").alias("second"), F.col("n").alias("n_second")), ["collection", "second"])
    p = lambda c: F.ln(F.col(c) / F.col("n_symbols"))
    return rows.join(sizes, "collection").select("collection", "first", "second", "n_occurrences", F.round(p("n_occurrences") - p("n_first") - 2 * p("n_second"), 6).alias("association"))
