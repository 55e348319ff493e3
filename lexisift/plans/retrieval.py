"""Queries on collections and ranked retrieval, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.operators import analyze, phrases, querying
from lexisift.operators import search as searching
from lexisift.operators.checkpoints import written
from lexisift.plans.indexes import opened
from lexisift.sources import exports
from lexisift.sources.tables import spread, table

K = 10


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def units(spark: SparkSession, d: str, with_phrases: bool = False) -> DataFrame:
    return querying.units(table(spark, d, "query_token"), with_phrases)


def _search(ranker: str, mode: str, k: int = K, with_phrases: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: opened(spark, d).search(units(spark, d, with_phrases), k, ranker, mode, with_phrases)


def doc_lengths(spark, d):
    return analyze.doc_lengths(_documents(spark, d))


def collection_info(spark, d):
    return analyze.collection_info(_documents(spark, d))


def collection_stats(spark, d):
    sizes = analyze.collection_stats(analyze.doc_lengths(_documents(spark, d)))
    return sizes.withColumn("avgdl", F.round("avgdl", 6))


def postings(spark, d):
    return analyze.postings(_documents(spark, d))


def term_stats(spark, d):
    return analyze.term_stats(postings(spark, d))


def doc_frequency(spark, d):
    return term_stats(spark, d).select("collection", "term", "dfreq")


def collection_frequency(spark, d):
    return term_stats(spark, d).select("collection", "term", "cfreq")


def max_tf(spark, d):
    return term_stats(spark, d).select("collection", "term", "max_tf")


def list_max_score(spark, d):
    c = opened(spark, d)
    return searching.list_bounds(c.postings, c.terms, c.stats).select("collection", "term_id", "max_score")


def max_doc_weight(spark, d):
    c = opened(spark, d)
    return searching.list_bounds(c.postings, c.terms, c.stats, "lmds").select("collection", "term_id", "max_doc_weight")


def length_histogram(spark, d):
    return analyze.length_histogram(doc_lengths(spark, d))


def length_rank(spark, d):
    return analyze.length_ranks(doc_lengths(spark, d))


def distinct_docs_per_term(spark, d):
    return postings(spark, d).select("collection", "term", "doc_id")


def repetition_counts(spark, d):
    return postings(spark, d).filter("f_dt > 1").select("collection", "term", "doc_id", (F.col("f_dt") - 1).alias("repetitions"))


def query_lines(spark, d):
    """(collection, line): the queries as the lines they were parsed from; null tokens are a word that no dictionary has."""
    rows = table(spark, d, "query_token").select("collection", "qid", "tok_pos", "token_ids", "token_strs", "f_qt").filter("qid IS NOT NULL").dropDuplicates()
    text = F.coalesce(F.array_join("token_strs", " "), F.lit("?"))
    toks = F.array_sort(F.collect_list(F.struct("tok_pos", text.alias("t"))))
    per_query = rows.groupBy("collection", "qid").agg(F.transform(toks, lambda x: x["t"]).alias("ts"))
    return per_query.select("collection", F.concat_ws(";", F.col("qid").cast("string"), F.array_join("ts", " ")).alias("line"))


def query_parse(spark, d):
    return querying.split_lines(query_lines(spark, d), most_chars=None)


def query_unknown_drop(spark, d):
    return querying.parse(query_lines(spark, d), table(spark, d, "term_dict"), "drop", most_chars=None)


def query_unknown_reject(spark, d):
    return querying.parse(query_lines(spark, d), table(spark, d, "term_dict"), "reject", most_chars=None)


def query_errors(spark, d):
    return querying.rejected(query_lines(spark, d), table(spark, d, "term_dict"), most_chars=None)


def query_normalise(spark, d):
    return query_lines(spark, d).select("collection", "line", analyze.normalise_query(F.col("line")).alias("normalised"))


def query_units(spark, d):
    return units(spark, d, True).select("collection", "qid", searching.unit_key(F.col("unit")).alias("unit"), "f_qt")


def query_sample(spark, d):
    """100 queries of each collection by a hash, with their distinct term ids in order."""
    drawn = querying.sample(query_unknown_drop(spark, d), 100)
    return drawn.select("collection", "qid", F.array_join("term_ids", " ").alias("term_ids"))


def _candidates(spark, d, mode, with_phrases=False):
    return opened(spark, d).candidates(units(spark, d, with_phrases), "freq", mode, with_phrases).drop("score")


def candidate_union(spark, d):
    return _candidates(spark, d, "or")


def candidate_intersection(spark, d):
    return _candidates(spark, d, "and")


def phrase_candidate_union(spark, d):
    return _candidates(spark, d, "or", with_phrases=True)


def phrase_candidate_intersection(spark, d):
    return _candidates(spark, d, "and", with_phrases=True)


def phrase_postings(spark, d):
    return opened(spark, d).phrase_lists(units(spark, d, True)).select("collection", searching.unit_key(F.col("unit")).alias("unit"), "doc_id", "f_dt")


def bigram_counts(spark, d):
    return analyze.ngrams(_documents(spark, d), 2).select("collection", F.array_join("gram", " ").alias("gram"), "n_occurrences")


def bigram_association(spark, d):
    documents = _documents(spark, d)
    n_docs = documents.filter("doc_id IS NOT NULL").groupBy("collection").agg(F.count("*").alias("n_docs"))
    return phrases.bigram_association(written(analyze.terms_and_pairs(documents)), n_docs)


def query_ids(spark, d):
    """(collection, qid, ids): every query's term ids in order."""
    rows = table(spark, d, "query_token").select("collection", "qid", "tok_pos", "token_ids").filter((F.size("token_ids") > 0) & ~F.exists("token_ids", lambda x: x.isNull() | (x < 2))).dropDuplicates()
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tok_pos", "token_ids"))), lambda x: x["token_ids"]))
    return rows.groupBy("collection", "qid").agg(ids.alias("ids"))


def phrase_segmentation(spark, d):
    """Every query's ids in order, cut into phrases. All spans of all queries are counted in one reading of the texts, without the index."""
    found = phrases.segment_in_texts(query_ids(spark, d), _documents(spark, d), table(spark, d, "term_dict"), threshold=2.0)
    return found.select("collection", "qid", searching.unit_key(F.col("unit")).alias("unit"), "f_qt")


def profile_counters(spark, d):
    return opened(spark, d).profile(units(spark, d))


def phrase_profile_counters(spark, d):
    """profile_counters of whole queries: phrases are units too, so that queries of nothing else have a row."""
    return opened(spark, d).profile(units(spark, d, True), with_phrases=True)


def result_names(spark, d):
    return exports.with_names(bm25_or(spark, d), _documents(spark, d)).select("collection", "qid", "rank", "doc_id", "name")


def trec_run(spark, d):
    return exports.trec_rows(bm25_or(spark, d), _documents(spark, d), tag="bm25")


def doc_extract(spark, d):
    return exports.extract(_documents(spark, d), bm25_or(spark, d))


def phrase_result_names(spark, d):
    return exports.with_names(phrase_bm25(spark, d), _documents(spark, d)).select("collection", "qid", "rank", "doc_id", "name")


def phrase_trec_run(spark, d):
    return exports.trec_rows(phrase_bm25(spark, d), _documents(spark, d), tag="bm25")


def phrase_doc_extract(spark, d):
    return exports.extract(_documents(spark, d), phrase_bm25(spark, d))


bm25_or, bm25_and, phrase_bm25 = _search("bm25", "or"), _search("bm25", "and"), _search("bm25", "or", with_phrases=True)
QUERIES = {
    f.__name__: f
    for f in (
        doc_lengths, collection_info, collection_stats, postings, term_stats, doc_frequency, collection_frequency, max_tf, list_max_score, max_doc_weight,
        length_histogram, length_rank, distinct_docs_per_term, repetition_counts, query_lines, query_parse, query_unknown_drop, query_unknown_reject, query_errors,
        query_normalise, query_units, query_sample, candidate_union, candidate_intersection, phrase_postings, bigram_counts, bigram_association, phrase_segmentation,
        profile_counters, result_names, trec_run, doc_extract,
        phrase_candidate_union, phrase_candidate_intersection, phrase_profile_counters, phrase_result_names, phrase_trec_run, phrase_doc_extract,
    )
} | {f"{ranker}_{mode}": _search(ranker, mode) for ranker in ("bm25", "bm25_simple_est", "lmds", "tfidf", "freq") for mode in ("or", "and")} | {
    f"phrase_{ranker}": _search(ranker, "or", with_phrases=True) for ranker in ("bm25", "bm25_simple_est", "lmds", "tfidf", "freq")
} | {
    f"phrase_{ranker}_and": _search(ranker, "and", with_phrases=True) for ranker in ("bm25", "bm25_simple_est", "lmds", "tfidf", "freq")
} | {"topk_single": _search("bm25", "or", k=1), "topk_100": _search("bm25", "or", k=100)} | {
    f"phrase_topk_{name}": _search("bm25", "or", k=k, with_phrases=True) for name, k in (("single", 1), ("100", 100))
}

_TOKS = r"""toks AS (SELECT collection, doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos
  FROM (SELECT collection, doc_id, regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[\p{L}\p{N}]+') AS terms FROM documents WHERE doc_id IS NOT NULL))"""
_LEN = f"""{_TOKS}, len AS (SELECT d.collection, d.doc_id, count(t.pos) + 1 AS w_d FROM documents d LEFT JOIN toks t ON t.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL GROUP BY 1, 2)"""
_POST = f"{_TOKS}, post AS (SELECT collection, term, doc_id, count(*) AS f_dt FROM toks GROUP BY 1, 2, 3)"
_TERM = f"{_POST}, ts AS (SELECT collection, term, count(*) AS dfreq, CAST(sum(f_dt) AS BIGINT) AS cfreq, max(f_dt) AS max_tf FROM post GROUP BY 1, 2)"
_STATS = "stats AS (SELECT collection, count(*) AS n_docs, CAST(sum(w_d) + 1 AS BIGINT) AS n_symbols, (sum(w_d) + 1) / count(*) AS avgdl, min(w_d) AS min_w_d FROM len GROUP BY 1)"
_LISTS = "lists AS (SELECT DISTINCT collection, term_id, doc_id, f_dt FROM postings WHERE term_id > 1 AND doc_id IS NOT NULL AND f_dt IS NOT NULL)"
_LEN2 = """len AS (SELECT d.collection, d.doc_id, CAST(coalesce(sum(l.f_dt), 0) + 1 AS BIGINT) AS w_d
  FROM documents d LEFT JOIN lists l ON l.doc_id = d.doc_id AND l.collection = d.collection WHERE d.doc_id IS NOT NULL GROUP BY 1, 2)"""
_INPUTS = f"{_LISTS}, {_LEN2}, {_STATS}"
_LINES = """lines AS (SELECT collection, CAST(qid AS VARCHAR) || ';' || string_agg(coalesce(array_to_string(token_strs, ' '), '?'), ' ' ORDER BY tok_pos, coalesce(array_to_string(token_strs, ' '), '?')) AS line
  FROM (SELECT DISTINCT collection, qid, tok_pos, token_ids, token_strs, f_qt FROM query_token WHERE qid IS NOT NULL) GROUP BY collection, qid)"""
_PARSED = f"""{_LINES}, split AS (SELECT collection, CAST(split_part(line, ';', 1) AS BIGINT) AS qid, line[strpos(line, ';') + 1:] AS content FROM lines WHERE length(line) < 1024),
  qt AS (SELECT collection, qid, t.term, dict.term_id FROM (SELECT collection, qid, unnest(string_split(content, ' ')) AS term FROM split) t LEFT JOIN term_dict dict ON dict.term = t.term)"""


def _units_sql(with_phrases: bool) -> str:
    return f"""uq AS (SELECT collection, qid, array_to_string(token_ids, ' ') AS unit, token_ids AS ids, CAST(sum(coalesce(f_qt, 1)) AS BIGINT) AS f_qt
  FROM (SELECT DISTINCT collection, qid, tok_pos, token_ids, f_qt FROM query_token)
  WHERE len(token_ids) {">= 1" if with_phrases else "= 1"} AND len(list_filter(token_ids, lambda x: x IS NULL OR x < 2)) = 0 GROUP BY 1, 2, 3, 4)"""


_PHRASES = f"""{_TOKS}, steps AS (SELECT collection, unit, len(ids) AS n, unnest(ids) AS term_id, generate_subscripts(ids, 1) - 1 AS i FROM (SELECT DISTINCT collection, unit, ids FROM uq WHERE len(ids) > 1)),
  votes AS (SELECT s.collection, s.unit, s.n, t.doc_id, t.pos - s.i AS begin FROM steps s JOIN term_dict d ON d.term_id = s.term_id JOIN toks t ON t.collection = s.collection AND t.term = d.term),
  pl AS (SELECT collection, unit, doc_id, count(*) AS f_dt FROM (SELECT collection, unit, n, doc_id, begin FROM votes GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = n) GROUP BY 1, 2, 3)"""


def _found_sql(with_phrases: bool) -> str:
    single = "SELECT DISTINCT u.collection, u.unit, l.doc_id, l.f_dt FROM uq u JOIN lists l ON l.collection = u.collection AND l.term_id = u.ids[1] WHERE len(u.ids) = 1"
    both = f"{single} UNION ALL SELECT collection, unit, doc_id, f_dt FROM pl" if with_phrases else single
    return f"""{_INPUTS}, {_units_sql(with_phrases)}{", " + _PHRASES if with_phrases else ""}, found AS ({both}),
  per AS (SELECT collection, unit, count(*) AS dfreq, sum(f_dt) AS cfreq FROM found GROUP BY 1, 2),
  fu AS (SELECT uq.collection, uq.qid, uq.unit, uq.f_qt, dfreq, cfreq, n_docs, n_symbols, avgdl, count(*) OVER (PARTITION BY uq.collection, uq.qid) AS n_found
    FROM uq JOIN per ON per.collection = uq.collection AND per.unit = uq.unit JOIN stats ON stats.collection = uq.collection),
  rows AS (SELECT fu.*, f.doc_id, f.f_dt, len.w_d FROM found f JOIN fu ON fu.collection = f.collection AND fu.unit = f.unit JOIN len ON len.doc_id = f.doc_id AND len.collection = f.collection)"""


_SCORES = {
    "bm25": ("greatest(1e-6, ln((n_docs - dfreq + 0.5) / (dfreq + 0.5)) * f_qt) * 2.2 * f_dt / (1.2 * (0.25 + 0.75 * w_d / avgdl) + f_dt)", "0"),
    "lmds": ("ln(1 + (f_dt / 2500.0) * (CAST(n_symbols AS DOUBLE) / cfreq))", "ln(2500.0 / (2500.0 + w_d))"),
    "tfidf": ("(1.0 / w_d) * (1 + ln(f_dt)) * ln(1 + CAST(n_docs AS DOUBLE) / dfreq)", "0"),
    "freq": ("CAST(f_dt AS DOUBLE)", "0"),
}
_SCORES["bm25_simple_est"] = _SCORES["bm25"]


def _ranked_sql(ranker: str, mode: str, k: int = K, with_phrases: bool = False) -> str:
    each, weight = _SCORES[ranker]
    return f"""{_found_sql(with_phrases)}, scored AS (SELECT collection, qid, doc_id, sum({each}) + any_value(n_found) * any_value({weight}) AS x FROM rows
    GROUP BY 1, 2, 3 {"HAVING count(*) = any_value(n_found)" if mode == "and" else ""}),
  ranked AS (SELECT collection, qid, row_number() OVER (PARTITION BY collection, qid ORDER BY round(x, 9) DESC, doc_id) AS rank, doc_id, round(x, 6) AS score FROM scored
    QUALIFY rank <= {k})"""


def _search_sql(*a, **b) -> str:
    return f"WITH {_ranked_sql(*a, **b)} SELECT * FROM ranked"


_BM25 = _ranked_sql("bm25", "or")
_PHRASE_BM25 = _ranked_sql("bm25", "or", with_phrases=True)
_SEGMENTS = """rows AS (SELECT DISTINCT collection, qid, tok_pos, token_ids FROM query_token WHERE len(token_ids) > 0 AND len(list_filter(token_ids, lambda x: x IS NULL OR x < 2)) = 0),
  q AS (SELECT collection, qid, flatten(list(token_ids ORDER BY tok_pos, token_ids)) AS ids FROM rows GROUP BY 1, 2),
  w AS (SELECT collection, qid, len(ids) AS n, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS i FROM q),
  size AS (SELECT d.collection, count(DISTINCT d.doc_id) + (SELECT count(*) FROM toks t WHERE t.collection = d.collection) + 1 AS n_symbols FROM documents d GROUP BY 1),
  tok AS (SELECT t.collection, t.doc_id, t.pos, d.term_id AS id FROM toks t JOIN term_dict d ON d.term = t.term),
  spans AS (SELECT w.collection, w.qid, w.i AS b, w.i + 1 AS e, t.doc_id, t.pos FROM w JOIN tok t ON t.collection = w.collection AND t.id = w.id
    UNION ALL SELECT s.collection, s.qid, s.b, s.e + 1, s.doc_id, s.pos + 1 FROM spans s JOIN w ON w.collection = s.collection AND w.qid = s.qid AND w.i = s.e
      JOIN tok t ON t.collection = s.collection AND t.doc_id = s.doc_id AND t.pos = s.pos + 1 AND t.id = w.id),
  seen AS (SELECT collection, qid, b, e, count(*) AS c FROM spans GROUP BY 1, 2, 3, 4),
  one AS (SELECT w.*, coalesce(c, 0) AS c, n_symbols FROM w JOIN size ON size.collection = w.collection LEFT JOIN seen s ON s.collection = w.collection AND s.qid = w.qid AND s.b = w.i AND s.e = w.i + 1),
  ratio AS (SELECT a.collection, a.qid, a.i AS b, z.i + 1 AS e, coalesce(ln(s.c / a.n_symbols)
      - (SELECT sum(ln(o.c / o.n_symbols)) FROM one o WHERE o.collection = a.collection AND o.qid = a.qid AND o.i BETWEEN a.i AND z.i AND o.c > 0) - ln(nullif(z.c, 0) / z.n_symbols), -1e300) AS x
    FROM one a JOIN one z ON z.collection = a.collection AND z.qid = a.qid AND z.i > a.i LEFT JOIN seen s ON s.collection = a.collection AND s.qid = a.qid AND s.b = a.i AND s.e = z.i + 1
    WHERE a.c * 100 <= a.n_symbols),
  reached AS (SELECT collection, qid, b, min(e) AS at FROM ratio WHERE x >= 2.0 GROUP BY 1, 2, 3),
  ends AS (SELECT r.collection, r.qid, r.b, min(e) - 1 AS e FROM reached r JOIN ratio x ON x.collection = r.collection AND x.qid = r.qid AND x.b = r.b AND x.e > r.at AND x.x < 2.0 GROUP BY 1, 2, 3),
  part AS (SELECT w.collection, w.qid, w.i AS b, coalesce(e.e, CASE WHEN r.at IS NULL THEN w.i + 1 ELSE w.n END) AS e
    FROM w LEFT JOIN reached r ON r.collection = w.collection AND r.qid = w.qid AND r.b = w.i LEFT JOIN ends e ON e.collection = w.collection AND e.qid = w.qid AND e.b = w.i),
  walk AS (SELECT collection, qid, b, e FROM part WHERE b = 0 UNION ALL SELECT p.collection, p.qid, p.b, p.e FROM walk JOIN part p ON p.collection = walk.collection AND p.qid = walk.qid AND p.b = walk.e)
SELECT k.collection, k.qid, array_to_string(ids[b + 1:e], ' ') AS unit, count(*) AS f_qt FROM walk k JOIN q ON q.collection = k.collection AND q.qid = k.qid GROUP BY 1, 2, 3"""
_BOUND = f"""WITH {_INPUTS}, per AS (SELECT collection, term_id, count(*) AS dfreq, sum(f_dt) AS cfreq FROM lists GROUP BY 1, 2),
  rows AS (SELECT l.collection, l.term_id, l.f_dt, dfreq, cfreq, n_docs, n_symbols, avgdl, w_d, 1 AS f_qt FROM lists l JOIN per ON per.collection = l.collection AND per.term_id = l.term_id
    JOIN stats ON stats.collection = l.collection JOIN len ON len.collection = l.collection AND len.doc_id = l.doc_id)"""
SQL = {
    "doc_lengths": f"WITH {_LEN} SELECT * FROM len",
    "collection_info": f"""WITH {_LEN}, {_STATS} SELECT s.collection, n_symbols, n_docs, coalesce(n_terms, 0) AS n_terms, n_symbols // n_docs AS avg_len
FROM stats s LEFT JOIN (SELECT collection, count(DISTINCT term) AS n_terms FROM toks GROUP BY 1) t ON t.collection = s.collection""",
    "collection_stats": f"WITH {_LEN}, {_STATS} SELECT collection, n_docs, n_symbols, round(avgdl, 6) AS avgdl, min_w_d FROM stats",
    "postings": f"WITH {_POST} SELECT * FROM post",
    "term_stats": f"WITH {_TERM} SELECT * FROM ts",
    "doc_frequency": f"WITH {_TERM} SELECT collection, term, dfreq FROM ts",
    "collection_frequency": f"WITH {_TERM} SELECT collection, term, cfreq FROM ts",
    "max_tf": f"WITH {_TERM} SELECT collection, term, max_tf FROM ts",
    "list_max_score": f"{_BOUND} SELECT collection, term_id, round(max({_SCORES['bm25'][0]}), 6) AS max_score FROM rows GROUP BY 1, 2",
    "max_doc_weight": f"{_BOUND} SELECT collection, term_id, round(max({_SCORES['lmds'][1]}), 6) AS max_doc_weight FROM rows GROUP BY 1, 2",
    "length_histogram": f"WITH {_LEN} SELECT collection, w_d, count(*) AS n_docs FROM len GROUP BY 1, 2",
    "length_rank": f"WITH {_LEN} SELECT collection, doc_id, w_d, row_number() OVER (PARTITION BY collection ORDER BY w_d, doc_id) - 1 AS length_rank FROM len",
    "distinct_docs_per_term": f"WITH {_TOKS} SELECT DISTINCT collection, term, doc_id FROM toks",
    "repetition_counts": f"WITH {_POST} SELECT collection, term, doc_id, f_dt - 1 AS repetitions FROM post WHERE f_dt > 1",
    "query_lines": f"WITH {_LINES} SELECT * FROM lines",
    "query_parse": f"WITH {_PARSED} SELECT * FROM split",
    "query_unknown_drop": f"WITH {_PARSED} SELECT collection, qid, term_id, count(*) AS f_qt FROM qt WHERE term_id IS NOT NULL GROUP BY 1, 2, 3",
    "query_unknown_reject": f"""WITH {_PARSED} SELECT collection, qid, term_id, count(*) AS f_qt FROM qt a
WHERE NOT EXISTS (SELECT 1 FROM qt b WHERE b.collection = a.collection AND b.qid = a.qid AND b.term_id IS NULL) GROUP BY 1, 2, 3""",
    "query_errors": f"WITH {_PARSED} SELECT DISTINCT collection, qid, 'unknown term' AS error FROM qt WHERE term_id IS NULL",
    "query_normalise": f"""WITH {_LINES} SELECT collection, line, replace(replace(replace(lower(line), '''', ''), '.', ''), '-', ' ') AS normalised FROM lines""",
    "query_units": f"WITH {_units_sql(True)} SELECT collection, qid, unit, f_qt FROM uq",
    "candidate_union": f"WITH {_found_sql(False)} SELECT collection, qid, doc_id, count(*) AS n_matched FROM rows GROUP BY 1, 2, 3",
    "candidate_intersection": f"WITH {_found_sql(False)} SELECT collection, qid, doc_id, count(*) AS n_matched FROM rows GROUP BY 1, 2, 3 HAVING count(*) = any_value(n_found)",
    "query_sample": f"""WITH {_PARSED}, q AS (SELECT collection, qid, list_sort(list(DISTINCT term_id)) AS ids FROM qt WHERE term_id IS NOT NULL GROUP BY 1, 2)
SELECT collection, qid, array_to_string(ids, ' ') AS term_ids FROM q QUALIFY row_number() OVER (PARTITION BY collection ORDER BY md5(qid || ' 4711'), qid) <= 100""",
    "phrase_segmentation": f"""WITH RECURSIVE {_TOKS}, {_SEGMENTS}""",
    "phrase_postings": f"WITH {_units_sql(True)}, {_PHRASES} SELECT * FROM pl",
    "bigram_counts": f"""WITH {_TOKS} SELECT collection, gram, count(*) AS n_occurrences FROM (SELECT collection, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS gram FROM toks)
WHERE gram IS NOT NULL GROUP BY 1, 2""",
    "bigram_association": f"""WITH {_TERM}, len AS (SELECT d.collection, d.doc_id, count(t.pos) + 1 AS w_d FROM documents d LEFT JOIN toks t ON t.doc_id = d.doc_id GROUP BY 1, 2), {_STATS},
  bg AS (SELECT collection, first, second, count(*) AS n_occurrences FROM (SELECT collection, term AS first, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM toks)
    WHERE second IS NOT NULL GROUP BY 1, 2, 3)
SELECT bg.collection, first, second, n_occurrences, round(ln(n_occurrences / s.n_symbols) - ln(a.cfreq / s.n_symbols) - 2 * ln(b.cfreq / s.n_symbols), 6) AS association
FROM bg JOIN ts a ON a.collection = bg.collection AND a.term = first JOIN ts b ON b.collection = bg.collection AND b.term = second JOIN stats s ON s.collection = bg.collection""",
    "profile_counters": f"""WITH {_found_sql(False)}, lens AS (SELECT collection, qid, count(*) AS qry_len FROM uq GROUP BY 1, 2),
  tot AS (SELECT collection, qid, count(*) AS n_found, CAST(sum(dfreq) AS BIGINT) AS postings_total FROM fu GROUP BY 1, 2),
  ev AS (SELECT collection, qid, count(DISTINCT doc_id) AS postings_evaluated FROM rows GROUP BY 1, 2)
SELECT l.collection, l.qid, qry_len, coalesce(n_found, 0) AS n_found, coalesce(postings_total, 0) AS postings_total, coalesce(postings_evaluated, 0) AS postings_evaluated
FROM lens l LEFT JOIN tot ON tot.collection = l.collection AND tot.qid = l.qid LEFT JOIN ev ON ev.collection = l.collection AND ev.qid = l.qid""",
    "result_names": f"WITH {_BM25} SELECT r.collection, qid, rank, r.doc_id, name FROM ranked r LEFT JOIN documents d ON d.doc_id = r.doc_id",
    "trec_run": f"WITH {_BM25} SELECT r.collection, qid, 'Q0' AS q0, name, rank, score, 'bm25' AS tag FROM ranked r LEFT JOIN documents d ON d.doc_id = r.doc_id",
    "doc_extract": f"""WITH {_BM25}, {_TOKS}, hit AS (SELECT DISTINCT doc_id FROM ranked)
SELECT h.doc_id, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS content FROM hit h LEFT JOIN toks t ON t.doc_id = h.doc_id GROUP BY 1""",
    "phrase_profile_counters": f"""WITH {_found_sql(True)}, lens AS (SELECT collection, qid, count(*) AS qry_len FROM uq GROUP BY 1, 2),
  tot AS (SELECT collection, qid, count(*) AS n_found, CAST(sum(dfreq) AS BIGINT) AS postings_total FROM fu GROUP BY 1, 2),
  ev AS (SELECT collection, qid, count(DISTINCT doc_id) AS postings_evaluated FROM rows GROUP BY 1, 2)
SELECT l.collection, l.qid, qry_len, coalesce(n_found, 0) AS n_found, coalesce(postings_total, 0) AS postings_total, coalesce(postings_evaluated, 0) AS postings_evaluated
FROM lens l LEFT JOIN tot ON tot.collection = l.collection AND tot.qid = l.qid LEFT JOIN ev ON ev.collection = l.collection AND ev.qid = l.qid""",
    "phrase_candidate_union": f"WITH {_found_sql(True)} SELECT collection, qid, doc_id, count(*) AS n_matched FROM rows GROUP BY 1, 2, 3",
    "phrase_candidate_intersection": f"WITH {_found_sql(True)} SELECT collection, qid, doc_id, count(*) AS n_matched FROM rows GROUP BY 1, 2, 3 HAVING count(*) = any_value(n_found)",
    "phrase_result_names": f"WITH {_PHRASE_BM25} SELECT r.collection, qid, rank, r.doc_id, name FROM ranked r LEFT JOIN documents d ON d.doc_id = r.doc_id",
    "phrase_trec_run": f"WITH {_PHRASE_BM25} SELECT r.collection, qid, 'Q0' AS q0, name, rank, score, 'bm25' AS tag FROM ranked r LEFT JOIN documents d ON d.doc_id = r.doc_id",
    "phrase_doc_extract": f"""WITH {_PHRASE_BM25}, hit AS (SELECT DISTINCT doc_id FROM ranked)
SELECT h.doc_id, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS content FROM hit h LEFT JOIN toks t ON t.doc_id = h.doc_id GROUP BY 1""",
} | {f"{ranker}_{mode}": _search_sql(ranker, mode) for ranker in _SCORES for mode in ("or", "and")} | {
    f"phrase_{ranker}": _search_sql(ranker, "or", with_phrases=True) for ranker in _SCORES
} | {
    f"phrase_{ranker}_and": _search_sql(ranker, "and", with_phrases=True) for ranker in _SCORES
} | {"topk_single": _search_sql("bm25", "or", 1), "topk_100": _search_sql("bm25", "or", 100)} | {
    f"phrase_topk_{name}": _search_sql("bm25", "or", k, with_phrases=True) for name, k in (("single", 1), ("100", 100))
}
