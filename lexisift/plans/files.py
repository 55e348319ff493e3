"""Queries on sources, sinks and the service, by files written from the tables, and their SQL.

Each writes whole tables in the format that it is about into the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.functions import rankers
from lexisift.operators import querying
from lexisift.operators.checkpoints import scratch, written
from lexisift.plans import retrieval
from lexisift.plans.indexes import index_path, opened
from lexisift.sources import collection as sources
from lexisift.sources import exports
from lexisift.sources.tables import table
from lexisift.streaming import service

_NAMED = "doc_id IS NOT NULL"


def _text(rows: DataFrame, column: str = "value") -> str:
    """Where the text files with the lines `column` are."""
    path = scratch(rows.sparkSession)
    rows.select(F.coalesce(column, F.lit("")).alias("value")).write.text(path)
    return path


def dictionary_file(spark: SparkSession, d: str) -> DataFrame:
    """(term, term_id) read from lines `term id`, in which a wrong id of each term comes first and bad lines are mixed in."""
    rows = table(spark, d, "term_dict").select("term", F.explode(F.array(F.struct(F.lit(0).alias("o"), (-F.col("term_id")).alias("id")), F.struct(F.lit(1).alias("o"), F.col("term_id").alias("id")))).alias("x"))
    lines = rows.orderBy("x.o", "term").select(F.concat_ws(" ", "term", F.col("x.id").cast("string")).alias("value"))
    return sources.read_dictionary(spark, _text(lines.unionByName(spark.createDataFrame([("no number",), ("",), ("alone",)], "value string"))))


def doc_names_file(spark, d):
    names = table(spark, d, "documents").filter(_NAMED).orderBy("doc_id").select(F.coalesce("name", F.lit("")).alias("value"))
    return sources.read_doc_names(spark, _text(names))


def url_order_file(spark, d):
    """The order of a file that lists the names from the last document to the first, without those of even ids."""
    documents = table(spark, d, "documents").filter(_NAMED)
    lines = documents.filter("doc_id % 2 = 1 AND name IS NOT NULL").orderBy(F.col("doc_id").desc()).select(F.concat(F.lit("http://host/"), F.col("doc_id"), F.lit(" "), F.col("name")).alias("value"))
    return sources.read_url_order(spark, _text(lines), documents.select("doc_id", "name"))


def query_file(spark, d):
    return sources.read_queries(spark, _text(retrieval.query_lines(spark, d), "line"))


def query_client_ids(spark, d):
    """The lines as a client sends them to a service of ids."""
    return querying.premapped(retrieval.query_lines(spark, d), table(spark, d, "term_dict"))


def query_integer_mode(spark, d):
    """(collection, qid, term_id, f_qt) of lines of ids."""
    return querying.parse(query_client_ids(spark, d), None, "reject", most_chars=None)


def _toy(spark: SparkSession, d: str) -> str:
    """All names of nations as a toy string, in order."""
    return "".join(f"{r[0]}#" for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect())  # 25 rows


def toy_dictionary(spark, d):
    return sources.create_toy(spark, _toy(spark, d), scratch(spark)).dictionary


def toy_postings(spark, d):
    return sources.create_toy(spark, _toy(spark, d), scratch(spark)).postings


def symbol_file(spark, d):
    """(doc_id, pos, term_id) of the toy string as a file of whole numbers of 8 bytes."""
    import numpy as np

    path = scratch(spark)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/text")
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(np.array(sources.symbols(_toy(spark, d)), "<u8").tobytes()))
    out.close()
    return sources.read_symbols(spark, path)


def trec_text_file(spark, d):
    """(name, n_chars) of documents written as `<DOC>` elements and read again."""
    told = F.concat(F.lit("<DOC>\n<DOCNO> "), F.col("doc_id").cast("string"), F.lit(" </DOCNO>\n<TEXT>"), F.regexp_replace(F.coalesce("text", F.lit("")), "[<>]", " "), F.lit("</TEXT>\n</DOC>"))
    pages = sources.read_trec(spark, _text(table(spark, d, "documents").filter(_NAMED).select(told.alias("value"))), "again")
    return pages.select("name", F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")).cast("bigint").alias("n_letters"))


def results_csv(spark, d):
    path = scratch(spark)
    exports.write_results(retrieval.bm25_or(spark, d), path)
    return spark.read.schema("id bigint, rank bigint, docid bigint, score double").csv(path, sep=";", header=True)


def client_row_csv(spark, d):
    """What is known of each query's request from its search, as a line of 15 fields and read again; times, which aren't measured here, are 0."""
    c, units = opened(spark, d), retrieval.units(spark, d)
    sizes = c.search(units).groupBy("collection", "qid").agg(F.count("*").alias("result_size"))
    zero = {x: F.lit(0) for x in ("qry_time", "search_time", "wt_search_space", "wt_nodes", "client_time", "qry_mode")}
    rows = c.profile(units).join(sizes, ["collection", "qid"], "left").fillna(0, ["result_size"]).withColumns(zero | {"ranker": F.lit("bm25"), "index_name": F.lit("lists"), "k": F.lit(10)})
    path = scratch(spark)
    exports.write_client_rows(rows, path)
    kinds = "qid bigint, collection string, ranker string, index_name string, qry_mode bigint, k bigint, qry_len bigint, result_size bigint, qry_time bigint, search_time bigint"
    return spark.read.schema(f"{kinds}, wt_search_space bigint, wt_nodes bigint, postings_evaluated bigint, postings_total bigint, client_time bigint").csv(path, sep=";")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Every query's line, with its own depth and mode."""
    lines = retrieval.query_lines(spark, d)
    qid = F.substring_index("line", ";", 1).cast("bigint")
    return lines.withColumns({"k": 1 + qid % 12, "mode": qid % 2, "profile": qid % 3 == 0})


def service_answers(spark, d):
    return service.SearchService(opened(spark, d)).answer(_requests(spark, d)).results.drop("line")


def service_errors(spark, d):
    return service.SearchService(opened(spark, d)).answer(_requests(spark, d)).errors.select("collection", "qid", "k", "mode", "error")


def service_responses(spark, d):
    return service.SearchService(opened(spark, d)).answer(_requests(spark, d)).responses.drop("line")


def _first_query(spark: SparkSession, d: str) -> DataFrame:
    units = written(retrieval.units(spark, d))
    return units.join(units.select("collection", "qid").orderBy("qid", "collection").limit(1), ["collection", "qid"])


def single_query(spark, d):
    """The first query by itself: top k of one query, by a heap."""
    return opened(spark, d).search_one(_first_query(spark, d))


def client_loop(spark, d):
    """(id, index, k, num_terms, timed): a client's requests, sent one after the other and timed: the first query's line."""
    told = retrieval.query_lines(spark, d).withColumn("qid", F.substring_index("line", ";", 1).cast("bigint"))
    accepted = told.join(query_integer_mode(spark, d).select("collection", "qid"), ["collection", "qid"], "left_semi")
    lines = [tuple(r) for r in accepted.orderBy("qid", "collection").select("collection", "line").limit(1).collect()]
    rows = service.run_client(service.SearchService(opened(spark, d)), lines, runs=2)
    path = scratch(spark)
    exports.write_timings(service.timings(rows), path)
    back = spark.read.schema("id bigint, index string, k bigint, num_terms bigint, time_ms double").csv(path, sep=";", header=True)
    return back.select("id", "index", "k", "num_terms", (F.col("time_ms") > 0).alias("timed"))


def doc_lookup(spark, d):
    """The terms of the first document."""
    documents = table(spark, d, "documents")
    return exports.extract_one(documents, documents.agg(F.min("doc_id")).first()[0])


def collection_sizes(spark, d):
    return opened(spark, d).sizes()


def collection_check(spark, d):
    """(name, ok): whether each table of the saved index is there with its columns, and a folder without any is refused."""
    opened(spark, d)
    bad = {p.split(":")[0] for p in sources.problems(spark, index_path(spark, d))}
    rows = [(name, name not in bad) for name in sources.TABLES] + [("nothing", sources.is_valid(spark, f"{index_path(spark, d)}/nothing"))]
    return spark.createDataFrame(rows, "name string, ok boolean")


def space_report(spark, d):
    """(name, some): the tables of the saved index, and whether they take any bytes; how many depends on the writer."""
    opened(spark, d)
    return sources.space(spark, index_path(spark, d)).select("name", (F.col("bytes") > 0).alias("some"))


def space_fields(spark, d):
    """(n_fields, n_empty) of the row of sizes."""
    opened(spark, d)
    parts = F.split("row", ";")
    return sources.space_row(spark, index_path(spark, d)).select(F.size(parts).cast("bigint").alias("n_fields"), F.size(F.filter(parts, lambda x: x == "0")).cast("bigint").alias("n_empty"))


def custom_ranker(spark, d):
    """A ranker registered by the user: a point for each unit that a document has."""
    if "units" not in rankers.RANKERS:
        rankers.register("units", rankers.Ranker(lambda s, w: F.lit(1.0)))
    return opened(spark, d).search(retrieval.units(spark, d), ranker="units")


QUERIES = {
    f.__name__: f
    for f in (
        dictionary_file, doc_names_file, url_order_file, query_file, query_client_ids, query_integer_mode, toy_dictionary, toy_postings, symbol_file, trec_text_file, results_csv, client_row_csv,
        service_answers, service_errors, service_responses, single_query, client_loop, doc_lookup, collection_sizes, collection_check, space_report, space_fields, custom_ranker,
    )
}

_ACCEPTED = f"""{retrieval._PARSED}, ok AS (SELECT collection, qid FROM qt GROUP BY 1, 2 HAVING count(*) = count(term_id))"""
_TOY = """toy AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS doc_id, unnest(string_split(n_name, '')) AS c, generate_subscripts(string_split(n_name, ''), 1) - 1 AS pos, n_nationkey FROM nation),
  terms AS (SELECT doc_id, pos, lower(c) AS term FROM toy WHERE regexp_matches(c, '[\\p{L}\\p{N}]')), seen AS (SELECT term, min(doc_id * 1000 + pos) AS first_at FROM terms GROUP BY 1),
  ids AS (SELECT term, 1 + row_number() OVER (ORDER BY first_at) AS term_id FROM seen)"""


def _service_sql(what: str) -> str:
    scored = retrieval._ranked_sql("bm25", "or", 1000000)
    body = scored.split("uq AS (", 1)
    end = body[1].index(", found AS (")
    units = """SELECT qt.collection, qt.qid, CAST(term_id AS VARCHAR) AS unit, [term_id] AS ids, count(*) AS f_qt FROM qt JOIN ok ON ok.collection = qt.collection AND ok.qid = qt.qid GROUP BY 1, 2, term_id)"""
    text = f"{_ACCEPTED}, {body[0]}uq AS ({units}{body[1][end:]}"
    text = text[: text.index(", scored AS (")]
    each = retrieval._SCORES["bm25"][0]
    return f"""WITH {text}, scored AS (SELECT collection, qid, doc_id, sum({each}) AS x, count(*) AS n, any_value(n_found) AS n_found FROM rows GROUP BY 1, 2, 3),
  asked AS (SELECT *, qid % 2 AS mode, 1 + qid % 12 AS k FROM scored WHERE qid % 2 = 0 OR n = n_found),
  results AS (SELECT collection, qid, k, mode, row_number() OVER (PARTITION BY collection, qid ORDER BY round(x, 9) DESC, doc_id) AS rank, doc_id, round(x, 6) AS score FROM asked QUALIFY rank <= k)
{what}"""


SQL = {
    "dictionary_file": "SELECT term, term_id FROM term_dict",
    "doc_names_file": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, coalesce(name, '') AS name FROM documents WHERE doc_id IS NOT NULL",
    "url_order_file": """WITH l AS (SELECT name, row_number() OVER (ORDER BY doc_id DESC) - 1 AS o FROM documents WHERE doc_id % 2 = 1 AND name IS NOT NULL)
SELECT doc_id, d.name, doc_order FROM documents d LEFT JOIN (SELECT name, min(o) AS doc_order FROM l GROUP BY 1) x ON x.name = d.name WHERE doc_id IS NOT NULL""",
    "query_file": f"WITH {retrieval._LINES} SELECT line FROM lines WHERE length(line) < 1024",
    "query_client_ids": f"""WITH {_ACCEPTED}, word AS (SELECT collection, qid, unnest(string_split(content, ' ')) AS term, generate_subscripts(string_split(content, ' '), 1) AS i FROM split)
SELECT word.collection, word.qid || ';' || string_agg(CAST(term_id AS VARCHAR), ' ' ORDER BY i) AS line FROM word JOIN ok ON ok.collection = word.collection AND ok.qid = word.qid
JOIN term_dict t ON t.term = word.term GROUP BY word.collection, word.qid""",
    "query_integer_mode": f"WITH {_ACCEPTED} SELECT qt.collection, qt.qid, term_id, count(*) AS f_qt FROM qt JOIN ok ON ok.collection = qt.collection AND ok.qid = qt.qid GROUP BY 1, 2, 3",
    "toy_dictionary": f"WITH {_TOY} SELECT * FROM ids",
    "toy_postings": f"""WITH {_TOY} SELECT 'toy' AS collection, term_id, doc_id, count(*) AS f_dt, sum(count(*)) OVER (PARTITION BY doc_id)::BIGINT + 1 AS w_d
FROM terms JOIN ids ON ids.term = terms.term GROUP BY term_id, doc_id""",
    "symbol_file": """WITH toy AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS doc_id, unnest(string_split(n_name, '')) AS c, generate_subscripts(string_split(n_name, ''), 1) - 1 AS pos, n_nationkey FROM nation),
  ids AS (SELECT c, 1 + row_number() OVER (ORDER BY min(doc_id * 1000 + pos)) AS term_id FROM toy GROUP BY c) SELECT doc_id, pos, term_id FROM toy JOIN ids ON ids.c = toy.c""",
    "trec_text_file": r"SELECT CAST(doc_id AS VARCHAR) AS name, length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) AS n_letters FROM documents WHERE doc_id IS NOT NULL",
    "results_csv": f"WITH {retrieval._BM25} SELECT qid AS id, rank, doc_id AS docid, score FROM ranked",
    "client_row_csv": retrieval.SQL["profile_counters"].replace("SELECT l.collection, l.qid, qry_len, coalesce(n_found, 0) AS n_found,", f""", res AS (SELECT collection, qid, count(*) AS n FROM ({retrieval._search_sql("bm25", "or")}) GROUP BY 1, 2)
SELECT l.collection, l.qid, qry_len, 'bm25' AS ranker, 'lists' AS index_name, 0 AS qry_mode, 10 AS k, coalesce(res.n, 0) AS result_size, 0 AS qry_time, 0 AS search_time, 0 AS wt_search_space, 0 AS wt_nodes, 0 AS client_time,""")
    + " LEFT JOIN res ON res.collection = l.collection AND res.qid = l.qid",
    "service_answers": _service_sql("SELECT * FROM results"),
    "service_errors": f"""WITH {retrieval._PARSED}, long AS (SELECT collection, CAST(split_part(line, ';', 1) AS BIGINT) AS qid, line FROM lines)
SELECT DISTINCT collection, qid, 1 + qid % 12 AS k, qid % 2 AS mode, 'unknown term' AS error FROM qt WHERE term_id IS NULL
UNION ALL SELECT collection, qid, 1 + qid % 12, qid % 2, 'line too long' FROM long WHERE length(line) >= 1024""",
    "service_responses": _service_sql("""SELECT l.collection, l.qid, 1 + l.qid % 12 AS k, l.qid % 2 AS mode, CASE WHEN ok.qid IS NULL THEN 0 ELSE 1 END AS status, 'bm25' AS ranker,
  CASE WHEN ok.qid IS NOT NULL THEN coalesce(u.n, 0) END AS qry_len, CASE WHEN ok.qid IS NOT NULL THEN coalesce(r.n, 0) END AS result_size,
  CASE WHEN ok.qid IS NOT NULL AND l.qid % 3 = 0 THEN coalesce(e.n, 0) END AS postings_evaluated, CASE WHEN ok.qid IS NOT NULL AND l.qid % 3 = 0 THEN coalesce(t.n, 0) END AS postings_total
FROM (SELECT collection, CAST(split_part(line, ';', 1) AS BIGINT) AS qid FROM lines) l LEFT JOIN ok ON ok.collection = l.collection AND ok.qid = l.qid
LEFT JOIN (SELECT collection, qid, count(*) AS n FROM uq GROUP BY 1, 2) u ON u.collection = l.collection AND u.qid = l.qid
LEFT JOIN (SELECT collection, qid, count(*) AS n FROM results GROUP BY 1, 2) r ON r.collection = l.collection AND r.qid = l.qid
LEFT JOIN (SELECT collection, qid, count(DISTINCT doc_id) AS n FROM rows GROUP BY 1, 2) e ON e.collection = l.collection AND e.qid = l.qid
LEFT JOIN (SELECT collection, qid, CAST(sum(dfreq) AS BIGINT) AS n FROM fu GROUP BY 1, 2) t ON t.collection = l.collection AND t.qid = l.qid"""),
    "single_query": f"WITH {retrieval._BM25}, first AS (SELECT collection, qid FROM uq ORDER BY qid, collection LIMIT 1) SELECT r.* FROM ranked r JOIN first f ON f.collection = r.collection AND f.qid = r.qid",
    "client_loop": f"""WITH {_ACCEPTED}, first AS (SELECT collection, qid FROM ok ORDER BY qid, collection LIMIT 1)
SELECT q.qid AS id, 'lists' AS index, 10 AS k, count(DISTINCT term_id) AS num_terms, true AS timed FROM qt q JOIN first f ON f.collection = q.collection AND f.qid = q.qid GROUP BY 1""",
    "doc_lookup": f"WITH {retrieval._TOKS} SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS content FROM toks WHERE doc_id = (SELECT min(doc_id) FROM documents) GROUP BY 1",
    "collection_sizes": f"""WITH {retrieval._INPUTS} SELECT s.collection, coalesce(p.n, 0) AS n_postings, n_docs AS n_documents, n_symbols FROM stats s
LEFT JOIN (SELECT collection, count(*) AS n FROM lists GROUP BY 1) p ON p.collection = s.collection""",
    "collection_check": "SELECT unnest(['documents', 'dictionary', 'postings', 'positions', 'terms', 'lengths', 'stats', 'nothing']) AS name, unnest([true, true, true, true, true, true, true, false]) AS ok",
    "space_report": "SELECT unnest(['documents', 'dictionary', 'postings', 'positions', 'terms', 'lengths', 'stats', 'layout']) AS name, true AS some",
    "space_fields": "SELECT 5 AS n_fields, 0 AS n_empty",
    "custom_ranker": f"""WITH {retrieval._found_sql(False)}, scored AS (SELECT collection, qid, doc_id, CAST(count(*) AS DOUBLE) AS score FROM rows GROUP BY 1, 2, 3)
SELECT collection, qid, row_number() OVER (PARTITION BY collection, qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored QUALIFY rank <= 10""",
}
