"""Files in and out, saved collections, and the service."""

import struct
import time

import pytest
from pyspark.sql import functions as F

from lexisift.operators import analyze
from lexisift.sources import collection as sources
from lexisift.sources import exports
from lexisift.sources.collection import Collection
from lexisift.streaming.service import AND, PHRASES, SearchService, run_client, timings

TEXTS = ["red fox jumps", "red red hen", "new york city red", "new york new york", "blue sky", "blue fox den"]


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    docs = spark.createDataFrame([("toy", i, t, f"D{i}") for i, t in enumerate(TEXTS)], "collection string, doc_id bigint, text string, name string")
    path = str(tmp_path_factory.mktemp("root"))
    Collection.build(docs).save(path)
    return path


def test_round_trip(spark, saved, rows):
    assert sources.is_valid(spark, saved)
    opened = Collection.open(spark, saved)
    built = Collection.build(opened.documents)
    for name in sources.TABLES:
        columns = sorted(getattr(built, name).columns)
        assert rows(getattr(opened, name).select(*columns)) == rows(getattr(built, name).select(*columns))
    assert opened.buckets == 2 * spark.sparkContext.defaultParallelism
    taken = {r["name"]: r["bytes"] for r in sources.space(spark, saved).collect()}
    assert set(taken) == {*sources.TABLES, "layout"} and all(x > 0 for x in taken.values())
    assert sources.space_row(spark, saved).first()[0].split(";")[:2] == [str(taken["postings"]), str(taken["positions"])]
    ids = [(r["term"], r["term_id"]) for r in opened.dictionary.orderBy("term_id").collect()]
    assert [i for _, i in ids] == list(range(2, 2 + len(ids))) and [t for t, _ in ids] == sorted(t for t, _ in ids)
    assert opened.sizes().first().asDict() == {"collection": "toy", "n_postings": 16, "n_documents": 6, "n_symbols": 26}


def test_no_collection(spark, tmp_path):
    assert len(sources.problems(spark, str(tmp_path / "none"))) == len(sources.TABLES)
    with pytest.raises(ValueError):
        Collection.open(spark, str(tmp_path / "none"))


def test_from_string(spark, rows):
    docs = sources.from_string(spark, "ab#ba#")
    assert rows(docs.select("doc_id", "text", "name")) == [(0, "a b", "DOCUMENT 1"), (1, "b a", "DOCUMENT 2")]
    assert sources.symbols("ab#ba#") == [2, 3, 1, 3, 2, 1, 0]
    stats = analyze.collection_stats(analyze.doc_lengths(docs)).first()
    assert (stats["n_docs"], stats["n_symbols"]) == (2, 7)
    with pytest.raises(ValueError):
        sources.from_string(spark, "ab")


def test_toy(spark, tmp_path, rows):
    c = sources.create_toy(spark, "ba #ab#", str(tmp_path / "toy"))
    assert rows(c.dictionary) == [("a", 3), ("b", 2)] and rows(c.postings.select("term_id", "doc_id", "w_d")) == [(2, 0, 3), (2, 1, 3), (3, 0, 3), (3, 1, 3)]
    with pytest.raises(ValueError, match="exists"):
        sources.create_toy(spark, "ba#", str(tmp_path / "toy"))


def test_text_files(spark, tmp_path, rows):
    (tmp_path / "dict.txt").write_text("red 2\nfox 3\nred 5\nbad\n")
    assert rows(sources.read_dictionary(spark, str(tmp_path / "dict.txt"))) == [("fox", 3), ("red", 5)]
    (tmp_path / "names.txt").write_text("A\nB\n\nD\n")
    names = sources.read_doc_names(spark, str(tmp_path / "names.txt"))
    assert rows(names) == [(0, "A"), (1, "B"), (2, ""), (3, "D")]
    (tmp_path / "urls.txt").write_text("http://x D\nhttp://y A\n")
    assert rows(sources.read_url_order(spark, str(tmp_path / "urls.txt"), names)) == [(0, "A", 1), (1, "B", None), (2, "", None), (3, "D", 0)]
    (tmp_path / "q.qry").write_text("1;red\n2;" + "x" * 2000 + "\n")
    assert rows(sources.read_queries(spark, str(tmp_path / "q.qry"))) == [("1;red",)]


def test_lines_of_several_files_and_splits(spark, tmp_path, rows):
    """Numbers follow names of files, whatever the splits; the last of several entries holds over all files."""
    (tmp_path / "f").mkdir()
    lines = [f"name{i}" for i in range(3000)]
    (tmp_path / "f/a").write_text("\n".join(lines[:2000]) + "\n")
    (tmp_path / "f/b").write_text("\n".join(lines[2000:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        names = sources.read_doc_names(spark, str(tmp_path / "f"))
        assert spark.read.text(str(tmp_path / "f")).rdd.getNumPartitions() > 1
        assert sorted(map(tuple, names.collect())) == list(enumerate(lines))
        (tmp_path / "g").mkdir()
        (tmp_path / "g/a").write_text("".join(f"t{i % 10} {i}\n" for i in range(1000)))
        (tmp_path / "g/b").write_text("t3 7\n")
        assert rows(sources.read_dictionary(spark, str(tmp_path / "g"))) == sorted((f"t{i}", 7 if i == 3 else 990 + i) for i in range(10))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_corpus_formats(spark, tmp_path):
    (tmp_path / "t").write_text("<DOC>\n<DOCNO> A-1 </DOCNO>\n<TEXT>Red <b>fox</b></TEXT>\n</DOC>\nrubbish\n<DOC>\n<DOCNO>A-3</DOCNO>hen\n</DOC>\n")
    got = {r["name"]: r["text"].split() for r in sources.read_trec(spark, str(tmp_path / "t"), "c").collect()}
    assert got["A-1"] == ["Red", "fox"] and got["A-3"][-1] == "hen"
    (tmp_path / "w").write_text("<DOC>\n<DOCNO>W-1</DOCNO>\n<DOCHDR>\nhttp://x\n</DOCHDR>\n<html>sky</html>\n</DOC>\n")
    assert [(r["name"], r["text"].split()) for r in sources.read_trec(spark, str(tmp_path / "w"), "c", web=True).collect()] == [("W-1", ["sky"])]
    record = "WARC/1.0\r\nWARC-Type: {}\r\n{}WARC-Target-URI: http://x/{}\r\nContent-Length: 9\r\n\r\n{}\r\n\r\n"
    page = "HTTP/1.1 200 OK\r\nServer: s\r\n\r\n<p>blue den</p>"
    (tmp_path / "x.warc").write_bytes("".join([record.format("warcinfo", "", 0, "x"), record.format("response", "WARC-TREC-ID: id-1\r\n", 1, page), record.format("response", "", 2, page)]).encode())
    docs = sources.read_warc(spark, str(tmp_path / "x.warc"), "c")
    assert {(r["name"], r["text"].strip()) for r in docs.collect()} == {("id-1", "blue den"), ("http://x/2", "blue den")} and analyze.documents_terms(docs).count() == 2


def test_symbol_files(spark, tmp_path, rows):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a").write_bytes(struct.pack("<7Q", *sources.symbols("ab#ba#")))
    (tmp_path / "s/b").write_bytes(struct.pack("<3Q", 9, 1, 0))
    assert rows(sources.read_symbols(spark, str(tmp_path / "s"))) == [(0, 0, 2), (0, 1, 3), (1, 0, 3), (1, 1, 2), (2, 0, 9)]


def test_pages(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.html").write_text("<html><script>x<y</script><p>Red <b>fox</b></p>")
    got = analyze.documents_terms(sources.read_pages(spark, str(tmp_path / "p"), "web")).first()
    assert got["terms"] == ["red", "fox"]


def test_sinks(spark, saved, tmp_path):
    c = Collection.open(spark, saved)
    results = c.search(c.parse(spark.createDataFrame([("toy", "2;red fox"), ("toy", "1;blue")], "collection string, line string")))
    exports.write_results(results, str(tmp_path / "res"))
    lines = [x for f in sorted((tmp_path / "res").glob("*.csv")) for x in f.read_text().splitlines()]
    assert lines[0] == "id;rank;docid;score" and [x.split(";")[:2] for x in lines if x[0] != "i"][:2] == [["1", "1"], ["1", "2"]]
    from_csv = exports.results_to_trec(spark, str(tmp_path / "res"), c.documents, "t").select("qid", "q0", "name", "rank", "score", "tag")
    direct = exports.trec_rows(results, c.documents, "t")
    assert sorted(map(tuple, from_csv.collect())) == sorted(map(tuple, direct.select("qid", "q0", "name", "rank", "score", "tag").collect()))
    exports.write_trec(direct, str(tmp_path / "trec"))
    assert [f.read_text().split("\t")[1] for f in sorted((tmp_path / "trec").glob("*.csv"))][0] == "Q0"
    assert exports.extract_one(c.documents, 3).first()["content"] == "new york new york"
    assert {r["doc_id"] for r in exports.extract(c.documents, results).collect()} == {r["doc_id"] for r in results.collect()}
    exports.write_timings(spark.createDataFrame([(1, "lists", 10, 2, 3.5)], "id bigint, index string, k bigint, num_terms bigint, time_ms double"), str(tmp_path / "times"))


def test_service(spark, saved, tmp_path):
    service = SearchService(Collection.open(spark, saved), threshold=-100.0)
    lines = spark.createDataFrame([("toy", "1;red fox"), ("toy", "2;red zzz"), ("toy", "3;new york")], "collection string, line string")
    got = service.answer(lines, mode=AND)
    assert {(r["qid"], r["doc_id"]) for r in got.results.collect()} == {(1, 0), (3, 2), (3, 3)}
    assert [(r["qid"], r["error"]) for r in got.errors.collect()] == [(2, "unknown term")]
    with_phrases = service.answer(lines.filter("line LIKE '3%'"), mode=PHRASES).results
    assert {r["doc_id"] for r in with_phrases.collect()} == {2, 3}
    (tmp_path / "in").mkdir()
    lines.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("collection string, line string").parquet(str(tmp_path / "in"))
    query = service.serve(stream, lambda df, i: seen.extend((i, r["qid"]) for r in df.select(F.col("qid")).distinct().collect()), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert sorted(q for _, q in seen) == [1, 3]


def test_service_of_own_depths_and_errors(spark, saved, tmp_path):
    """Each request has its own k and mode, also under a qid used twice; every other line is an error that reaches its sink."""
    service = SearchService(Collection.open(spark, saved), threshold=-100.0)
    asked = [("1;red fox", 1, 0), ("1;red fox", None, AND), ("1;blue", 10, None), ("3;new york", 1, PHRASES | AND), ("x;red", 5, 0), ("no id", 5, 0), ("4;" + "red " * 300, 5, 0), ("5;zzz", 5, 0)]
    (tmp_path / "in").mkdir()
    schema = "collection string, line string, k bigint, mode bigint"
    spark.createDataFrame([("toy", *x) for x in asked], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    results, errors = [], []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = service.serve(stream, lambda df, i: results.extend(df.collect()), str(tmp_path / "cp"), error_sink=lambda df, i: errors.extend(df.collect()))
    query.processAllAvailable()
    query.stop()
    got = {(r["qid"], r["line"][2:], r["k"], r["mode"], r["doc_id"]) for r in results}
    assert got == {(1, "red fox", 1, 0, 0), (1, "red fox", 10, AND, 0), (1, "blue", 10, 0, 4), (1, "blue", 10, 0, 5), (3, "new york", 1, PHRASES | AND, 3)}
    assert {(r["qid"], r["line"][:5], r["error"]) for r in errors} == {(None, "x;red", "unreadable line"), (None, "no id", "unreadable line"), (4, "4;red", "line too long"), (5, "5;zzz", "unknown term")}


def test_service_options_and_responses(spark, saved):
    """Counters, thresholds and ids by request; a response each, status 0 for an error; the client's loop."""
    service = SearchService(Collection.open(spark, saved))
    ids = {r["term"]: r["term_id"] for r in service.collection.dictionary.collect()}
    asked = [("1;red fox", 0, True, None, False), ("2;new york", PHRASES, True, -100.0, False), ("3;new york", PHRASES, False, 100.0, False), (f"4;{ids['blue']} {ids['sky']}", AND, True, None, True), ("5;zzz", 0, True, None, False), ("6;blue", 0, False, None, True)]
    answers = service.answer(spark.createDataFrame([("toy", *x) for x in asked], "collection string, line string, mode bigint, profile boolean, threshold double, ids boolean"))
    got = {r["qid"]: (r["status"], r["qry_len"], r["result_size"], r["postings_evaluated"], r["postings_total"]) for r in answers.responses.collect()}
    assert got == {1: (1, 2, 4, 4, 5), 2: (1, 2, 2, 2, 4), 3: (1, 2, 2, None, None), 4: (1, 2, 1, 2, 3), 5: (0, None, None, None, None), 6: (0, None, None, None, None)}
    assert {(r["qid"], r["error"]) for r in answers.errors.collect()} == {(5, "unknown term"), (6, "unknown term")}
    rows = run_client(service, [("toy", "1;red fox"), ("toy", "2;zzz")], runs=2)
    assert [(r["qid"], r["qry_len"], r["result_size"], r["postings_total"]) for r in rows.collect()] == [(1, 2, 4, 5)]
    assert rows.filter("client_time >= search_time AND search_time > 0").count() == 1 and timings(rows).first()["num_terms"] == 2
    assert service.answer(spark.createDataFrame([], "collection string, line string")).responses.count() == 0


def test_shared_folder(spark, monkeypatch):
    from lexisift.operators import checkpoints

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        checkpoints.shared_folder(Session)
    Session.sparkContext.master = "local[2]"
    assert checkpoints.shared_folder(Session) == checkpoints.shared_folder(Session)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
    assert time.time() > 0
