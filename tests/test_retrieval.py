"""The toy collection with results worked out by hand from the formulas, and properties of searches."""

import pytest
from pyspark.sql import functions as F

from lexisift.functions import rankers
from lexisift.operators import analyze, phrases, querying
from lexisift.operators import search as searching
from lexisift.sources.collection import Collection

TEXTS = [
    "red fox jumps", "red red hen", "new york city red", "new york new york", "blue sky", "blue fox den", "city sky den", "new hen york", "york den den den",
]


@pytest.fixture(scope="module")
def toy(spark):
    docs = spark.createDataFrame([("toy", i, t, f"D{i}") for i, t in enumerate(TEXTS)], "collection string, doc_id bigint, text string, name string").cache()
    built = Collection.build(docs)
    return Collection(docs, *(getattr(built, t).cache() for t in ("dictionary", "postings", "positions", "terms", "lengths", "stats")))


def units_of(spark, toy, *wanted):
    """wanted: (words, f_qt); a unit of several words is a phrase."""
    ids = {r["term"]: r["term_id"] for r in toy.dictionary.collect()}
    rows = [("toy", 1, [ids[w] for w in words.split()], n) for words, n in wanted if all(w in ids for w in words.split())]
    return spark.createDataFrame(rows, "collection string, qid bigint, unit array<bigint>, f_qt bigint")


def found(df):
    return [(r["doc_id"], r["score"]) for r in df.orderBy("rank").collect()]


def test_statistics(toy):
    s = toy.stats.first()
    assert (s["n_docs"], s["n_symbols"], round(s["avgdl"], 6), s["min_w_d"]) == (9, 39, 4.333333, 3)
    stats = {r["term"]: (r["dfreq"], r["cfreq"], r["max_tf"]) for r in analyze.term_stats(analyze.postings(toy.documents)).collect()}
    assert stats == {
        "blue": (2, 2, 1), "city": (2, 2, 1), "den": (3, 5, 3), "fox": (2, 2, 1), "hen": (2, 2, 1), "jumps": (1, 1, 1), "new": (3, 4, 2), "red": (3, 4, 2), "sky": (2, 2, 1), "york": (4, 5, 2),
    }
    ranks = analyze.length_ranks(toy.lengths).orderBy("length_rank").collect()
    assert [r["doc_id"] for r in ranks] == [4, 0, 1, 5, 6, 7, 2, 3, 8]
    assert {(r["w_d"], r["n_docs"]) for r in analyze.length_histogram(toy.lengths).collect()} == {(3, 1), (4, 5), (5, 3)}
    assert analyze.collection_info(toy.documents).first().asDict() == {"collection": "toy", "n_symbols": 39, "n_docs": 9, "n_terms": 10, "avg_len": 4}


RED_FOX, YORK_CITY, NEW_YORK = (("red", 1), ("fox", 1)), (("york", 1), ("city", 2), ("zzz", 1)), (("new york", 1),)
GOLDEN = [
    (RED_FOX, "bm25", "or", [(0, 1.77346), (5, 1.134307), (1, 0.870001), (2, 0.582386)]),
    (RED_FOX, "bm25", "and", [(0, 1.77346)]),
    (RED_FOX, "lmds", "or", [(0, 0.008465), (1, 0.004572), (5, 0.004572), (2, -0.000104)]),
    (RED_FOX, "lmds", "and", [(0, 0.008465)]),
    (RED_FOX, "tfidf", "or", [(0, 0.772761), (1, 0.5868), (5, 0.426187), (2, 0.277259)]),
    (RED_FOX, "freq", "or", [(0, 2), (1, 2), (2, 1), (5, 1)]),
    (YORK_CITY, "bm25", "or", [(6, 2.268615), (2, 2.255915), (3, 0.264478), (7, 0.207191), (8, 0.188789)]),
    (YORK_CITY, "bm25_simple_est", "or", [(6, 2.268615), (2, 2.255915), (3, 0.264478), (7, 0.207191), (8, 0.188789)]),
    (YORK_CITY, "bm25", "and", [(2, 2.255915)]),
    (YORK_CITY, "lmds", "or", [(2, 0.006889), (6, 0.004572), (3, 0.002225), (7, -0.000082), (8, -0.000881)]),
    (YORK_CITY, "tfidf", "or", [(2, 0.576681), (6, 0.426187), (3, 0.399127), (7, 0.294664), (8, 0.235731)]),
    (NEW_YORK, "bm25", "or", [(3, 1.447941), (2, 1.033563)]),
    (NEW_YORK, "lmds", "or", [(3, 0.008348), (2, 0.003189)]),
    (NEW_YORK, "tfidf", "or", [(3, 0.577278), (2, 0.34095)]),
    (NEW_YORK, "freq", "or", [(3, 2), (2, 1)]),
]


@pytest.mark.parametrize("wanted, ranker, mode, expected", GOLDEN)
def test_golden(spark, toy, wanted, ranker, mode, expected):
    units = units_of(spark, toy, *wanted)
    got = found(toy.search(units, 10, ranker, mode, with_phrases=wanted is NEW_YORK))
    assert [d for d, _ in got] == [d for d, _ in expected]
    assert [x for _, x in got] == pytest.approx([x for _, x in expected], abs=1.5e-6)


def test_top_k_is_a_prefix_and_and_is_a_subset(spark, toy):
    units = units_of(spark, toy, ("york", 1), ("den", 1), ("city", 1))
    whole = found(toy.search(units, 10))
    for k in (1, 2, 3):
        assert found(toy.search(units, k)) == whole[:k]
    both = found(toy.search(units, 10, mode="and"))
    assert {d for d, _ in both} < {d for d, _ in whole}


def test_single_word_phrases_are_terms(spark, toy, rows):
    ids = toy.dictionary.select(F.lit("toy").alias("collection"), F.array("term_id").alias("unit"))
    as_phrases = phrases.phrase_postings(toy.positions, toy.terms, ids)
    assert rows(as_phrases.select("collection", F.get("unit", F.lit(0)), "doc_id", "f_dt", "w_d")) == rows(toy.postings.select("collection", "term_id", "doc_id", "f_dt", "w_d"))


@pytest.mark.parametrize("few", [True, False])
def test_overlapping_phrases(spark, monkeypatch, few):
    """On both sides of the limit for broadcasts: overlaps, repeated ids, ids that occur nowhere, null ids."""
    for module in (searching, phrases):
        monkeypatch.setattr(module, "BROADCAST_UNITS", 1000 if few else 0)
    docs = spark.createDataFrame([("c", 1, "a a a b", "x"), ("c", 2, "b a", "y"), ("c", 3, "a b a b a", "z")], "collection string, doc_id bigint, text string, name string")
    built = Collection.build(docs, spark.createDataFrame([("a", 2), ("b", 3)], "term string, term_id bigint"))
    wanted = spark.createDataFrame([("c", u) for u in ([2, 2], [2, 2, 3], [9, 2], [2, 3, 2, 3], [3], [None, 2], [])], "collection string, unit array<bigint>")
    got = {(tuple(r["unit"]), r["doc_id"]): (r["f_dt"], r["w_d"]) for r in phrases.phrase_postings(built.positions, built.terms, wanted.union(wanted)).collect()}
    assert got == {((2, 2), 1): (2, 5), ((2, 2, 3), 1): (1, 5), ((2, 3, 2, 3), 3): (1, 6), ((3,), 1): (1, 5), ((3,), 2): (1, 3), ((3,), 3): (2, 6)}
    assert phrases.phrase_postings(built.positions, built.terms, wanted.filter("false")).count() == 0


def test_search_without_broadcasts_or_pushed_terms(spark, toy, monkeypatch):
    units = units_of(spark, toy, ("york", 1), ("city", 2), ("new york", 1))
    ways = (("bm25", "or"), ("lmds", "and"))
    expected = [found(toy.search(units, 10, *way, True)) for way in ways]
    counters = toy.profile(units, True).first()
    for module in (searching, phrases):
        monkeypatch.setattr(module, "BROADCAST_UNITS", 0)
    monkeypatch.setattr(searching, "PUSHED_TERMS", 0)
    assert [found(toy.search(units, 10, *way, True)) for way in ways] == expected
    assert toy.profile(units, True).first() == counters and (counters["qry_len"], counters["n_found"], counters["postings_total"]) == (3, 3, 8)
    assert searching.list_bounds(toy.postings, toy.terms, toy.stats).count() == 10


def test_single_query(spark, toy):
    units = units_of(spark, toy, ("york", 1), ("den", 1), ("city", 1))
    for k in (1, 3, 10):
        assert found(toy.search_one(units, k)) == found(toy.search(units, k))
    with pytest.raises(ValueError):
        toy.search_one(units.unionByName(units.withColumn("qid", F.lit(2))))


def test_search_of_nothing(spark, toy):
    units = units_of(spark, toy, *RED_FOX)
    assert toy.search(units.filter("false")).count() == 0 and toy.profile(units.filter("false")).count() == 0
    empty = Collection.build(toy.documents.filter("false"))
    assert empty.search(units).count() == 0 and [tuple(r)[2:] for r in empty.profile(units).collect()] == [(2, 0, 0, 0)]


def test_registered_ranker(spark, toy):
    if "one" not in rankers.RANKERS:
        rankers.register("one", rankers.Ranker(lambda s, w: F.lit(1.0)))
    with pytest.raises(ValueError):
        rankers.register("bm25", rankers.freq())
    assert found(toy.search(units_of(spark, toy, *RED_FOX), ranker="one"))[0] == (0, 2.0)


def test_unknown_mode(spark, toy):
    with pytest.raises(ValueError):
        toy.search(units_of(spark, toy, *RED_FOX), mode="xor")


def test_terms_of_odd_texts(spark):
    texts = [None, "", "  --  ", "Ünïcode CAFÉ 3D_x", "a" * 100_000]
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)] + [("c", None, "gone")], "collection string, doc_id bigint, text string")
    got = {r["doc_id"]: r["terms"] for r in analyze.documents_terms(df).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["ünïcode", "café", "3d", "x"], 4: ["a" * 100_000]}
    assert {r["doc_id"]: r["w_d"] for r in analyze.doc_lengths(df).collect()}[0] == 1
    assert analyze.postings(df.filter("false")).count() == 0


PARSED = [
    ("7;red fox red", "drop", {"red": 2, "fox": 1}), ("7;red zzz", "drop", {"red": 1}), ("7;red zzz", "reject", {}), ("7;red  fox", "drop", {"red": 1, "fox": 1}),
    ("7;red  fox", "reject", {}), ("7;" + "red " * 300, "drop", {}), ("x;red", "drop", {}), ("no id", "drop", {}),
]


@pytest.mark.parametrize("line, unknown, expected", PARSED)
def test_parsing(spark, toy, line, unknown, expected):
    lines = spark.createDataFrame([(line,)], "line string")
    got = querying.parse(lines, toy.dictionary, unknown).join(toy.dictionary, "term_id").collect()
    assert {r["term"]: r["f_qt"] for r in got} == expected


def test_parsing_ids(spark):
    lines = spark.createDataFrame([("7;5 9 5",)], "line string")
    assert {r["term_id"]: r["f_qt"] for r in querying.parse(lines, None).collect()} == {5: 2, 9: 1}
    assert querying.rejected(spark.createDataFrame([("7;5 x",), ("8;5",)], "line string"), None).collect()[0].asDict() == {"qid": 7, "error": "unknown term"}


def test_units_of_dirty_tokens(spark, rows):
    data = [("c", 1, 0, [5], 2), ("c", 1, 0, [5], 2), ("c", 1, 1, [5], None), ("c", 1, 2, [], 1), ("c", 1, 3, None, 1), ("c", 1, 4, [1], 1), ("c", 1, 5, [5, None], 1), ("c", 1, 6, [5, 6], 1)]
    df = spark.createDataFrame(data, "collection string, qid bigint, tok_pos bigint, token_ids array<bigint>, f_qt bigint")
    assert {(tuple(r["unit"]), r["f_qt"]) for r in querying.units(df).collect()} == {((5,), 3), ((5, 6), 1)}
    assert {(tuple(r["unit"]), r["f_qt"]) for r in querying.units(df, False).collect()} == {((5,), 3)}


def brute_segment(ids, text, threshold):
    """The rules once more, on a list of symbols, as a state machine."""
    import math

    def count(seq):
        return sum(text[i : i + len(seq)] == seq for i in range(len(text) - len(seq) + 1))

    size, out, start = len(text), [], 0
    while start < len(ids):
        best, i = None, start + 1
        while i < len(ids) and count(ids[start : start + 1]) * 100 <= size:
            span = ids[start : i + 1]
            if count(span):
                value = math.log(count(span) / size) - sum(math.log(count([x]) / size) for x in span) - math.log(count([ids[i]]) / size)
            else:
                value = -math.inf
            if value >= threshold:
                best = i + 1
            elif best:
                break
            i += 1
        out.append((start, best or start + 1))
        start = best or start + 1
    return out


@pytest.mark.parametrize("threshold", [0.0, 8.0])
def test_segmentation_against_brute_force(spark, threshold):
    import random

    rng = random.Random(3)
    words = list(range(2, 60))
    docs = [[rng.choice(words) for _ in range(40)] + [7, 8, 9] * rng.randint(0, 2) + [rng.choice(words)] for _ in range(30)]
    text = [x for d in docs for x in [*d, 1]] + [0]
    frame = spark.createDataFrame([("c", i, " ".join(f"w{x}" for x in d), None) for i, d in enumerate(docs)], "collection string, doc_id bigint, text string, name string")
    dictionary = spark.createDataFrame([(f"w{x}", x) for x in words], "term string, term_id bigint")
    queries = [[7, 8, 9], [5, 7, 8, 9, 6], [7, 8], [10, 11, 12], [7, 8, 9, 7, 8, 9], [30]]
    queried = spark.createDataFrame([("c", i, q) for i, q in enumerate(queries)], "collection string, qid bigint, ids array<bigint>")
    stats = analyze.collection_stats(analyze.doc_lengths(frame))
    assert stats.first()["n_symbols"] == len(text)
    got = {}
    built = Collection.build(frame, dictionary)
    own = queried.withColumn("threshold", F.when(F.col("qid") < 3, threshold))  # the others take the argument
    for r in phrases.segment_queries(own, built.positions, built.terms, stats, 12.0 - threshold).collect():
        got.setdefault(r["qid"], {})[tuple(r["unit"])] = r["f_qt"]
    for i, q in enumerate(queries):
        expected = {}
        for b, e in brute_segment(q, text, threshold if i < 3 else 12.0 - threshold):
            expected[tuple(q[b:e])] = expected.get(tuple(q[b:e]), 0) + 1
        assert got[i] == expected


def test_sample_is_stable(spark, toy):
    rows = spark.createDataFrame([("c", i, t) for i in range(20) for t in (5, 3)], "collection string, qid bigint, term_id bigint")
    first, again = (sorted((r["qid"], tuple(r["term_ids"])) for r in querying.sample(rows, 5).collect()) for _ in range(2))
    assert first == again and len(first) == 5 and all(t == (3, 5) for _, t in first)


def test_phrase_twins_of_registered_queries(spark, tmp_path, rows):
    """A query of nothing but a phrase has a row, AND asks for the phrase, and qry_len counts it."""
    import __spark_entry__ as e

    docs = spark.createDataFrame([("toy", i, t, f"D{i}") for i, t in enumerate(TEXTS)], "collection string, doc_id bigint, text string, name string")
    built = Collection.build(docs)
    ids = {r["term"]: r["term_id"] for r in built.dictionary.collect()}
    new, york, hen, sky = (ids[w] for w in ("new", "york", "hen", "sky"))
    tokens = [("toy", 1, 0, [new, york], 1), ("toy", 2, 0, [new, york], 1), ("toy", 2, 1, [york], 1), ("toy", 3, 0, [sky, hen], 1), ("toy", 4, 0, [hen], 1)]
    tables = {"documents": docs, "term_dict": built.dictionary, "postings": built.postings, "query_token": spark.createDataFrame(tokens, "collection string, qid bigint, tok_pos bigint, token_ids array<bigint>, f_qt bigint")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: e.queries()[name](spark, str(tmp_path))
    assert rows(run("phrase_profile_counters").drop("collection")) == [(1, 1, 1, 2, 2), (2, 2, 2, 6, 4), (3, 1, 0, 0, 0), (4, 1, 1, 2, 2)]
    assert rows(run("phrase_candidate_union").drop("collection")) == [(1, 2, 1), (1, 3, 1), (2, 2, 2), (2, 3, 2), (2, 7, 1), (2, 8, 1), (4, 1, 1), (4, 7, 1)]
    both = [(1, 2), (1, 3), (2, 2), (2, 3), (4, 1), (4, 7)]
    for name in ("phrase_candidate_intersection", "phrase_freq_and", "phrase_lmds_and", "phrase_tfidf_and", "phrase_bm25_simple_est_and"):
        assert rows(run(name).select("qid", "doc_id")) == both
    assert rows(run("phrase_doc_extract").select("doc_id")) == [(1,), (2,), (3,), (7,), (8,)]
    assert {r["qid"] for r in run("phrase_topk_single").collect()} == {1, 2, 4}


def test_long_lines_of_a_batch(spark, tmp_path, rows):
    """Only a client's lines have a limit."""
    import __spark_entry__ as e

    tokens = [("toy", 1, 0, [2] * 400, ["red"] * 400, 1), ("toy", 2, 0, None, ["red"] * 400 + ["zzz"], 1)]
    spark.createDataFrame(tokens, "collection string, qid bigint, tok_pos bigint, token_ids array<bigint>, token_strs array<string>, f_qt bigint").write.parquet(f"{tmp_path}/query_token.parquet")
    spark.createDataFrame([("red", 2)], "term string, term_id bigint").write.parquet(f"{tmp_path}/term_dict.parquet")
    run = lambda name: rows(e.queries()[name](spark, str(tmp_path)))
    assert [(q, len(x)) for _, q, x in run("query_parse")] == [(1, 1599), (2, 1603)]
    assert run("query_unknown_drop") == [("toy", 1, 2, 400), ("toy", 2, 2, 400)]
    assert run("query_unknown_reject") == [("toy", 1, 2, 400)]
    assert run("query_errors") == [("toy", 2, "unknown term")]
    assert run("query_sample") == [("toy", 1, "2"), ("toy", 2, "2")]


def test_lines_that_cannot_be_read(spark, toy, rows):
    lines = spark.createDataFrame([("7;" + "red " * 300,), ("x;red",), ("12",), (None,), ("8;red",), ("9;zzz",)], "line string")
    unread = [(None, "unreadable line")] * 3
    assert sorted(rows(querying.rejected(lines, toy.dictionary)), key=str) == sorted([(7, "line too long"), (9, "unknown term"), *unread], key=str)
    assert (7, "line too long") not in rows(querying.rejected(lines, toy.dictionary, most_chars=None))
    assert rows(querying.unreadable(lines).filter("line LIKE 'x%'")) == [("x;red", None, "unreadable line")]


def test_length_ranks_of_a_common_length(spark):
    rows = [("c", i, 1) for i in range(500)] + [("c", 1000 + i, 7 - i % 3) for i in range(9)] + [("d", 5, 3)]
    ranks = analyze.length_ranks(spark.createDataFrame(rows, "collection string, doc_id bigint, w_d bigint").repartition(3))
    expected = {(c, d): i for c in "cd" for i, (w, d) in enumerate(sorted((w, d) for k, d, w in rows if k == c))}
    assert {(r["collection"], r["doc_id"]): r["length_rank"] for r in ranks.collect()} == expected


def test_searches_read_only_the_index(spark):
    """One saved index for all searches: no text is read, no candidate is shuffled before each task has cut its best, few terms reach the scan."""
    from lexisift.plans import indexes, retrieval

    d = "/root/testdata/sf0.001"
    c = indexes.opened(spark, d)
    assert indexes.opened(spark, d) is c
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (retrieval.bm25_or(spark, d), retrieval.phrase_bm25(spark, d)):
        text = plan(df)
        assert "documents" not in text and "lexisift_postings" in text
        assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit") and text.count("Exchange hashpartitioning(request") == 1
    one = c.search(retrieval.units(spark, d).limit(1))
    assert "EqualTo(term_id" in plan(one) or "term_id" in plan(one)[plan(one).index("PushedFilters") :]
