"""Best items of groups, frequencies and distinctive terms against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisift.llm import distinctiveness, frequencies, top_n
from lexisift.llm.burst_trie import BurstTrie, decided, route

SCORES = "req_id bigint, collection string, qid bigint, doc_id bigint, score double, k string"
REQUESTS = "collection string, qid bigint, k bigint, score string"


def scored(seed, n=4000):
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    rows = []
    for _ in range(n):
        qid = 1 if rng.random() < 0.4 else rng.choice([2, 3, 4, 5, None])
        rows.append((1, rng.choice(["a", "b"]), qid, rng.choice([None, *range(300)]), rng.choice([*odd, *(rng.choice([0.5, -1.0, 0.0, rng.random()]) for _ in range(12))]), "x"))
    return rows + rows[:200]


def best(rows, ks):
    groups = defaultdict(dict)
    for _, c, q, d, s, _ in rows:
        if None not in (q, d, s) and math.isfinite(s):
            groups[c, q][d] = max(s, groups[c, q].get(d, s))
    return {(*g, d, rank) for g, docs in groups.items() if ks.get(g) for rank, (d, _) in enumerate(sorted(docs.items(), key=lambda x: (-x[1], x[0]))[: ks[g]], 1)}


@pytest.mark.parametrize("chunk, keep, broadcast", [(500_000, 1_000_000, 200_000), (100, 50, 200_000), (150, 1_000_000, 0)])
@pytest.mark.parametrize("many", [False, True])
def test_top_n(spark, monkeypatch, chunk, keep, broadcast, many):
    for name, x in (("CHUNK_ROWS", chunk), ("KEEP_ROWS", keep), ("BROADCAST_GROUPS", broadcast), ("EXACT_RANKS", 2 if many else 16)):
        monkeypatch.setattr(top_n, name, x)
    rows = scored(chunk + many)
    ks = {("a", 1): 10, ("b", 1): 7, ("a", 2): 3, ("b", 2): 1000, ("a", 3): 1, ("b", 4): None}
    requests = [(c, q, k, "x") for (c, q), k in ks.items()] + [("a", 1, None, "x"), ("a", None, 5, "x")]
    df = spark.createDataFrame(rows, SCORES).repartition(6)
    got = [(r["collection"], r["qid"], r["doc_id"], r["rank"]) for r in top_n.top_n(df, spark.createDataFrame(requests, REQUESTS)).collect()]
    assert len(got) == len(set(got)) and set(got) == best(rows, ks)


def test_top_n_of_nothing(spark):
    none, asked = spark.createDataFrame([], SCORES), spark.createDataFrame([("a", 1, 5, "x")], REQUESTS)
    assert top_n.top_n(none, asked).count() == 0
    some = top_n.top_n(spark.createDataFrame(scored(3, 50), SCORES), asked.filter("false"))
    assert some.count() == 0 and some.columns == top_n.top_n(none, asked).columns


@given(st.lists(st.tuples(st.text("abc", max_size=6), st.integers(0, 5)), max_size=300), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_trie(pairs, limit):
    trie, expected = BurstTrie(limit=limit), defaultdict(lambda: [0, 0])
    for t, n in pairs:
        trie.add(t, n, 1)
        expected[t][0] += n
        expected[t][1] += 1
    got = {p + r: [o, k] for p, rests, os, ks in trie.containers() for r, o, k in zip(rests, os, ks)}
    assert got == expected


@given(st.text("ab", max_size=8), st.text("ab", max_size=4), st.integers(0, 3))
def test_route(prefix, rest, more):
    branches = {"": more, "a" * (more + 1): more + 1, "ab": 5}
    to = route(prefix + rest, branches)
    assert (prefix + rest).startswith(to) and (to not in branches or to == prefix + rest)
    assert decided(prefix, branches) in (None, to)


@pytest.mark.parametrize("before", ["https://www.some.host.example/a/longer/path/", "x" * 3000, ""])
def test_routes_of_terms_behind_one_prefix(spark, monkeypatch, before):
    """However long the prefix that all terms share, no route gets more than ROUTE_ENTRIES and a container of each task."""
    monkeypatch.setattr(frequencies, "ROUTE_ENTRIES", 500)
    monkeypatch.setattr(frequencies, "CONTAINER", 16)
    tasks, made = 4, frequencies._branches
    seen = []
    monkeypatch.setattr(frequencies, "_branches", lambda subtrees: seen.append((subtrees, made(subtrees))) or seen[-1][1])
    n = 1_000_000 if before.startswith("https") else 20_000
    rows = spark.range(0, n, 1, tasks).selectExpr(f"concat('{before}', id % {n // 2}) AS term", "1 AS occurrences")
    counted = frequencies.count_terms(rows, [])
    assert counted.agg({"occurrences": "sum", "records": "sum", "term": "count"}).first().asDict() == {"sum(occurrences)": n, "sum(records)": n, "count(term)": n // 2}
    subtrees, branches = seen[0]
    sizes = Counter()
    for r in subtrees.select("prefix", "rests").collect():
        for x in r["rests"]:
            sizes[route(r["prefix"] + x, branches)] += 1
    assert max(sizes.values()) <= 500 + 16 * tasks and len(branches) >= 10


@pytest.mark.parametrize("entries, held, chunk", [(100_000, 2_000_000, 500_000), (3, 40, 50)])
def test_frequencies(spark, monkeypatch, entries, held, chunk):
    for name, x in (("ROUTE_ENTRIES", entries), ("MOST_ROUTES", 65_536 if entries > 3 else 40), ("HELD_TERMS", held), ("CHUNK_ROWS", chunk), ("CONTAINER", 4)):
        monkeypatch.setattr(frequencies, name, x)
    rng = random.Random(4)
    words = ["", "the", None, "né", "x" * 50_000, *("".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(300))]
    rows = [(rng.choice(["c", "d", None]), rng.choice([words[1], rng.choice(words)]), i, rng.choice([None, 1, 2, 5])) for i in range(2000)]
    expected = defaultdict(lambda: [0, 0])
    for c, t, _, n in rows:
        if t is not None:
            expected[c, t][0] += n or 0
            expected[c, t][1] += 1
    df = spark.createDataFrame(rows, "c string, term string, record bigint, occurrences bigint").repartition(5)
    got = [((r["c"], r["term"]), [r["occurrences"], r["records"]]) for r in frequencies.count_terms(df, ["c"]).collect()]
    assert len(got) == len(expected) and dict(got) == expected
    assert frequencies.count_terms(df.filter("false"), ["c"]).count() == 0


def test_marks(spark, rows):
    lists = [("c", "the", 5, d, 1) for d in range(6)] + [("c", "odd", 6, 1, 2), ("c", "odd", 6, 1, 2), ("c", None, 1, 1, 9), ("c", "few", 7, 1, 2), ("c", "few", 7, 2, 1), ("c", "x", 8, None, 1)]
    toks = [("c", 1, 0, [6, 6], ["odd", "odd"], None), ("c", 1, 0, [6, 6], ["odd", "odd"], None), ("c", 2, 0, [5], ["the"], 3), ("c", 3, 0, None, None, 1), ("c", 3, 1, [], [], 1), ("c", 3, 2, [0, None], None, 1)]
    postings = spark.createDataFrame(lists, "collection string, term string, term_id bigint, doc_id bigint, f_dt bigint")
    tokens = spark.createDataFrame(toks, "collection string, qid bigint, tok_pos bigint, token_ids array<bigint>, token_strs array<string>, f_qt bigint")
    docs = spark.createDataFrame([("c", d, "t") for d in range(10)], "collection string, doc_id bigint, term string")
    counts = frequencies.both_sides(postings, tokens)
    assert rows(counts) == [("c", "query", 5, 3, 1), ("c", "query", 6, 2, 1), ("c", "text", 5, 6, 6), ("c", "text", 6, 2, 1), ("c", "text", 7, 3, 2)]
    assert rows(frequencies.marked(counts, docs, tokens)) == [("c", "query", 5, "common"), ("c", "query", 6, "common"), ("c", "query", 6, "rare"), ("c", "text", 5, "common"), ("c", "text", 6, "rare")]


POSTINGS = "collection string, term string, term_id bigint, doc_id bigint, f_dt bigint, weight string"
INFO = "collection string, qid bigint, tok_pos bigint, token_ids array<bigint>, f_qt bigint, sp_dt bigint, ep_dt bigint, f_dt bigint"


@pytest.mark.parametrize("limit", [150_000, 0])
def test_distinctive_terms(spark, monkeypatch, limit):
    monkeypatch.setattr(distinctiveness, "BROADCAST_TERMS", limit)
    rng = random.Random(6)
    lists = list({(t, d): ("c", "t", t, d, rng.randint(1, 4), "w") for d in range(60) for t in rng.sample(range(2, 40), 9)}.values())
    info = [("c", q, p, rng.choice([[rng.randint(2, 45)], [rng.randint(2, 45)], [2, 3], [], None]), rng.choice([None, 1, 2]), 0, 0, 0) for q in range(20) for p in range(4)]
    dirty = [*lists, *lists[:50], ("c", None, 1, 3, 1, "w"), ("c", "t", 5, None, 1, "w"), ("c", "t", None, 4, 1, "w")]
    docs = [("c", d) for d in range(62)] + [("c", None)]
    n = Counter(t for _, _, t, _, _, _ in lists)
    f = defaultdict(dict)
    for _, _, t, d, x, _ in lists:
        f["document", d][t] = x
    for _, q, _, ids, x, *_ in set((a, b, c, tuple(i or ()), x) for a, b, c, i, x, *_ in info):
        if len(ids) == 1 and x is not None:
            f["query", q][ids[0]] = f["query", q].get(ids[0], 0) + x
    expected = {}
    for record, terms in f.items():
        weights = [(-round(x * math.log(62 / n[t]), 6), t) for t, x in terms.items() if n[t] >= 2]
        if weights:
            expected[record] = (min(weights)[1], pytest.approx(-min(weights)[0], abs=2e-6))
    got = distinctiveness.most_characteristic(spark.createDataFrame(dirty, POSTINGS), spark.createDataFrame(info + info[:9], INFO), spark.createDataFrame(docs, "collection string, doc_id bigint")).collect()
    assert len(got) == len(expected) and {(r["record_kind"], r["record_id"]): (r["term_id"], r["weight"]) for r in got} == expected


def test_rate_is_the_limit_of_counts():
    """Half the statistic of (f, 0) against m times (n, N - n) comes to f * ln(N / n) as m grows."""
    f, n, of = 3, 20, 1000
    m = 1e9
    k = (f, 0, n * m, (of - n) * m)
    total = sum(k)
    g = 2 * sum(x * math.log(x * total / (row * col)) for x, row, col in ((k[0], f, f + k[2]), (k[2], k[2] + k[3], f + k[2]), (k[3], k[2] + k[3], k[3])))
    assert g / 2 == pytest.approx(f * math.log(of / n), rel=1e-4)


def test_counts_form(spark):
    rows = [("c", "t", 2, 1, 9, "w"), ("c", "t", 3, 1, 9, "w"), ("c", "t", 3, 2, 90, "w"), ("c", "t", 4, 2, 5, "w"), ("c", "t", 4, 2, 5, "w")]
    got = {r["record_id"]: r["term_id"] for r in distinctiveness.most_characteristic_by_counts(spark.createDataFrame(rows, POSTINGS)).collect()}
    assert got == {1: 2, 2: 3}


def test_counts_form_of_both_kinds(spark, rows):
    """Queries have a row too, also for terms (9) and collections (d) without postings, which count 0."""
    lists = [("c", "t", 2, 1, 9, "w"), ("c", "t", 3, 1, 9, "w"), ("c", "t", 3, 2, 90, "w"), ("c", "t", 4, 2, 5, "w"), ("c", "t", 4, 2, 5, "w")]
    info = [("c", 7, 0, [3], 2, 0, 0, 0), ("c", 7, 1, [4], 1, 0, 0, 0), ("c", 7, 1, [4], 1, 0, 0, 0), ("c", 8, 0, [9], 1, 0, 0, 0), ("c", 8, 1, [2], 1, 0, 0, 0), ("c", 1, 0, [2, 3], 1, 0, 0, 0), ("d", 5, 0, [2], 1, 0, 0, 0)]

    def llr(k11, k12, k21, k22):
        total, cells = k11 + k12 + k21 + k22, ((k11, k11 + k12, k11 + k21), (k12, k11 + k12, k12 + k22), (k21, k21 + k22, k11 + k21), (k22, k21 + k22, k12 + k22))
        return pytest.approx(2 * sum(k * math.log(k * total / (row * col)) for k, row, col in cells if k), abs=1e-3)

    postings = spark.createDataFrame(lists, POSTINGS)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in distinctiveness.records_by_counts(postings, spark.createDataFrame(info, INFO)).collect()}
    assert got == {
        ("document", "c", 1): (2, llr(9, 9, 0, 95)), ("document", "c", 2): (3, llr(90, 5, 9, 9)),
        ("query", "c", 7): (4, llr(1, 2, 5, 108)), ("query", "c", 8): (9, llr(1, 1, 0, 113)), ("query", "d", 5): (2, 0.0),
    }
    assert rows(distinctiveness.most_characteristic_by_counts(postings)) == sorted((c, i, *x) for (kind, c, i), x in got.items() if kind == "document")


def test_distinctive_terms_of_nothing(spark):
    none = distinctiveness.most_characteristic(spark.createDataFrame([], POSTINGS), spark.createDataFrame([], INFO), spark.createDataFrame([], "collection string, doc_id bigint"))
    assert none.count() == 0
