"""Skewed keys against plain joins and counts."""

import random
from collections import Counter, defaultdict

import pytest

from lexisift.operators import skew


@pytest.fixture(scope="module")
def fact(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.4 else rng.randint(1, 50), rng.randint(0, 99)) for _ in range(3000)] + [(None, 5), (None, None), (3, None)]
    return spark.createDataFrame(rows, "k bigint, x bigint").cache()


def test_heavy_keys(spark, fact):
    heavy = skew.heavy_keys(fact, ["k"], share=0.1, least=100)
    assert heavy == [r[0] for r in spark.createDataFrame([(0,)], "k bigint").select(skew.key_hash(["k"])).collect()]
    assert skew.heavy_keys(fact.filter("false"), ["k"]) == []


def test_threshold_follows_the_partitions(spark, monkeypatch):
    """No key above two average partitions is left out, however many partitions there are, and however many such keys."""
    monkeypatch.setattr(skew, "HEAVY_ROWS", 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(200_000).selectExpr("CASE WHEN id < 100000 THEN id % 900 ELSE id END AS k")  # 900 keys of 111 rows
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert skew.heavy_share(spark) == skew.HEAVY_SHARE and skew.heavy_keys(rows, ["k"]) == []
        spark.conf.set("spark.sql.shuffle.partitions", "5000")
        assert len(skew.heavy_keys(rows, ["k"])) == 900
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("heavy", [True, False])
@pytest.mark.parametrize("unique", [True, False])
def test_join(spark, fact, rows, how, heavy, unique):
    dim = spark.createDataFrame([(k, f"v{k}") for k in range(0, 40)] + ([] if unique else [(0, "again"), (1, "again")]) + [(None, "null")], "k bigint, v string")
    found = skew.heavy_keys(fact, ["k"], 0.1, 100) if heavy else []
    assert rows(skew.skew_join(fact, dim, ["k"], how, found, unique)) == rows(fact.join(dim, "k", how))


def test_join_of_nothing(spark, fact, rows):
    empty = spark.createDataFrame([], "k bigint, v string")
    found = skew.heavy_keys(fact, ["k"], 0.1, 100)
    assert skew.skew_join(fact, empty, ["k"], heavy=found).count() == 0
    assert skew.skew_join(fact.filter("false"), empty, ["k"]).count() == 0
    assert rows(skew.skew_join(fact, empty, ["k"], "left", found)) == rows(fact.join(empty, "k", "left"))


def test_join_refuses_what_it_cannot_do(spark, fact):
    with pytest.raises(ValueError, match="both sides"):
        skew.skew_join(fact, spark.createDataFrame([(1, 2)], "k bigint, X bigint"), ["k"])
    with pytest.raises(ValueError, match="unknown join"):
        skew.skew_join(fact, fact.select("k"), ["k"], "cross")


def test_distinct_counts(fact):
    expected = defaultdict(set)
    for k, x in fact.collect():
        expected[k] |= {x} - {None}
    got = {r["k"]: r["n"] for r in skew.count_distinct_per_key(fact, ["k"], "x").collect()}
    assert got == {k: len(v) for k, v in expected.items()}


def test_recorded_wrongly(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 20)
    rng = random.Random(2)
    lists = [("c", t, d) for t in range(2, 9) for d in range(50) if t == 2 or rng.random() < 0.3]
    dirty = lists + lists[:30] + [("c", 1, 3), ("c", None, 3), ("c", 4, None), ("d", 2, 1)]
    true = Counter(t for _, t, _ in lists)
    info = []
    for q in range(12):
        for pos, t in enumerate(rng.sample(range(2, 11), 3)):
            info.append(("c", q, pos, [t], 1, rng.choice([true[t], true[t], true[t] + 1, None])))
    info += [("c", 3, 9, [2, 3], 1, 77), ("c", 4, 9, None, 1, 1), ("c", 4, 10, [], 1, 1), *info[:5]]
    terms = defaultdict(set)
    for _, q, _, ids, _, _ in info:
        if ids:
            terms[q] |= set(ids)
    requests = [("c", q := rng.choice([5, 5, rng.randint(0, 13)]), 1000 + i, rng.choice([None, sum(true[t] for t in terms.get(q, ())), 3])) for i in range(200)]
    requests += requests[:20] + [("c", 5, None, 3)]
    wrong = {("term", "c", ids[0]) for _, _, _, ids, _, n in info if ids and len(ids) == 1 and n is not None and n != true[ids[0]]}
    wrong |= {("request", c, r) for c, q, r, n in requests if r is not None and n is not None and q in terms and q != 3 and n != sum(true[t] for t in terms[q])}
    got = skew.recorded_wrongly(
        spark.createDataFrame(dirty, "collection string, term_id bigint, doc_id bigint"),
        spark.createDataFrame(info, "collection string, qid bigint, tok_pos bigint, token_ids array<bigint>, f_qt bigint, f_dt bigint"),
        spark.createDataFrame(requests, "collection string, qid bigint, req_id bigint, postings_total bigint"),
    ).collect()
    assert {tuple(r) for r in got} == wrong
    assert len(got) == len(wrong)


def test_recorded_wrongly_of_nothing(spark):
    lists = spark.createDataFrame([], "collection string, term_id bigint, doc_id bigint")
    info = spark.createDataFrame([], "collection string, qid bigint, tok_pos bigint, token_ids array<bigint>, f_qt bigint, f_dt bigint")
    requests = spark.createDataFrame([], "collection string, qid bigint, req_id bigint, postings_total bigint")
    assert skew.recorded_wrongly(lists, info, requests).count() == 0
