"""Rank summaries against sorted values, through any tree of merges."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisift.llm import percentiles
from lexisift.llm import rank_summary as rs


def rank_error(values, s, p):
    """How far the answer's ranks are from the asked rank, as a share of all `values`, which are sorted."""
    v = values
    answer, rank = rs.quantile(s, p), max(1, int(np.ceil(p * len(v) - 1e-9)))
    low, high = np.searchsorted(v, answer, "left") + 1, np.searchsorted(v, answer, "right")
    return max(0, low - rank, rank - high) / len(v)


@given(st.lists(st.lists(st.integers(-50, 50) | st.floats(-1e6, 1e6), max_size=400), min_size=1, max_size=12), st.sampled_from([0.5, 0.1, 0.02]))
@settings(max_examples=60, deadline=None)
def test_merged_error_is_bounded(parts, eps):
    values = np.sort(np.array([x for p in parts for x in p], float))
    level = [rs.compress(rs.exact(np.array(p, float)), eps) for p in parts]
    while len(level) > 1:
        level = [rs.merge(level[i : i + 3], eps) for i in range(0, len(level), 3)]
    s = level[0]
    assert s.n == len(values) == s.g.sum()
    if not len(values):
        assert rs.quantile(s, 0.5) is None
        return
    if s.n > len(s.v):
        assert s.uncertainty <= max(1, 2 * eps * s.n)
    for p in (0.0, 0.01, 0.5, 0.95, 1.0):
        assert rank_error(values, s, p) <= eps + 1e-9


@given(st.lists(st.tuples(st.floats(3, 6), st.sampled_from(["wide", "narrow", "steps", "line"]), st.integers(0, 3)), min_size=1, max_size=7), st.integers(2, 4), st.sampled_from([0.004, 0.02]), st.integers(0, 99))
@settings(max_examples=15, deadline=None)
def test_uneven_clustered_parts(parts, fan, eps, seed):
    """A thousand to a million values a part, also all of one part between two tuples of another, through up to six levels."""
    rng = np.random.default_rng(seed)
    made = {"wide": lambda n: rng.normal(0, 100, n), "narrow": lambda n: rng.normal(0.3, 1e-6, n), "steps": lambda n: rng.integers(0, 5, n) * 1.0, "line": lambda n: np.linspace(-500, 500, n)}
    values = [made[kind](int(10**size)) for size, kind, _ in parts]
    level = [rs.compress(rs.exact(v), eps) for v in values]
    for i, (_, _, times) in enumerate(parts):
        assert level[i].uncertainty <= max(1, 2 * eps * level[i].n)
        for _ in range(times):  # parts of different levels meet
            level[i] = rs.merge([level[i]], eps)
    while len(level) > 1:
        level = [rs.merge(level[i : i + fan], eps) for i in range(0, len(level), fan)]
    s, v = level[0], np.sort(np.concatenate(values))
    assert s.uncertainty <= max(1, 2 * eps * s.n) and s.g.sum() == s.n == len(v)
    for p in np.linspace(0, 1, 41):
        assert rank_error(v, s, p) <= s.uncertainty / (2 * s.n) + 1e-12 <= eps + 1e-9


def test_a_part_between_two_tuples():
    even, few = np.arange(0, 2_000_000, 2.0), np.linspace(1_000_001.1, 1_000_001.9, 4000)
    s = rs.merge([rs.compress(rs.exact(x), 0.004) for x in (even, few)], 0.004)
    v = np.sort(np.concatenate([even, few]))
    assert max(rank_error(v, s, p) for p in np.linspace(0, 1, 2001)) <= s.uncertainty / (2 * s.n) <= 0.004


def test_summaries_stay_small():
    rng = np.random.default_rng(0)
    parts = [rng.lognormal(5, 2, 20_000) for _ in range(64)]
    s, v = rs.merge([rs.compress(rs.exact(p), 0.004) for p in parts], 0.004), np.sort(np.concatenate(parts))
    assert len(s.v) < 1500
    for p in (0.01, 0.5, 0.9, 0.95, 0.99):
        assert rank_error(v, s, p) <= 0.004


def test_exact_where_small_and_nan_is_no_value():
    s = rs.merge([rs.exact([3, 1, float("nan")]), rs.exact([2])], 0.004)
    assert s.n == 3 and [rs.quantile(s, p) for p in (0.01, 0.5, 1)] == [1, 2, 3]


@pytest.fixture(scope="module")
def requests(spark):
    rng, day = random.Random(5), dt.datetime(2015, 1, 30)
    rows = []
    for i in range(4000):
        t = rng.choice([None, -5, rng.randint(1, 100), rng.randint(1, 100), 5000])
        rows.append((i, rng.choice(["A", "A", "B"]), rng.choice(["x", None]), day + dt.timedelta(hours=rng.randint(0, 95)), day, t, rng.randint(0, 9)))
    rows += [(*r[:4], r[4] + dt.timedelta(days=9), *r[5:]) for r in rows[:700]] + [(None, "A", "x", day, day, 1, 1), (9999, "A", "x", None, day, 1, 1)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "req_id bigint, index_name string, ranker string, sent_at timestamp, logged_at timestamp, qry_time bigint, search_time bigint")


def test_by_period_against_brute_force(spark, requests, monkeypatch):
    monkeypatch.setattr(percentiles, "CHUNK_ROWS", 300)
    report = {(r["period"], r["index_name"], r["ranker"], r["measure"]): r for r in percentiles.by_period(requests).collect()}
    expected = {}
    for r in {r["req_id"]: r for r in requests.filter("req_id IS NOT NULL AND sent_at IS NOT NULL").collect()}.values():
        for period in (f"{r['sent_at']:%Y-%m-%d}", f"{r['sent_at']:%Y-%m}"):
            for m in ("qry_time", "search_time"):
                if r[m] is not None and r[m] >= 0:
                    expected.setdefault((period, r["index_name"], r["ranker"], m), []).append(r[m])
    assert {k: r["n"] for k, r in report.items()} == {k: len(v) for k, v in expected.items()}
    for key, r in report.items():
        v = np.sort(np.array(expected[key], float))
        assert 0 <= r["rank_error"] <= percentiles.EPS
        for p in percentiles.PROBABILITIES:
            rank, answer = int(np.ceil(p * len(v) - 1e-9)), r[f"p{round(100 * p)}"]
            low, high = np.searchsorted(v, answer, "left") + 1, np.searchsorted(v, answer, "right")
            assert max(0, low - rank, rank - high) <= percentiles.EPS * len(v)


@pytest.mark.parametrize("fan_in", [64, 2])
def test_levels_between(requests, monkeypatch, fan_in):
    monkeypatch.setattr(percentiles, "FAN_IN", fan_in)
    parts = percentiles.summaries(requests.repartition(6), ["index_name"], ["search_time"])
    got = {tasks: {r["index_name"]: r for r in percentiles.merged(parts, ["index_name"], tasks=tasks).collect()} for tasks in (1, 1000)}
    for name, r in got[1000].items():
        assert (r["n"], r["percentiles"]) == (got[1][name]["n"], got[1][name]["percentiles"])  # few different values
        assert r["level"] > got[1][name]["level"] + (fan_in == 2) * 8


def test_within_bound(requests):
    checked = percentiles.within_bound(requests).collect()
    report = {(r["period"], r["index_name"], r["ranker"], r["measure"]): r["n"] for r in percentiles.by_period(requests).collect()}
    assert {tuple(r)[:4]: r["n"] for r in checked} == report and all(r["within"] for r in checked)
    assert percentiles.within_bound(requests, eps=0.3).filter("NOT within").count() == 0


def test_nothing(requests):
    assert percentiles.by_period(requests.filter("false")).count() == 0
    assert percentiles.long_tails(percentiles.by_period(requests.withColumn("qry_time", requests["qry_time"] * 0 - 1).drop("search_time"), ["qry_time"])).count() == 0
