"""Spans of queries counted in texts, without an index."""

import random
from pathlib import Path

import duckdb
import pytest

from lexisift.operators import spans

DOCUMENT = "collection string, doc_id bigint, text string, name string"
TOKEN = "collection string, qid bigint, tok_pos bigint, token_ids array<bigint>, token_strs array<string>, f_qt bigint"


def segmented(spark, folder, **tables):
    """The query on these tables, and what its SQL gives."""
    import __spark_entry__ as e

    base = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
        base.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got = e.queries()["phrase_segmentation"](spark, str(folder)).collect()
    return sorted(map(tuple, got)), sorted(base.sql(e.oracle_sql()["phrase_segmentation"]).fetchall())


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


@pytest.mark.parametrize("most", [spans.TREE_IDS, 200])
def test_odd_texts_in_one_and_in_several_trees(spark, tmp_path, monkeypatch, most):
    """Texts of all kinds, delivered postings that lack most of them, and a collection of queries only, as the SQL has them."""
    monkeypatch.setattr(spans, "TREE_IDS", most)
    monkeypatch.setattr(spans, "STEP_CHARS", 50)
    words = ["new", "york", "Été", "straße", "東京", "x1", "0", "hen", "été", "Å", "den"]
    terms = ["new", "york", "été", "straße", "東京", "x1", "0", "hen", "å", "den"]
    rng = random.Random(5)
    rows = [(c, 100 * k + i, rng.choice([" ", "\t", "-", "_", ", ", "“"]).join(rng.choice([w, w.upper() if w.isascii() else w, "unknown"]) for w in rng.choices(words, k=30)), None) for k, c in enumerate("ab") for i in range(20)]
    rows += [("a", 500, None, None), ("a", 501, "", None), ("b", 502, "new york" * 9, None), ("a", None, "new york", None), ("c", 503, "...", None)]
    rows += [(c, 600 + 100 * k + i, "New York " * 3 + "filler " * 2000, None) for k, c in enumerate("ab") for i in range(5)]  # makes the other words rare
    queries = [(c, q, p, rng.choices(range(2, 13), k=rng.choice([1, 1, 2, 3])), None, 1) for c in "abcd" for q in range(12) for p in range(rng.randint(1, 4))]
    queries += [("a", 90, 0, [2, 3], None, 1), ("a", 90, 0, [2, 3], None, 1), ("a", 91, 0, [2, 3, 2, 3, 2], None, 1), ("a", 92, 0, [], None, 1), ("a", 92, 1, [1, 2], None, 1), ("a", 92, 2, None, None, 1), (None, 93, 0, [2, 3], None, 1)]
    got, expected = segmented(
        spark, tmp_path, documents=spark.createDataFrame(rows, DOCUMENT).repartition(3), term_dict=spark.createDataFrame([(t, i + 2) for i, t in enumerate(terms)], "term string, term_id bigint"),
        postings=spark.createDataFrame([("a", 2, 0, 1)], "collection string, term_id bigint, doc_id bigint, f_dt bigint"), query_token=spark.createDataFrame(queries, TOKEN),
    )
    assert got == expected and any(" " in unit for _, _, unit, _ in got) and any(c == "d" for c, *_ in got)


def test_segmentation_writes_nothing_for_a_document(spark, tmp_path):
    """The disk that a batch takes goes with its queries, not with the texts."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(2, 3000)}" for _ in range(300)) for _ in range(500)]
    postings = [("c", i, int(w[1:]), 1) for i, t in enumerate(texts) for w in sorted(set(t.split()))]
    before = size(spark.conf.get("spark.checkpoint.dir"))
    got, expected = segmented(
        spark, tmp_path, documents=spark.createDataFrame([("c", i, t, None) for i, t in enumerate(texts)], DOCUMENT), term_dict=spark.createDataFrame([(f"w{i}", i) for i in range(2, 3001)], "term string, term_id bigint"),
        postings=spark.createDataFrame([(c, t, d, n) for c, d, t, n in postings], "collection string, term_id bigint, doc_id bigint, f_dt bigint"),
        query_token=spark.createDataFrame([("c", q, p, [int(texts[q].split()[p][1:])], None, 1) for q in range(20) for p in range(4)], TOKEN),
    )
    assert got == expected
    assert size(spark.conf.get("spark.checkpoint.dir")) - before < size(f"{tmp_path}/documents.parquet") / 4
