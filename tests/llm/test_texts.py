"""Packing, mixing and languages."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisift.llm import cube, language_model, languages, mixing, packing, tokens

DOCS = "doc_id bigint, text string, source string, lang string, tokens string, bucket string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, lang, "clash", "clash") for i, t, s, lang in rows], DOCS)


def test_token_counts_of_odd_texts():
    long = "wort " * 90_000
    assert tokens.count(["", "hello world", "<|endoftext|>"])[0] == 0
    assert tokens.count([long]) == [len(tokens.encoding(tokens.VOCABULARY).encode_ordinary(long))]
    assert "".join(tokens.parts(long)) == long and len(list(tokens.parts(long))) > 2 and list(tokens.parts("x" * 450_000)) == ["x" * 450_000]
    for odd in ("ab" * 150_000, "城市的人们卖掉了旧磨坊。" * 20_000, "a\n" * 150_000, " " * 250_000 + "x y" * 40_000):
        assert tokens.count([odd]) == [len(tokens.encoding(tokens.VOCABULARY).encode_ordinary(odd))]


@given(st.lists(st.integers(0, 50), max_size=120), st.integers(50, 90))
@settings(max_examples=100, deadline=None)
def test_assignment_respects_capacity(sizes, capacity):
    of = packing.assign(np.array(sizes, np.int64), capacity)
    used = np.bincount(of, sizes) if sizes else np.zeros(1)
    assert (used <= capacity).all() and len(of) == len(sizes)


def test_assignment_fills_and_balances():
    rng = np.random.default_rng(0)
    sizes = np.minimum(rng.lognormal(4.5, 1, 20_000).astype(int) + 5, 4096)
    of = packing.assign(sizes, 4096)
    assert sizes.sum() / (4096 * (of.max() + 1)) > 0.98
    cost = np.bincount(of, packing.LINEAR * sizes + sizes**2 / 4096)
    assert np.percentile(cost, 95) < 2 * np.median(cost)
    with pytest.raises(ValueError):
        packing.assign(np.array([5000]), 4096)


@pytest.mark.parametrize("bucket", [20_000, 7])
def test_pack(spark, monkeypatch, bucket):
    monkeypatch.setattr(packing, "BUCKET_DOCUMENTS", bucket)
    rng = random.Random(2)
    texts = [None, "", "word " * 1000, "word " * 100, *("word " * rng.randint(1, 90) for _ in range(40))]
    df = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "lost", None, None)])
    rows = packing.pack(df, 100).collect()
    sizes = dict(enumerate(tokens.count([t or "" for t in texts])))
    by_doc, used = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["tokens"]))
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["tokens"]
    assert max(used.values()) <= 100 and set(by_doc) == set(sizes)
    for d, parts in by_doc.items():
        assert sorted(p for p, _ in parts) == list(range(max(1, -(-sizes[d] // 100)))) and sum(n for _, n in parts) == sizes[d]
    assert {d for d, p in by_doc.items() if len(p) > 1} == {d for d, n in sizes.items() if n > 100}
    fill = packing.fill(packing.pack(df, 100), 100).first()
    assert (fill["n_documents"], fill["tokens"], fill["n_containers"]) == (len(texts), sum(sizes.values()), len(used))
    assert fill["mean_cost"] == pytest.approx(sum(packing.LINEAR * r["tokens"] + r["tokens"] ** 2 / 100 for r in rows) / len(used)) and fill["highest_cost"] >= fill["mean_cost"]


def test_pack_nothing(spark):
    none = docs_of(spark, []).filter("false")
    assert packing.pack(none, 100).count() == 0
    assert packing.fill(packing.pack(none, 100), 100).first()["n_containers"] == 0
    with pytest.raises(ValueError):
        packing.pack(none, 0)


@given(st.lists(st.tuples(st.integers(0, 400), st.floats(0, 1)), max_size=60), st.integers(0, 9))
@settings(max_examples=100, deadline=None)
def test_flight_keeps_both_totals(units, seed):
    x, p = np.array([u[0] for u in units], float), np.array([u[1] for u in units])
    f = cube.flight(x, p, seed)
    assert ((f >= 0) & (f <= 1)).all() and ((f > 0) & (f < 1)).sum() <= 2
    assert f.sum() == pytest.approx(p.sum(), abs=1e-6) and (f * x).sum() == pytest.approx((p * x).sum(), abs=1e-3)
    assert set(cube.landing(x, f)) <= {0.0, 1.0}


def test_flight_is_fair_above_the_largest_units(monkeypatch):
    monkeypatch.setattr(cube, "LARGEST", 20)
    rng = np.random.default_rng(4)
    x, p = rng.lognormal(4, 1, 80), rng.uniform(0.1, 0.9, 80)
    assert np.mean([cube.flight(x, p, s) for s in range(2500)], 0) == pytest.approx(p, abs=0.055)


def test_flight_is_fair():
    x, p = np.array([100, 50, 50, 20, 300, 70, 10.0]), np.array([0.4, 0.2, 0.9, 0.5, 0.5, 0.3, 0.6])
    assert np.mean([cube.flight(x, p, s) for s in range(3000)], 0) == pytest.approx(p, abs=0.04)


@pytest.mark.parametrize("bucket", [50_000, 40, 8])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_DOCUMENTS", bucket)
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(1, 60), rng.choice(["A.x", " a.X ", "b.x", "B.X ", "c.x", None, "other"]), None) for i in range(600)] + [(900, None, "a.x", None), (901, "", "b.x", None), (None, "word", "a.x", None)]
    targets = spark.createDataFrame([("a.x", 0.2, 1), ("b.x", 0.5, 3), ("C.x", 0.3, 1), ("none.x", 0.0, 5), ("gone.x", 0.1, 2)], "source string, target_share double, max_repeats bigint")
    m = mixing.mix(docs_of(spark, rows), targets)
    sizes = dict(zip((r[0] for r in rows), tokens.count([r[1] or "" for r in rows])))
    chosen = m.chosen.collect()
    assert len({r["doc_id"] for r in chosen}) == len(chosen) and all(r["tokens"] == sizes[r["doc_id"]] for r in chosen)
    report = {r["source"]: r for r in m.report().collect()}
    of = {"a.x": "a.x", "b.x": "b.x", "c.x": "C.x"}
    size = {t: sum(sizes[i] for i, _, s, _ in rows if i is not None and s and s.strip().lower() == t.lower()) for t in report}
    total = sum(size.values())
    for t, r in report.items():
        assert r["size"] == size[t] and r["short"] == (r["max_repeats"] * size[t] < r["target_share"] * total)
        copies = [c["copies"] for c in chosen if c["source"] == t]
        assert max(copies, default=0) <= r["max_repeats"]
        if not r["short"]:
            assert abs(r["reached"] - r["wanted"]) <= 60
        else:
            assert r["reached"] == r["max_repeats"] * size[t]
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1) and of
    assert sorted(map(tuple, mixing.mix(docs_of(spark, rows), targets).chosen.collect())) == sorted(map(tuple, chosen))
    half = {r["source"]: r for r in mixing.mix(docs_of(spark, rows), targets, total=total // 2).report().collect()}
    assert all(r["wanted"] == r["target_share"] * (total // 2) for r in half.values()) and not half["a.x"]["short"]


def test_shortage_is_told_by_the_mix(spark):
    """The plan of the report holds the flights and the landing."""
    rows = [(i, "word " * (i + 1), "ab"[i % 2], None) for i in range(60)]
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats bigint")
    short = mixing.mix(docs_of(spark, rows), targets).report().filter("short").select("source")
    assert [r[0] for r in short.collect()] == ["a"]
    assert "FlatMapGroupsInArrow" in short._jdf.queryExecution().executedPlan().toString()


def test_mix_nothing(spark):
    targets = spark.createDataFrame([("a.x", 1.0, 1)], "source string, target_share double, max_repeats bigint")
    m = mixing.mix(docs_of(spark, [(1, "x", "b", None)]).filter("false"), targets)
    assert m.chosen.count() == 0 and m.report().first()["size"] == 0
    with pytest.raises(ValueError):
        mixing.mix(docs_of(spark, [(1, "x", "b", None)]), targets.union(targets))


SENTENCES = {
    "en": ["The council of the town opened the new library.", "There are many pages about the river and the old mill.", "We thank the people who have closed the market after a long debate.", "In the spring of that year the theatre was sold."],
    "de": ["Der Rat der Stadt eröffnete die neue Bücherei.", "Es gibt viele Seiten über den Fluss und die alte Mühle.", "Wir danken den Leuten, die den Markt nach einer langen Aussprache geschlossen haben.", "Im Frühjahr dieses Jahres wurde das Theater verkauft."],
    "es": ["El consejo de la ciudad abrió la nueva biblioteca.", "Hay muchas páginas sobre el río y el viejo molino.", "Damos las gracias a la gente que cerró el mercado después de un largo debate.", "En la primavera de ese año vendieron el teatro."],
    "it": ["Il consiglio della città ha aperto la nuova biblioteca.", "Ci sono molte pagine sul fiume e sul vecchio mulino.", "Ringraziamo la gente che ha chiuso il mercato dopo una lunga discussione.", "Nella primavera di quell'anno hanno venduto il teatro."],
}


@pytest.fixture(scope="module")
def model():
    return language_model.fit([(lang, s) for lang, ss in SENTENCES.items() for s in ss])


def test_machines_and_held_out_sentences(model):
    assert sorted(k for k, _, _ in model.pairs) == ["", "Germanic", "Romance"]
    held_out = {"en": "The people of the town have sold the old mill.", "de": "Die Leute der Stadt haben die alte Mühle verkauft.", "es": "La gente de la ciudad vendió el viejo molino.", "it": "La gente della città ha venduto il vecchio mulino."}
    found, sure = model.predict([*held_out.values(), "12 345", held_out["de"].upper(), "Der R0man des We1tal1s w0hnt in der Stadt."])
    assert found == [*held_out, None, "de", "de"] and sure[4] == 0 and (sure[:4] > 0.5).all() and (sure <= 1).all()


def test_sentences_cover_the_text():
    text = "Eins. Zwei!<br>Drei &amp; mehr?\n\nVier “fünf”. Sechs"
    assert [s.strip() for _, s in languages.sentences(text)] == ["Eins.", "Zwei!", "Drei & mehr?", "Vier “fünf”.", "Sechs"]
    assert [text[i] for i, _ in languages.sentences(text)] == ["E", "Z", "D", "V", "S"]
    assert [len(s) for _, s in languages.sentences("x" * 50_000)] == [50_000]


def test_segments(spark, model):
    e, d = SENTENCES["en"], SENTENCES["de"]
    rows = [
        (1, " ".join(e), None, "en-GB"), (2, " ".join(e), None, "Deutsch"), (3, f"{e[0]} {d[0]} {d[1]} {e[1]}", None, "en"), (4, " ".join(d), None, None), (5, None, None, "en"), (6, "", None, "xx"),
        (7, "123 456.", None, "en"), (8, e[0][:-1] + " (“der Rat der Stadt”).", None, "ENG"), (None, e[0], None, "en"), (9, " ".join(d * 300), None, "German"),
    ]
    found = languages.language_segments(docs_of(spark, rows), model)
    by_doc = {}
    for r in found.orderBy("doc_id", "seg_no").collect():
        assert 0.5 < r["confidence"] <= 1 and r["seg_no"] == len(by_doc.get(r["doc_id"], []))
        by_doc.setdefault(r["doc_id"], []).append((r["lang"], r["n_sentences"]))
    assert by_doc == {1: [("en", 4)], 2: [("en", 4)], 3: [("en", 1), ("de", 2), ("en", 1)], 4: [("de", 4)], 8: [("en", 1)], 9: [("de", 1200)]}
    wrong = {(r["doc_id"], r["seg_no"], r["lang"]) for r in languages.wrongly_labelled(found).collect()}
    assert wrong == {(2, 0, "en"), (3, 0, "en"), (3, 1, "de"), (3, 2, "en"), (4, 0, "de")}


def test_unsure_sentences_follow_their_neighbours():
    assert languages.segments([(0, "it", 0.3), (5, "en", 0.9), (9, "de", 0.4), (12, "en", 0.9)]) == [(0, "en", pytest.approx(0.625), 4)]
    assert languages.segments([(0, "it", 0.3)]) == [(0, "it", 0.3, 1)] and languages.segments([]) == []


def test_fitting_with_documents(spark):
    samples = spark.createDataFrame([(lang, i, s) for lang, ss in SENTENCES.items() for i, s in enumerate(ss)] + [(None, 1, "x"), ("en", 9, None)], "lang string, sample_no bigint, text string")
    rows = [(i, " ".join(SENTENCES[lang]), None, label) for i, (lang, label) in enumerate([("en", "eng"), ("de", "ger"), ("de", "en"), ("it", "Italian"), ("it", None)])]
    model = languages.fit_model(docs_of(spark, rows), samples)
    assert model.langs == ["de", "en", "es", "it"] and model.predict(SENTENCES["it"])[0] == ["it"] * 4


def test_no_samples(spark):
    empty = language_model.fit([])
    assert languages.language_segments(docs_of(spark, [(1, "The town.", None, "en")]), empty).count() == 0


def test_labels(spark):
    names = languages.language_names(spark, ["en", "de", "deu-x"])
    known = {"en": "en", " EN ": "en", "en_US": "en", "German": "de", "fr-CH": "fr", "ger": "de", "Español": "es", "pl": "pl", "Polish": "pl", "polski": "pl", "rus": "ru", "Русский": "ru", "chi": "zh", "dut": "nl"}
    assert {x: languages.label_language(x, names) for x in known} == known
    assert [languages.label_language(x, names) for x in ("xx", "", None, "und", "unknown", "  ")] == [None] * 6
    assert languages.label_language("German", languages.language_names(spark, ["deu"])) == "deu"


OTHER_SCRIPTS = {
    "ru": ["Совет города открыл новую библиотеку.", "Есть много страниц о реке и старой мельнице.", "Мы благодарим людей, которые закрыли рынок после долгих споров.", "Весной того года театр был продан."],
    "uk": ["Рада міста відкрила нову бібліотеку.", "Є багато сторінок про річку та старий млин.", "Ми дякуємо людям, які закрили ринок після довгих суперечок.", "Навесні того року театр було продано."],
    "el": ["Το συμβούλιο της πόλης άνοιξε τη νέα βιβλιοθήκη.", "Υπάρχουν πολλές σελίδες για το ποτάμι και τον παλιό μύλο.", "Ευχαριστούμε τους ανθρώπους που έκλεισαν την αγορά.", "Την άνοιξη εκείνου του έτους πουλήθηκε το θέατρο."],
    "zh": ["市议会开设了新图书馆。", "关于河流和旧磨坊的书页很多。", "我们感谢经过长时间辩论后关闭市场的人们。", "那年春天剧院被卖掉了。"],
    "ar": ["افتتح مجلس المدينة المكتبة الجديدة.", "هناك صفحات كثيرة عن النهر والمطحنة القديمة.", "نشكر الناس الذين أغلقوا السوق بعد نقاش طويل.", "في ربيع تلك السنة بيع المسرح."],
}


def test_other_scripts(spark):
    """Every script is judged: held-out sentences, whole documents, and segments of several scripts."""
    model = language_model.fit([(lang, s) for lang, ss in (SENTENCES | OTHER_SCRIPTS).items() for s in ss])
    assert model.langs == sorted(SENTENCES | OTHER_SCRIPTS)
    held_out = {"ru": "Люди города продали старую мельницу.", "uk": "Люди міста продали старий млин.", "el": "Οι άνθρωποι της πόλης πούλησαν τον παλιό μύλο.", "zh": "城市的人们卖掉了旧磨坊。", "ar": "باع سكان المدينة المطحنة القديمة."}
    found, sure = model.predict(list(held_out.values()))
    assert found == list(held_out) and (sure > 0.5).all()
    rows = [(1, held_out["ru"], None, "ru"), (2, held_out["el"], None, "el-GR"), (3, f"{SENTENCES['en'][0]} {held_out['ru']}", None, "en"), (4, held_out["ar"], None, "Polish")]
    segments = languages.language_segments(docs_of(spark, rows), model)
    assert [(r["doc_id"], r["seg_no"], r["lang"]) for r in segments.orderBy("doc_id", "seg_no").collect()] == [(1, 0, "ru"), (2, 0, "el"), (3, 0, "en"), (3, 1, "ru"), (4, 0, "ar")]
    assert {(r["doc_id"], r["lang"]) for r in languages.wrongly_labelled(segments).collect()} == {(3, "en"), (3, "ru"), (4, "ar")}
    with pytest.raises(ValueError, match="de"):
        language_model.fit([("ru", "Совет города."), ("de", "12 34")])


def test_quoted_and_long_sentences(model):
    """A quoted title doesn't count, a quoted sentence does; a sentence in parts is judged as in one."""
    en, de = SENTENCES["en"], SENTENCES["de"]
    assert model.predict([f"“{de[0]}”", f'("{en[1]}")', f"{en[0][:-1]} “{de[0]}”.", "“12”", ""])[0] == ["de", "en", "en", None, None]
    long = [" ".join(x.rstrip(".") for x in ss) * 900 for ss in (en, de)]
    assert all(len(x) > 4 * language_model.PART_CHARS for x in long)
    found, sure = model.predict(["x1", *long, "die Stadt"])
    assert found[1:] == ["en", "de", "de"] and (sure[1:3] > 0.5).all()
    assert model.predict([long[1]])[1][0] == pytest.approx(sure[2])


def folded(text):
    codes, begins = language_model.fold(text)
    return ["".join(map(chr, x[:-1])) for x in np.split(codes, begins[1:])]


def test_folding():
    assert folded(["Éa, B-c!", "", "12", "Der R0man 1st 2012 c001", "ß’s “x” y", "Йод α̂"]) == [" ea b c ", " ", " ", " der roman lst cool ", " ss's y ", " иод α "]
    assert folded(["a\0b"]) == [" a b "] and folded(["हिन्दी", "한국"])[0] == " हिन्दी "


@given(st.lists(st.text("ab ,é\u0301π0", max_size=12), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_ngrams_stay_in_their_sentences(sentences):
    """The buckets of sentences together are those of each alone."""
    def per_sentence(ss):
        codes, begins = language_model.fold(ss)
        out = []
        for bucket in language_model.grams(codes, begins):
            out.append([sorted(x[x < language_model.BUCKETS].tolist()) for x in np.split(bucket, begins[1:])])
        counts = language_model._counts(codes, begins).tolist()
        assert counts == [sum(len(x[i]) for x in out) for i in range(len(ss))]
        return out

    together, alone = per_sentence(sentences), [per_sentence([s]) for s in sentences]
    assert together == [[a[n][0] for a in alone] for n in range(len(language_model.LENGTHS))]


def test_recall_and_precision_on_held_out_sentences():
    """Five folds over the labelled sentences: documents of one and of two languages, by language."""
    path = "/root/testdata/sf0.1/lang_sample.parquet"
    if not os.path.exists(path):
        pytest.skip("no labelled sentences")
    table = pq.read_table(path).to_pydict()
    pairs = sorted(zip(table["lang"], table["sample_no"], table["text"]))
    told, right, made = Counter(), Counter(), Counter()
    for fold in range(5):
        model = language_model.fit([(lang, t) for lang, i, t in pairs if i % 5 != fold])
        held = {}
        for lang, i, t in pairs:
            if i % 5 == fold:
                held.setdefault(lang, []).append(t if t.rstrip().endswith((".", "!", "?")) else f"{t}.")
        docs = [[(lang, s)] for lang, ss in held.items() for s in ss]
        docs += [[(a, s), (b, t)] for a, ss in held.items() for b, ts in held.items() if a != b for s, t in zip(ss, ts)]
        for truth, found in zip(docs, languages.judged(model, [" ".join(s for _, s in d) for d in docs])):
            expected = [(i, lang) for i, (lang, _) in enumerate(truth)]
            got = [(i, lang) for i, (_, lang, _, _) in enumerate(languages.segments(found))]
            told.update(lang for _, lang in expected)
            made.update(lang for _, lang in got)
            right.update(lang for i, lang in got if (i, lang) in expected)
    figures = {lang: (round(right[lang] / told[lang], 3), round(right[lang] / made[lang], 3)) for lang in sorted(told)}
    print(figures)
    assert all(min(x) >= 0.95 for x in figures.values()), figures
