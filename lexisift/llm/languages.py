"""Languages of documents and of the segments of mixed ones."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexisift.llm.language_model import MOST_SAMPLES, Model, fit

#: Labelled documents of each language that the second fit draws sentences from, at most ...
MOST_DOCUMENTS = 60
#: ... none longer than so many characters.
MOST_CHARS = 20_000
#: A sentence judged with less confidence takes the language of the one before it, or else after it.
UNSURE = 0.5
#: The ISO 639-2 codes that differ from ISO 639-3, by ISO 639-1 code, and further names of some languages.
MORE_NAMES = {
    "bo": "tib", "cs": "cze", "cy": "wel", "de": "ger", "el": "gre", "es": "castellano espanol castilian", "eu": "baq", "fa": "per", "fr": "fre francais", "hy": "arm", "is": "ice",
    "ka": "geo", "mi": "mao", "mk": "mac", "ms": "may", "my": "bur", "nl": "dut flemish vlaams", "pt": "portugues", "ro": "rum moldavian", "sk": "slo", "sq": "alb", "zh": "chi",
}

_BREAK = re.compile(r"[.!?…][\"”»’)\]]*\s+|\n+")
_TAG = re.compile(r"<[a-zA-Z/!][^<>]{0,500}>")
_SEGMENT = "doc_id bigint, seg_no bigint, lang string, confidence double, n_sentences bigint, begins bigint, n_segments bigint, label_lang string"
_BLANKS = " \t\n\r\u00a0\u202f"


def language_names(spark: SparkSession, langs: Iterable[str] = ()) -> dict[str, str]:
    """The code for each name of a language, in lower case: all ISO 639-1 codes, their three-letter codes, their names in English and in the language.

    They are those of the JVM's table of languages, and MORE_NAMES. `langs`: the codes to
    use; a language of the table that has one of them under another code gets that one.
    """
    jvm = spark.sparkContext._jvm
    names: dict[str, str] = {}
    for code in jvm.java.util.Locale.getISOLanguages():
        locale = jvm.java.util.Locale.forLanguageTag(code)
        own = [code, locale.getISO3Language(), locale.getDisplayLanguage(jvm.java.util.Locale.ENGLISH), locale.getDisplayLanguage(locale), *MORE_NAMES.get(code, "").split()]
        for name in own:
            names.setdefault(name.lower(), locale.getLanguage())
    used = {names.get(lang.lower(), lang): lang for lang in langs}
    return {name: used.get(code, code) for name, code in names.items()} | {lang.lower(): lang for lang in langs}


def label_language(label: str | None, names: dict[str, str]) -> str | None:
    """The code that a label names, none if it names no language: codes and names, also with a region, in any case."""
    base = (label or "").strip(_BLANKS).lower()
    return names.get(base) or names.get(re.split("[-_ ]", base, maxsplit=1)[0])


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """Where each sentence begins in `text`, and the sentence without markup. All of the text is in one of them.

    A sentence ends at a full stop, question or exclamation mark with blanks behind it, or
    at a line end or tag; it may have any length.
    """
    plain = _TAG.sub(lambda m: "\n" * len(m[0]), text) if "<" in text else text
    at = 0
    for m in [*_BREAK.finditer(plain), None]:
        end = m.end() if m else len(plain)
        piece = plain[at:end]
        if piece and not piece.isspace():
            yield at, html.unescape(piece) if "&" in piece else piece
        at = end


def judged(model: Model, texts: Iterable[str | None]) -> list[list[tuple[int, str, float]]]:
    """For each text, (begin, language, confidence) of each of its sentences that has letters."""
    done: list[list[tuple[int, str, float]]] = []
    told, begins, of = [], [], []
    for text in texts:
        for at, s in sentences(text or ""):
            told.append(s)
            begins.append(at)
            of.append(len(done))
        done.append([])
    langs, sure = model.predict(told)
    for i, at, lang, c in zip(of, begins, langs, sure.tolist()):
        if lang:
            done[i].append((at, lang, c))
    return done


def segments(found: list[tuple[int, str, float]]) -> list[tuple[int, str, float, int]]:
    """(begin, language, confidence, sentences) of each maximal run of sentences in one language; the confidence is their mean."""
    if len({lang for _, lang, _ in found}) == 1:  # most texts
        return [(found[0][0], found[0][1], sum(c for _, _, c in found) / len(found), len(found))]
    sure = [lang if c >= UNSURE else None for _, lang, c in found]
    for i in range(1, len(sure)):
        sure[i] = sure[i] or sure[i - 1]
    for i in range(len(sure) - 2, -1, -1):
        sure[i] = sure[i] or sure[i + 1]
    out: list[list] = []
    for (at, lang, c), kept in zip(found, sure):
        lang = kept or lang
        if out and out[-1][1] == lang:
            out[-1][2].append(c)
        else:
            out.append([at, lang, [c]])
    return [(at, lang, sum(cs) / len(cs), len(cs)) for at, lang, cs in out]


def fit_model(documents: DataFrame, samples: DataFrame) -> Model:
    """A model of the sample sentences, fitted again with sentences of labelled documents that it agrees with.

    samples: (lang, sample_no, text), MOST_SAMPLES sentences of each language at most.
    documents: at most MOST_DOCUMENTS of each of these languages, drawn by a hash of
    `doc_id` among those whose label names it and that have MOST_CHARS characters at most.
    Their sentences take part if the first model gives them the label's language. So the
    second model knows more words, and wrong labels don't reach it.
    """
    number = F.row_number().over(Window.partitionBy("lang").orderBy("sample_no", "text"))
    few = samples.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("i", number).filter(F.col("i") <= MOST_SAMPLES).orderBy("lang", "i").collect()
    told = [(r["lang"], r["text"]) for r in few]
    first = fit(told)
    names = {name: code for name, code in language_names(documents.sparkSession, first.langs).items() if code in first.langs}
    if not names:
        return first
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))  # some names of each language of the samples
    base = F.lower(F.trim("lang", F.lit(_BLANKS)))
    code = F.coalesce(table[base], table[F.split(base, "[-_ ]")[0]])
    coded = documents.filter((F.length("text") <= MOST_CHARS) & F.col("doc_id").isNotNull()).select("doc_id", "text", code.alias("code")).filter("code IS NOT NULL")
    order = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")  # cut per task before the shuffle
    rows = coded.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= MOST_DOCUMENTS).collect()  # of each language
    rows.sort(key=lambda r: (r["code"], r["i"]))
    taken = [(r["code"], s) for r in rows for _, s in sentences(r["text"])]
    langs, _ = first.predict([s for _, s in taken])
    return fit(told + [x for x, lang in zip(taken, langs) if lang == x[0]])


def language_segments(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, n_sentences, begins, n_segments, label_lang), a row per segment.

    documents: (doc_id, text, lang, ...). A segment is a maximal run of whole sentences in one
    language, numbered from 0; `begins` is its first character, `confidence` from 0 to 1,
    `label_lang` the code that the document's label names. A document in one language is
    one segment. Quoted titles inside a sentence don't count for its language, unless the
    sentence is nothing else. Texts that are null, empty or without letters have no segment;
    documents with a null `doc_id` are left out. Whole texts are judged, each task its own
    rows; nothing is shuffled.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model, language_names(spark, model.langs)))  # fixed by its parameters, some MB
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = [x.split()[0] for x in _SEGMENT.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, names = shared.value
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                ids, texts, labels = (c.to_pylist() for c in part.columns)
                rows = []
                for doc_id, label, found in zip(ids, labels, judged(fitted, texts)):
                    if found:
                        runs, code = segments(found), label_language(label, names)
                        rows += [(doc_id, i, lang, c, n, at, len(runs), code) for i, (at, lang, c, n) in enumerate(runs)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=columns)

    return documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang").mapInArrow(task, _SEGMENT)


def wrongly_labelled(found: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang): all segments of documents in several languages; of the others, the one whose label names another language or none.

    found: as of language_segments().
    """
    return found.filter("n_segments > 1 OR label_lang IS NULL OR label_lang <> lang").select("doc_id", "seg_no", "lang")
