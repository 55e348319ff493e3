"""Collections as Parquet tables under one root, and the text files they can be made from."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexisift.operators import analyze, phrases, querying
from lexisift.operators import search as searching
from lexisift.operators.checkpoints import cut, exists
from lexisift.sources.tables import spread

#: The tables of a collection root and the columns that each must have.
TABLES = {
    "documents": {"collection", "doc_id", "text", "name"},
    "dictionary": {"term", "term_id"},
    "postings": {"collection", "term_id", "doc_id", "f_dt", "w_d"},
    "positions": {"collection", "term_id", "doc_id", "positions", "w_d"},
    "terms": {"collection", "term_id", "dfreq", "cfreq", "max_tf"},
    "lengths": {"collection", "doc_id", "w_d"},
    "stats": {"collection", "n_docs", "n_symbols", "avgdl", "min_w_d"},
}
#: Tables whose rows lie by document, in the order of their terms within each file.
BY_DOCUMENT = ("postings", "positions")
#: Bytes of documents, as stored, for each bucket; there are at least twice as many buckets as cores.
BUCKET_BYTES = 256 << 20
#: The same as a number of documents, where their size isn't known.
BUCKET_DOCUMENTS = 200_000

_BUCKETED, _DOCUMENT, _ORDER = ["doc_id"], ["collection", "doc_id"], ["collection", "term_id", "doc_id"]


def is_valid(spark: SparkSession, path: str) -> bool:
    """Whether `path` holds all tables of a collection with their columns."""
    return not problems(spark, path)


def problems(spark: SparkSession, path: str, tables: tuple[str, ...] = tuple(TABLES)) -> list[str]:
    """What keeps `path` from being a collection: missing tables or columns."""
    found = []
    for name in tables:
        try:
            missing = TABLES[name] - set(spark.read.parquet(f"{path}/{name}").columns)
        except Exception as e:  # Spark has no narrower class for a missing path
            found.append(f"{name}: {str(e).splitlines()[0]}")
            continue
        if missing:
            found.append(f"{name}: no columns {sorted(missing)}")
    return found


def _by_document(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A saved table by document. Its buckets, which a path alone doesn't tell, are known to the session's catalogue."""
    known = f"lexisift_{name}_{hashlib.md5(path.encode()).hexdigest()}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{name}").schema.fields)
    n = spark.read.parquet(f"{path}/layout").first()["n_buckets"]
    spark.sql(f"DROP TABLE IF EXISTS {known}")
    spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet CLUSTERED BY ({', '.join(_BUCKETED)}) SORTED BY ({', '.join(_ORDER)}) INTO {n} BUCKETS LOCATION '{path}/{name}'")
    return spark.table(known)


def _buckets(documents: DataFrame) -> int:
    """The number of buckets, by the cores and by the stored size of the documents, as the optimizer knows it, or their number if it doesn't."""
    stored = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = stored // BUCKET_BYTES if stored < 1 << 60 else documents.count() // BUCKET_DOCUMENTS
    return max(2 * documents.sparkSession.sparkContext.defaultParallelism, by_size)


@dataclass(frozen=True)
class Collection:
    """The tables of one or more collections, told apart by the column `collection`."""

    documents: DataFrame
    dictionary: DataFrame
    postings: DataFrame
    positions: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame
    buckets: int | None = None  # of postings and positions, once saved

    @classmethod
    def build(cls, documents: DataFrame, dictionary: DataFrame | None = None, lists: DataFrame | None = None) -> Collection:
        """From documents (collection, doc_id, text, name): terms, postings, positions and statistics.

        dictionary: (term, term_id); ids are given in order of the terms, from 2, if there is
        none. lists: delivered postings (collection, term_id, doc_id, f_dt), instead of those
        of the texts. Documents without a doc_id are left out.
        """
        documents = documents.filter("doc_id IS NOT NULL")
        n = _buckets(documents)
        if dictionary is None:
            dictionary = numbered(analyze.tokens(documents).select("term").distinct())
        places = analyze.positions(spread(documents), dictionary, n)
        if lists is None:
            postings = places.select(*_ORDER, F.size("positions").cast("bigint").alias("f_dt"), "w_d")
            lengths = analyze.doc_lengths(documents)
        else:
            clean = analyze.clean_postings(lists.repartition(n, *_BUCKETED))
            postings, lengths = analyze.with_lengths(clean), analyze.doc_lengths_of(clean, documents)
        return cls(documents, dictionary, postings, places, analyze.term_stats(postings, "term_id"), lengths, analyze.collection_stats(lengths))

    @classmethod
    def open(cls, spark: SparkSession, path: str, documents: DataFrame | None = None) -> Collection:
        """The collection saved at `path`; ValueError if it isn't one. documents: those of a collection that was saved without."""
        names = tuple(n for n in TABLES if n != "documents" or documents is None)
        if bad := problems(spark, path, names):
            raise ValueError(f"{path} is no collection: {'; '.join(bad)}")
        tables = {n: _by_document(spark, path, n) if n in BY_DOCUMENT else spark.read.parquet(f"{path}/{n}") for n in names}
        return cls(**({"documents": documents} if documents is not None else {}), **tables, buckets=spark.read.parquet(f"{path}/layout").first()["n_buckets"])

    def save(self, path: str, with_documents: bool = True) -> None:
        """Writes all tables; `path` must not be read from by this collection.

        Postings and positions are parted by document as build() has partitioned them, all
        terms of a document in one bucket, and ordered by term within it: a search adds up
        documents where they are read, and finds a term by the files' statistics. Statistics
        are made from the written tables.
        """
        spark = self.postings.sparkSession
        n = _buckets(self.documents)
        spark.createDataFrame([(n,)], "n_buckets bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
        for name in BY_DOCUMENT:
            told = f"lexisift_saved_{name}_{hashlib.md5(path.encode()).hexdigest()}"
            spark.sql(f"DROP TABLE IF EXISTS {told}")
            getattr(self, name).write.bucketBy(n, *_BUCKETED).sortBy(*_ORDER).option("path", f"{path}/{name}").mode("overwrite").saveAsTable(told)
            spark.sql(f"DROP TABLE {told}")
        (self.documents if with_documents else self.documents.limit(0)).write.mode("overwrite").parquet(f"{path}/documents")
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
        postings = _by_document(spark, path, "postings")
        analyze.term_stats(postings, "term_id").write.mode("overwrite").parquet(f"{path}/terms")
        told = postings.select(*_DOCUMENT, "w_d").distinct()
        every = self.documents.filter("doc_id IS NOT NULL").select(*_DOCUMENT)
        every.join(told, _DOCUMENT, "left").withColumn("w_d", F.coalesce("w_d", F.lit(1).cast("bigint"))).write.mode("overwrite").parquet(f"{path}/lengths")
        analyze.collection_stats(spark.read.parquet(f"{path}/lengths")).write.mode("overwrite").parquet(f"{path}/stats")

    def sizes(self) -> DataFrame:
        """(collection, n_postings, n_documents, n_symbols): a report of what the tables hold."""
        lists = self.terms.groupBy("collection").agg(F.sum("dfreq").alias("n_postings"))
        return self.stats.join(lists, "collection", "left").select("collection", F.coalesce("n_postings", F.lit(0)).alias("n_postings"), F.col("n_docs").alias("n_documents"), "n_symbols")

    def parse(self, lines: DataFrame, unknown: str = "drop", most_chars: int | None = None) -> DataFrame:
        """Units of query lines (collection, line), of any length unless `most_chars` is given."""
        return querying.parse(lines, self.dictionary, unknown, most_chars=most_chars).select("collection", "qid", F.array("term_id").alias("unit"), "f_qt")

    def phrase_lists(self, units: DataFrame) -> DataFrame:
        return phrases.phrase_postings(self.positions, self.terms, units.filter(F.size("unit") > 1))

    def search(self, units: DataFrame, k: int = 10, ranker: str = "bm25", mode: str = "or", with_phrases: bool = False) -> DataFrame:
        """See search.search(); units of several ids are phrases and need `with_phrases`."""
        return searching.search(units, self.postings, self.terms, self.stats, k, ranker, mode, self.phrase_lists(units) if with_phrases else None, self.buckets)

    def search_one(self, units: DataFrame, k: int = 10, ranker: str = "bm25", mode: str = "or", with_phrases: bool = False) -> DataFrame:
        """See search.search_one()."""
        return searching.search_one(units, self.postings, self.terms, self.stats, k, ranker, mode, self.phrase_lists(units) if with_phrases else None, self.buckets)

    def candidates(self, units: DataFrame, ranker: str = "bm25", mode: str = "or", with_phrases: bool = False) -> DataFrame:
        """See search.candidates()."""
        return searching.candidates(units, self.postings, self.terms, self.stats, ranker, mode, self.phrase_lists(units) if with_phrases else None, self.buckets)

    def profile(self, units: DataFrame, with_phrases: bool = False) -> DataFrame:
        """See search.profile()."""
        return searching.profile(units, self.postings, self.terms, self.stats, self.phrase_lists(units) if with_phrases else None, self.buckets)


def space(spark: SparkSession, path: str) -> DataFrame:
    """(name, n_files, bytes): what each table of a saved collection takes on disk. Only the folder is listed."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -2)
    return listed.groupBy(name.alias("name")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def space_row(spark: SparkSession, path: str) -> DataFrame:
    """(row): the bytes of postings, positions, statistics of terms, dictionary and lengths, parted by `;`; 0 where there is none."""
    columns = ("postings", "positions", "terms", "dictionary", "lengths")
    sums = [F.coalesce(F.sum(F.when(F.col("name") == c, F.col("bytes"))), F.lit(0)).cast("string") for c in columns]
    return space(spark, path).agg(F.concat_ws(";", *sums).alias("row"))


def numbered(terms: DataFrame) -> DataFrame:
    """(term, term_id): ids from 2 in the order of the terms, without one task seeing all of them.

    Terms are range-partitioned and sorted; each partition's ids begin behind the earlier ones.
    """
    placed = terms.repartitionByRange("term").sortWithinPartitions("term").withColumn("part", F.spark_partition_id())
    placed = cut(placed.withColumn("i", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("bigint"), 33)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per partition
    return placed.join(F.broadcast(before), "part").select("term", (F.col("i") + F.col("before") + 2).alias("term_id"))


def from_string(spark: SparkSession, text: str, name: str = "toy") -> DataFrame:
    """Documents (collection, doc_id, text, name) of a string in which `#` ends each document and each character is a term.

    The terms are parted by blanks in `text`. ValueError unless the string ends in `#`.
    """
    if not text.endswith("#"):
        raise ValueError("the string must end in #")
    rows = [(name, i, " ".join(t), f"DOCUMENT {i + 1}") for i, t in enumerate(text[:-1].split("#"))]
    return spark.createDataFrame(rows, "collection string, doc_id bigint, text string, name string")


def symbols(text: str) -> list[int]:
    """The symbol sequence of from_string()'s argument: ids from 2 in order of appearance, 1 ends a document, 0 the collection."""
    ids: dict[str, int] = {}
    return [1 if c == "#" else ids.setdefault(c, len(ids) + 2) for c in text] + [0]


def create_toy(spark: SparkSession, text: str, path: str, name: str = "toy") -> Collection:
    """The collection of from_string(), saved at `path`, with ids in order of appearance; ValueError if `path` exists.

    Characters that are no letters or digits are no terms, as in any text; the case of letters counts for nothing.
    """
    if exists(spark, path):
        raise ValueError(f"{path} exists")
    documents = from_string(spark, text, name)
    seen = dict.fromkeys(c for c in text.lower() if c.isalnum())
    dictionary = spark.createDataFrame([(c, i + 2) for i, c in enumerate(seen)], "term string, term_id bigint")
    Collection.build(documents, dictionary).save(path)
    return Collection.open(spark, path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, line): the lines of text files, numbered from 0 over all files in the order of their names.

    Lines are numbered within each split of a file, and the number of those in earlier splits
    is added: no task reads more than a split.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"))
    split = ["file", "begin"]
    sizes = read.groupBy(*split).agg(F.count("*").alias("n"))
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    before = sizes.select(*split, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = read.withColumn("i", F.row_number().over(Window.partitionBy(*split).orderBy("at")) - 1)
    return placed.join(before, split).select((F.col("i") + F.col("before")).cast("bigint").alias("number"), F.col("value").alias("line"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, term_id) of text files of lines `term id`. The last line of a term, in the order of files and lines, holds; lines without a whole number are left out."""
    parts = F.split("value", " ", 2)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(at.alias("at"), parts[0].alias("term"), F.get(parts, F.lit(1)).try_cast("bigint").alias("term_id"))
    return lines.filter("term_id IS NOT NULL").groupBy("term").agg(F.max_by("term_id", "at").alias("term_id"))


def read_doc_names(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name) of text files of names, a document's id being its line, from 0."""
    return numbered_lines(spark, path).select(F.col("number").alias("doc_id"), F.col("line").alias("name"))


def read_url_order(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """(doc_id, name, doc_order): documents in the order of files of lines `url name`; null where the files lack the name."""
    listed = numbered_lines(spark, path).filter("line <> ''").select(F.col("number").alias("doc_order"), F.get(F.split("line", " ", 2), F.lit(1)).alias("name"))
    return names.join(listed.groupBy("name").agg(F.min("doc_order").alias("doc_order")), "name", "left").select("doc_id", "name", "doc_order")


def read_queries(spark: SparkSession, path: str, most_chars: int | None = querying.MOST_LINE_CHARS) -> DataFrame:
    """(line) of a query file as a client reads it, without the lines that are too long; all lines, as a batch does, if `most_chars` is None."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines if most_chars is None else lines.filter(F.length("line") < most_chars)


def read_symbols(spark: SparkSession, path: str, width: int = 8) -> DataFrame:
    """(doc_id, pos, term_id) of files of little-endian whole numbers of `width` bytes: 1 ends a document, 0 the collection.

    Each file is a run of whole documents and is read by one task; documents are numbered
    over all files in the order of their names.
    """
    if width not in (1, 2, 4, 8):
        raise ValueError("width must be 1, 2, 4 or 8")

    def docs(frames):
        for f in frames:
            for file, content in zip(f["path"], f["content"]):
                x = np.frombuffer(content, f"<u{width}").astype(np.int64)
                x = x[x != 0]
                doc = np.cumsum(x == 1) - (x == 1)
                starts = np.concatenate([[0], np.flatnonzero(x == 1) + 1])
                keep = x != 1
                yield pd.DataFrame({"file": file, "doc": doc[keep], "pos": (np.arange(len(x)) - starts[doc])[keep], "term_id": x[keep]})
                yield pd.DataFrame({"file": [file], "doc": [int((x == 1).sum())], "pos": [-1], "term_id": [-1]})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(docs, "file string, doc bigint, pos bigint, term_id bigint")
    ends = rows.filter("pos = -1").select("file", F.col("doc").alias("n"))
    before = ends.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per file
    return rows.filter("pos >= 0").join(F.broadcast(before), "file").select((F.col("doc") + F.col("before")).alias("doc_id"), "pos", "term_id")


def read_pages(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Documents (collection, doc_id, text, name) of text or HTML files, a document a file; tags are dropped, ids follow a hash of the name."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.decode("content", "UTF-8").alias("raw"))
    return files.select(F.lit(collection).alias("collection"), F.xxhash64("name").alias("doc_id"), _without_tags(F.col("raw")).alias("text"), "name")


def _tagged(name: str) -> object:
    """The content of the first element `name` of the column `raw`."""
    return F.regexp_extract("raw", rf"(?is)<{name}[^<>]*>(.*?)</{name}>", 1)


def _without_tags(raw) -> object:
    return F.regexp_replace(F.regexp_replace(raw, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^<>]*>", " ")


def read_trec(spark: SparkSession, path: str, collection: str, web: bool = False) -> DataFrame:
    """Documents (collection, doc_id, text, name) of files of `<DOC>` elements, several a file; files are split between them.

    The name is that of `<DOCNO>`, ids follow a hash of it. `web`: what stands before the end of
    `<DOCHDR>` is no text. Tags are dropped; what has no `<DOCNO>` is no document.
    """
    raw = spark.read.option("lineSep", "</DOC>").text(path).select(F.col("value").alias("raw"))
    named = raw.select(F.trim(_tagged("DOCNO")).alias("name"), F.regexp_replace("raw", r"(?is)^.*?</DOCNO>", "").alias("rest")).filter("name <> ''")
    body = F.regexp_replace("rest", r"(?is)^.*?</DOCHDR>", "") if web else F.col("rest")
    return named.select(F.lit(collection).alias("collection"), F.xxhash64("name").alias("doc_id"), _without_tags(body).alias("text"), "name")


def read_warc(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Documents (collection, doc_id, text, name) of the responses in uncompressed WARC files; files are split between records.

    The name is the record's WARC-TREC-ID, else its WARC-Target-URI; ids follow a hash of it.
    HTTP headers and tags are dropped; other kinds of records are no documents.
    """
    raw = spark.read.option("lineSep", "WARC/1.0\r\n").text(path).select(F.col("value").alias("raw")).filter(F.col("raw").rlike(r"(?im)^WARC-Type:\s*response"))
    head, rest = F.substring_index("raw", "\r\n\r\n", 1), F.regexp_replace("raw", r"(?s)^.*?\r\n\r\n", "")
    field = lambda name: F.trim(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1))
    name = F.when(field("WARC-TREC-ID") != "", field("WARC-TREC-ID")).otherwise(field("WARC-Target-URI"))
    body = F.regexp_replace(rest, r"(?s)^HTTP/.*?\r\n\r\n", "")
    return raw.select(F.lit(collection).alias("collection"), F.xxhash64(name).alias("doc_id"), _without_tags(body).alias("text"), name.alias("name")).filter("name <> ''")
