"""The index of a data folder: built once, opened by every search."""

from __future__ import annotations

import hashlib
from uuid import uuid4

from pyspark.sql import SparkSession

from lexisift.operators.checkpoints import exists, file_states, move, shared_folder
from lexisift.sources.collection import Collection
from lexisift.sources.tables import table

_OPENED: dict[tuple[str, str], Collection] = {}


def index_path(spark: SparkSession, d: str) -> str:
    """Where the index of folder `d` is kept: in the shared folder, by the states of the files it is made from."""
    states = [d, *(x for name in ("documents", "postings", "term_dict") for x in file_states(spark, f"{d}/{name}.parquet"))]
    return f"{shared_folder(spark)}/lexisift-index-{hashlib.md5(repr(states).encode()).hexdigest()}"


def opened(spark: SparkSession, d: str) -> Collection:
    """The collection of folder `d`, with the delivered postings and dictionary; built and saved if that has not been done.

    It is written under another name and renamed when complete, so a job that fails leaves no
    half of it. Documents stay where they are.
    """
    path = index_path(spark, d)
    key = (spark.sparkContext.applicationId, path)
    if key not in _OPENED:
        documents = table(spark, d, "documents")
        if not exists(spark, path):
            made = f"{path}-{uuid4().hex}"
            Collection.build(documents, table(spark, d, "term_dict").select("term", "term_id"), table(spark, d, "postings")).save(made, with_documents=False)
            move(spark, made, path)
        _OPENED[key] = Collection.open(spark, path, documents)
    return _OPENED[key]
