"""Sizes of texts in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The vocabulary: a line per token, its bytes in base64 and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How byte-level tokenizers of this family cut a text into words before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are handed over in parts, cut before the blank of a word, where the pattern cuts anyway.
PART_CHARS = 100_000
#: Texts encoded in one call.
TEXTS = 256

_WORD = re.compile(r"[^\W_] (?=[^\W_])")


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    """The tokenizer of `vocabulary`, loaded once per worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> Iterator[str]:
    """`text` in parts of PART_CHARS characters or more that begin with the blank before a word, so that counts add up exactly.

    A part without such a blank is as long as it has to be.
    """
    at = 0
    while len(text) - at > 2 * PART_CHARS and (m := _WORD.search(text, at + PART_CHARS)):
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


def count(texts: list[str], vocabulary: str = VOCABULARY) -> list[int]:
    """The number of tokens of each text; special tokens' names are ordinary text."""
    enc, sizes = encoding(vocabulary), [0] * len(texts)
    waiting: list[tuple[int, str]] = []

    def flush() -> None:
        for (i, _), ids in zip(waiting, enc.encode_ordinary_batch([p for _, p in waiting], num_threads=1)):
            sizes[i] += len(ids)
        waiting.clear()

    for i, text in enumerate(texts):
        for p in parts(text):
            waiting.append((i, p))
            if len(waiting) >= TEXTS:
                flush()
    flush()
    return sizes


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """bigint: the tokens of `text`; 0 for null and empty texts. Arrow batches, no shuffle."""

    @F.pandas_udf(T.LongType())
    def counted(s: pd.Series) -> pd.Series:
        return pd.Series(count(s.tolist(), vocabulary), dtype="int64")

    return counted(F.coalesce(text, F.lit("")))
