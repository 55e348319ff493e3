"""Scoring functions as column expressions.

A ranker turns statistics into a contribution per query unit and a weight per document:
score = n_found * document weight + sum of contributions, where n_found is the number of
the query's units that occur in the collection. Register another one with register().
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stats:
    """f_qt: of the unit in the query; f_dt: in the document; dfreq, cfreq: documents and occurrences in the collection; w_d: the document's length; n_docs, n_symbols, avgdl: of the collection."""

    f_qt: Column
    f_dt: Column
    dfreq: Column
    cfreq: Column
    w_d: Column
    n_docs: Column
    n_symbols: Column
    avgdl: Column

    @classmethod
    def of_columns(cls) -> Stats:
        return cls(**{name: F.col(name).cast("double") for name in cls.__dataclass_fields__})


@dataclass(frozen=True)
class Ranker:
    """contribution: per unit and document; doc_weight: per document; of_unit: what depends on the unit alone, worked out once for each unit of a query and not for each of its documents. It is given to `contribution` as its second argument."""

    contribution: Callable[[Stats, Column], Column]
    doc_weight: Callable[[Stats], Column] | None = None
    of_unit: Callable[[Stats], Column] | None = None


def bm25(k1: float = 1.2, b: float = 0.75) -> Ranker:
    """Okapi BM25. A unit in half of the documents or more still contributes a little: its weight is 1e-6 at least."""

    def of_unit(s: Stats) -> Column:
        return (k1 + 1) * F.greatest(F.lit(1e-6), F.ln((s.n_docs - s.dfreq + 0.5) / (s.dfreq + 0.5)) * s.f_qt)

    return Ranker(lambda s, w: w * (s.f_dt / (k1 * ((1 - b) + b * s.w_d / s.avgdl) + s.f_dt)), of_unit=of_unit)


def lmds(mu: float = 2500.0) -> Ranker:
    """Language model with Dirichlet smoothing; f_qt isn't used, scores may be negative."""
    return Ranker(lambda s, w: F.log1p(s.f_dt * w), lambda s: F.ln(mu / (mu + s.w_d)), lambda s: s.n_symbols / s.cfreq / mu)


def tfidf() -> Ranker:
    """Logarithmic tf-idf by document length; f_qt isn't used."""
    return Ranker(lambda s, w: (1 / s.w_d) * (1 + F.ln(s.f_dt)) * w, of_unit=lambda s: F.ln(1 + s.n_docs / s.dfreq))


def freq() -> Ranker:
    """Occurrences in the document."""
    return Ranker(lambda s, w: s.f_dt)


#: bm25_simple_est differs from bm25 in the bounds of a search tree only; its scores are the same.
RANKERS: dict[str, Ranker] = {"bm25": bm25(), "bm25_simple_est": bm25(), "lmds": lmds(), "tfidf": tfidf(), "freq": freq()}


def register(name: str, ranker: Ranker) -> None:
    """Makes `ranker` available to search() under `name`."""
    if name in RANKERS:
        raise ValueError(f"a ranker {name} exists")
    RANKERS[name] = ranker
