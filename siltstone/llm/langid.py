"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent 1- to 3-character n-grams. The
out-of-place distance of a document from a language is the sum, over the
document's profile, of how far each n-gram's rank is from its rank in the
language's profile; an n-gram that the language lacks counts as ``PROFILE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import keep_rows, narrow
from .kernels import slices
from .scratch import Scratch, few, small_batches

#: N-grams in a profile, and the longest n-gram.
PROFILE, LONGEST = 300, 3
#: The documented bound on the labelled documents of each language that profiles are fitted on: those of the least md5 of doc_id.
TRAINING_ROWS = 2_000
#: A document is rejected if its distance from every language is more than this share of the greatest possible.
#: Of held-out documents of the given tables none is further than 0.64; random letters and unknown scripts are beyond 0.79.
REJECT = 0.75
#: The documented bound on the number of profiles: the values of ``lang`` that most rows have.
LANGUAGES = 1_000

_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Code point to code point for letters, to a space for all else."""
    import sys
    import unicodedata

    table = np.full(sys.maxunicode + 1, _SPACE, np.int64)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = c
    return table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as codes in the order of their characters, and their counts.

    The text is lower-cased, each run of characters that aren't letters becomes
    one space, and one space is put at either end; a lone space is no n-gram.
    """
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    low = np.concatenate([[_SPACE], low, [_SPACE]])
    space = low == _SPACE
    low = low[~(space & np.concatenate([[False], space[:-1]]))]
    if len(low) < 3:  # two spaces at most, so no letter
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = low[low != _SPACE] << 42
    two = (low[:-1] << 42) | (low[1:] << 21)
    three = two[:-1] | low[2:]
    code = np.concatenate([one, two, three])
    code.sort()
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[start], np.diff(np.append(start, len(code)))


def top(code: np.ndarray, count: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The codes of the ``size`` highest counts, the lesser code first among equals."""
    if len(code) > size:
        least = np.partition(count, len(count) - size)[len(count) - size]
        some = count >= least
        code, count = code[some], count[some]
    return code[np.argsort(-count, kind="stable")][:size]


class Profiles:
    """Language profiles, ready for comparison; few KB a language."""

    def __init__(self, ranked: dict[str, np.ndarray], reject: float = REJECT):
        self.names = sorted(ranked)
        self.reject = reject
        self.tables = []
        for name in self.names:
            order = np.argsort(ranked[name])
            self.tables.append((ranked[name][order], order))

    def distances(self, code: np.ndarray) -> np.ndarray:
        """Out-of-place distances of a document's ranked codes, in the order of ``names``."""
        rank = np.arange(len(code))
        out = np.empty(len(self.names), np.int64)
        for k, (codes, ranks) in enumerate(self.tables):
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            out[k] = np.where(codes[at] == code, np.abs(ranks[at] - rank), PROFILE).sum()
        return out

    def identify(self, text: str | None) -> tuple[str | None, float]:
        """The nearest language, the first by name among equals, and its distance as a share of the greatest.

        (None, 1.0) for a text without letters, or if there is no profile.
        """
        code = top(*grams(text))
        if not len(code) or not self.names:
            return None, 1.0
        d = self.distances(code)
        k = int(d.argmin())
        share = float(d[k] / (PROFILE * len(code)))
        return (self.names[k] if share <= self.reject else None), share


def train(docs: DataFrame, rows: int = TRAINING_ROWS, reject: float = REJECT) -> Profiles:
    """Profiles of the values of ``lang``, from at most ``rows`` documents of each.

    Null ids, texts and languages take no part, nor do values of ``lang`` beyond
    the ``LANGUAGES`` most frequent. Without rows there is no profile. The sample is chosen from the
    narrow columns; texts of the chosen documents alone are gathered, and their
    n-grams are counted in the executors.
    """
    from pyspark.sql import Window

    small_batches(docs.sparkSession)
    known = narrow(docs, "doc_id", "lang", "text").dropna()
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    often = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    chosen = known.select("lang", "doc_id").join(F.broadcast(often), "lang").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).select("lang", "doc_id")
    chosen = Scratch(docs.sparkSession, "langid").write(chosen, "chosen")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                code, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                total = np.bincount(back, np.concatenate([n for _, n in found]), len(code)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(total)], names=["lang", "code", "n"])

    # The sample is counted, as many rare languages may make it large.
    counts = known.select("lang", "doc_id", "text").join(few(chosen, chosen.count()), ["lang", "doc_id"]).mapInArrow(count, "lang string, code long, n long")
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= PROFILE)
    got = best.orderBy("lang", "r").toPandas()
    return Profiles({lang: part["code"].to_numpy(np.int64) for lang, part in got.groupby("lang")}, reject)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``(doc_id, language, distance)`` for each row of ``docs``, repeated rows included.

    ``language`` is null, and the document rejected, if the text is null, has no
    letter, or is further than ``profiles.reject`` from every profile; of equally
    near ones the first by name counts. A null doc_id keeps its row. No documents:
    no rows. Other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [shared.value.identify(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["doc_id", "language", "distance"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, language string, distance double")


def keep_identified(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` without the rows of no known language, with all its columns, whatever their names; no shuffle.

    Those rows are the ones for which ``identify`` has no language: null and
    letterless texts, and texts further than ``profiles.reject`` from every
    profile, at the very threshold they stay. Without profiles no row stays; no
    documents: no rows. Rows with a null doc_id are judged by their text too,
    and repeated rows stay or go together.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return keep_rows(docs, lambda text: [shared.value.identify(t)[0] is not None for t in text.to_pylist()], 4 << 20)
