"""Toxicity by a factorization machine over hashed terms.

The score of a document is ``b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 -
sum_i (v_if x_i)^2)``: the pairwise part learns that two terms together mean
more than each alone. It is fitted with numpy on labelled documents and applied
to whole texts in Arrow batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import keep_rows, narrow
from .kernels import segments, slices, word_hashes
from .scratch import Scratch, small_batches

BITS = 18
FACTORS = 8
#: The documented bound on the labelled rows that the classifier is fitted on: those of the least hashes of doc_id.
TRAINING_ROWS = 20_000
#: The weight of a toxic document in training is the ratio of the classes, up to this.
MAX_BALANCE = 20.0
#: Prefixes of words that are terms too, in bytes.
PREFIXES = (4, 5, 6, 7, 8)
#: A term takes part if it is in so many training rows and its chi-square with the label is over the second.
LEAST, CHI2 = 4, 15.0
#: Or if it is one of so many most frequent terms and a pair with another of them has a chi-square over the second; a pair is in at least the third of rows.
FREQUENT, PAIR_CHI2, PAIR_LEAST = 4096, 45.0, 10


@dataclass(frozen=True)
class FactorizationMachine:
    """``used`` marks the hashed terms that have a weight; ``linear`` and ``factors`` have a row for each of them, by ``place``."""

    bias: float
    used: np.ndarray
    place: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    threshold: float

    def scores(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Probabilities, from (row, term, value) triples sorted by row."""
        total = np.zeros(rows)
        full, start = np.unique(row, return_index=True)
        if len(full):
            at = self.place[term]
            weighted = self.factors[at] * value[:, None]
            first = np.add.reduceat(self.linear[at] * value, start)
            pair = 0.5 * (np.add.reduceat(weighted, start, axis=0) ** 2 - np.add.reduceat(weighted**2, start, axis=0)).sum(axis=1)
            total[full] = first + pair
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40)))

    def apply(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probability, toxic?) of each text; a text without words is never toxic."""
        row, term, value, size = hashed_terms(text, self.used)
        p = self.scores(row, term, value, len(text))
        return p, (p >= self.threshold) & (size > 0)


def hashed_terms(text: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed terms of each row, ``(row, term, value)`` sorted by row, and the number of words of each row.

    Terms are words and the prefixes of words, so an inflected insult shares a
    term with its stem. A term's value is ``log(1 + count)``.
    """
    words, offsets = word_hashes(text, PREFIXES)
    term = (words >> np.uint64(64 - BITS)).astype(np.int64)
    wanted = words != 0
    if used is not None:
        wanted &= used[term]
    at, _ = np.nonzero(wanted)
    key = (segments(offsets).astype(np.int64)[at] << BITS) | term[wanted]
    key, count = np.unique(key, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.log1p(count).astype(np.float32), np.diff(offsets)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def informative(seen: np.ndarray, hit: np.ndarray, rows: int, positive: float) -> np.ndarray:
    """Which terms take part, from the training rows that have a term (``seen``), the toxic ones among them (``hit``) and the totals.

    Terms take part if they are in at least ``LEAST`` training rows and their
    chi-square with the label is over ``CHI2``; others say nothing that holds
    elsewhere. ``Pairs`` adds terms that say something together.
    """
    return (seen >= LEAST) & (_chi2(seen, hit, rows, max(1.0, positive)) > CHI2)


def _chi2(seen, hit, rows, positive) -> np.ndarray:
    a, b, c, d = hit, seen - hit, positive - hit, rows - positive - seen + hit
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(rows * (a * d - b * c) ** 2 / (seen * (rows - seen) * positive * (rows - positive)), posinf=0)


class Pairs:
    """Counts the training rows, and the toxic ones, that have two of the most frequent terms.

    A pair takes part if each term tells toxic rows from others among the rows
    that have the other one, so a term isn't admitted for company of an insult.
    """

    def __init__(self, seen: np.ndarray):
        self.terms = np.argsort(-seen, kind="stable")[:FREQUENT]
        self.terms = np.sort(self.terms[seen[self.terms] >= PAIR_LEAST])
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[self.terms] = np.arange(len(self.terms))
        self.seen, self.hit = (np.zeros((len(self.terms),) * 2, np.float32) for _ in range(2))

    def add(self, row: np.ndarray, term: np.ndarray, toxic: np.ndarray) -> None:
        """Counts rows, from their (row, term) pairs sorted by row and their labels."""
        at = self.place[term]
        row, at = row[at >= 0], at[at >= 0]
        for start in range(0, len(toxic), 1024):
            lo, hi = np.searchsorted(row, [start, start + 1024])
            has = np.zeros((min(1024, len(toxic) - start), len(self.terms)), np.float32)
            has[row[lo:hi] - start, at[lo:hi]] = 1
            self.seen += has.T @ has
            has = has[toxic[start : start + 1024] > 0]
            self.hit += has.T @ has

    def admitted(self) -> np.ndarray:
        """The terms of pairs that take part."""
        seen, hit = np.diag(self.seen).astype(float), np.diag(self.hit).astype(float)
        found = np.zeros(len(self.terms), bool)
        for lo in range(0, len(self.terms), 256):
            mine = slice(lo, lo + 256)
            s, h = self.seen[mine].astype(float), self.hit[mine].astype(float)
            least = np.minimum(_chi2(s, h, seen[mine, None], hit[mine, None]), _chi2(s, h, seen, hit))
            found[mine] = ((s >= PAIR_LEAST) & (least > PAIR_CHI2)).any(axis=1)
        return self.terms[found]


def _learn(parts: Iterable[tuple[pa.Array, np.ndarray, np.ndarray]], used: np.ndarray, seen: np.ndarray, **options) -> FactorizationMachine:
    """Fit on parts of ``(texts, toxic, held)``, given the informative terms and the training rows of each term.

    Only triples of terms that may take part are kept: those, and the frequent ones.
    """
    pairs = Pairs(seen)
    wanted = used.copy()
    wanted[pairs.terms] = True
    labels, out, triples, rows = [], [], [], 0
    for text, toxic, held in parts:
        row, term, value, _ = hashed_terms(text, wanted)
        mine = ~held[row]
        pairs.add((np.cumsum(~held) - 1)[row[mine]], term[mine], toxic[~held])
        triples.append(((row + rows).astype(np.int32), term.astype(np.int32), value))
        labels.append(toxic)
        out.append(held)
        rows += len(toxic)
    y, held = (np.concatenate([np.zeros(0), *x]) for x in (labels, out))
    if not 0 < y.sum() < len(y):
        return _prior(y)
    used = used.copy()
    used[pairs.admitted()] = True
    del pairs
    kept = [used[term] for _, term, _ in triples]
    row, term, value = (np.concatenate([t[k][m] for t, m in zip(triples, kept, strict=True)]) for k in range(3))
    del triples
    return _fit(row, term, value, y.astype(np.float64), held.astype(bool), used, **options)


def fit(text: pa.Array, toxic: np.ndarray, seed: int = 5, **options) -> FactorizationMachine:
    """Fit on texts; a fifth of the rows is held out to set the threshold. With one class only, every score is its prior."""
    y = toxic.astype(np.float64)
    row, term, _, _ = hashed_terms(text)
    held = np.random.default_rng(seed).random(len(y)) < 0.2
    mine = ~held[row]
    seen = np.bincount(term[mine], minlength=1 << BITS).astype(float)
    used = informative(seen, np.bincount(term[mine], y[row[mine]], 1 << BITS), int((~held).sum()), y[~held].sum())
    return _learn([(text, y, held)], used, seen, **options)


def _prior(y: np.ndarray, factors: int = FACTORS) -> FactorizationMachine:
    return FactorizationMachine(20.0 if y.sum() else -20.0, np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int32), np.zeros(1, np.float32), np.zeros((1, factors), np.float32), 0.5)


def _fit(row: np.ndarray, term: np.ndarray, value: np.ndarray, y: np.ndarray, held: np.ndarray, used: np.ndarray, factors: int = FACTORS, epochs: int = 30, rate: float = 0.1, seed: int = 5) -> FactorizationMachine:
    """Fit by AdaGrad on mini-batches of the logistic loss, from the (row, term, value) triples of the terms in use, sorted by row."""
    rng = np.random.default_rng(seed)
    n, positive = len(y), y.sum()
    place = np.where(used, np.cumsum(used) - 1, 0).astype(np.int32)
    at_term = place[term]
    size = max(1, int(used.sum()))
    bounds = np.searchsorted(row, np.arange(n + 1))
    weight = np.where(y > 0, min(MAX_BALANCE, (n - positive) / positive), 1.0)
    train = np.flatnonzero(~held)
    bias, linear, pair = 0.0, np.zeros(size, np.float32), (rng.standard_normal((size, factors)) * 0.01).astype(np.float32)
    column = np.zeros(size, np.int64)
    sum_b, sum_l, sum_p = 1.0, np.ones(size, np.float32), np.ones((size, factors), np.float32)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in rows])
            local = np.repeat(np.arange(len(rows)), bounds[rows + 1] - bounds[rows])
            t = at_term[at]
            here = np.flatnonzero(np.bincount(t, minlength=size))
            column[here] = np.arange(len(here))
            x = np.zeros((len(rows), len(here)), np.float32)  # a batch has few rows, and a small part of the terms
            x[local, column[t]] = value[at]
            v, x2 = pair[here], x * x
            total = x @ v
            score = bias + x @ linear[here] + 0.5 * ((total**2).sum(axis=1) - x2 @ (v**2).sum(axis=1))
            error = ((_sigmoid(score) - y[rows]) * weight[rows]).astype(np.float32)
            sum_b += float(error.sum()) ** 2
            bias -= rate * float(error.sum()) / np.sqrt(sum_b)
            gl = x.T @ error + np.float32(1e-3) * linear[here]
            sum_l[here] += gl**2
            linear[here] -= rate * gl / np.sqrt(sum_l[here])
            gp = x.T @ (error[:, None] * total) - v * (x2.T @ error)[:, None] + np.float32(1e-2) * v
            sum_p[here] += gp**2
            pair[here] -= rate * gp / np.sqrt(sum_p[here])
    model = FactorizationMachine(float(bias), used, place, linear, pair, 0.5)
    p = np.zeros(n)
    for lo in range(0, n, 1024):
        hi = min(n, lo + 1024)
        own = slice(bounds[lo], bounds[hi])
        p[lo:hi] = model.scores(row[own] - lo, term[own], value[own], hi - lo)
    order = np.argsort(-p[held], kind="stable")
    ranked, right = p[held][order], np.cumsum(y[held][order])
    threshold = 0.5
    if right.size and right[-1]:  # the middle of the widest gap among cuts of the best F1
        f1 = 2 * right / (np.arange(1, len(right) + 1) + right[-1])
        lower = np.append(ranked[1:], 0.0)
        f1[ranked == lower] = -1
        best = np.flatnonzero(f1 == f1.max())
        k = best[np.argmax((ranked - lower)[best])]
        threshold = float(np.clip((ranked[k] + lower[k]) / 2, 0.3, 0.7))
    return FactorizationMachine(model.bias, used, place, linear, pair, threshold)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> FactorizationMachine:
    """Fit on at most ``rows`` labelled documents, those whose doc_id hashes least; null ids, texts and labels are left out.

    The sample's texts stay in the executors: they count terms there, one task
    fits, and only the model comes to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    # The bounded sample is the only broadcast: `rows` ids and labels.
    labelled = narrow(labels, "doc_id", "toxic").select("doc_id", (F.col("toxic").cast("int") > 0).cast("int").alias("toxic")).dropna().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    held = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).alias("held")
    sample = scratch.write(narrow(docs, "doc_id", "text").dropna().join(F.broadcast(labelled), "doc_id").select("doc_id", "text", "toxic", held), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hit = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                row, term, _, _ = hashed_terms(batch.column("text"))
                seen += np.bincount(term, minlength=1 << BITS)
                hit += np.bincount(term[batch.column("toxic").to_numpy()[row] > 0], minlength=1 << BITS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at]), pa.array(hit[at])], names=["term", "seen", "hit"])

    total = sample.where("not held").agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("positive")).first()
    counts = sample.where("not held").select("text", "toxic").mapInArrow(count, "term long, seen long, hit long").groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("hit").alias("hit"))
    got = counts.where(F.col("seen") >= LEAST).toPandas()  # 2**BITS rows at most
    seen, hit = np.zeros(1 << BITS), np.zeros(1 << BITS)
    seen[got["term"].to_numpy(np.int64)], hit[got["term"].to_numpy(np.int64)] = got["seen"], got["hit"]
    used = informative(seen, hit, total["n"], total["positive"])
    shared = spark.sparkContext.broadcast((used, seen))  # a flag and a number for each of 2**BITS terms

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch for whole in batches for batch in slices(whole, "text", 1 << 20))
        model = _learn(((b.column("text"), b.column("toxic").to_numpy().astype(float), b.column("held").to_numpy(zero_copy_only=False)) for b in parts), *shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # One task, as the model is one; the bound on the sample bounds it at every size.
    ordered = sample.select("doc_id", "text", "toxic", "held").coalesce(1).sortWithinPartitions("doc_id", F.xxhash64("text"))
    model = pickle.loads(ordered.select("text", "toxic", "held").mapInArrow(learn, "model binary").first()["model"])
    scratch.drop("sample")
    return model


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``(doc_id, toxicity, is_toxic)`` for each row of ``docs``, repeated rows included.

    A null text, or one without words, scores the bias alone and is never
    toxic. A score equal to the threshold is toxic. A null doc_id keeps its row.
    No documents: no rows. Other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1.3 MB and a few weights a used term, bounded by 2**18 terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                p, toxic = fm.apply(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(toxic)], names=["doc_id", "toxicity", "is_toxic"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, toxicity double, is_toxic boolean")


def drop_toxic(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``docs`` without the rows whose text is toxic, with all its columns, whatever their names; no shuffle.

    Null and wordless texts stay. A score equal to the threshold is toxic. Rows
    with a null doc_id are judged by their text too, and repeated rows stay or
    go together. No documents: no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda text: ~shared.value.apply(text)[1])
