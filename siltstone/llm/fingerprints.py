"""Document fingerprints by consistent weighted sampling.

A document is a set of terms weighted by their counts. Coordinate ``k`` of its
fingerprint is one of its (term, quantised weight) samples: for every term,
``r`` and ``c`` from Gamma(2, 1) and ``b`` from Uniform(0, 1) are derived from
the term and ``k`` alone; with ``t = floor(ln w / r + b)`` the term of least
``ln c - r (t - b + 1)`` is taken. Two documents agree on a coordinate with a
probability equal to the generalised Jaccard similarity of their weights, the
sum of the lesser weights over the sum of the greater.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import narrow
from .kernels import mix64, segments, slices, word_hashes
from .scratch import small_batches

SAMPLES = 64
#: Terms whose random numbers a worker keeps; the rest are derived again when they come.
KEPT = 1 << 16
_LOW = np.uint64(0xFFFFFFFF)


def _uniform(seed: np.ndarray, salt: int) -> np.ndarray:
    """Uniform on (0, 1), 24 bits."""
    with np.errstate(over="ignore"):
        x = (seed ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def draws(terms: np.ndarray, size: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(r, ln c, b)`` of each term and sample; functions of the term's hash and the sample's number."""
    with np.errstate(over="ignore"):
        seed = mix64(terms[:, None] + np.arange(1, size + 1, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407))
    r = -np.log(_uniform(seed, 1) * _uniform(seed, 2))
    log_c = np.log(-np.log(_uniform(seed, 3) * _uniform(seed, 4)))
    return r, log_c, _uniform(seed, 5)


def pack(a: np.ndarray, term: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A key that orders as ``a`` and carries 32 bits of (term, t)."""
    bits = a.astype(np.float32).view(np.uint32)
    order = np.where(bits >> 31 == 1, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
    with np.errstate(over="ignore"):
        who = mix64(term + t.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return order << np.uint64(32) | who & _LOW


class Sampler:
    """Keys of (term, weight) pairs, with the keys of weight 1 kept for the terms seen first."""

    def __init__(self, size: int = SAMPLES, kept: int = KEPT):
        self.size, self.room = size, kept
        self.terms = np.zeros(0, np.uint64)
        self.keys = np.zeros((0, size), np.uint64)

    def _fresh(self, terms: np.ndarray) -> np.ndarray:
        out = np.empty((len(terms), self.size), np.uint64)
        for at in range(0, len(terms), 1024):
            part = terms[at : at + 1024]
            r, log_c, b = draws(part, self.size)
            t = np.zeros_like(r)  # floor(0 / r + b)
            out[at : at + 1024] = pack(log_c - r * (t - b + 1), part[:, None], t)
        return out

    def ones(self, terms: np.ndarray) -> np.ndarray:
        """Keys at weight 1 of sorted distinct terms."""
        if not len(self.terms):
            known = np.zeros(len(terms), bool)
        else:
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            known = self.terms[at] == terms
        out = np.empty((len(terms), self.size), np.uint64)
        fresh = self._fresh(terms[~known])
        out[~known] = fresh
        if known.any():
            out[known] = self.keys[at[known]]
        add = min(self.room - len(self.terms), len(fresh))
        if add > 0:
            merged = np.concatenate([self.terms, terms[~known][:add]])
            order = np.argsort(merged)
            self.terms, self.keys = merged[order], np.concatenate([self.keys, fresh[:add]])[order]
        return out

    def signatures(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Fingerprints of the rows that have words, in order."""
        row = segments(offsets)
        order = np.lexsort((words, row))
        w, r = words[order], row[order]
        start = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])]))
        count = np.diff(np.append(start, len(w)))
        term, owner = w[start], r[start]
        unique, place = np.unique(term, return_inverse=True)
        one = self.ones(unique)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out = np.full((len(first), self.size), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(term), 2048):
            stop = min(at + 2048, len(term))
            key = one[place[at:stop]]
            many = np.flatnonzero(count[at:stop] > 1)
            if len(many):
                x, weight = term[at:stop][many], np.log(count[at:stop][many]).astype(np.float32)[:, None]
                rr, log_c, b = draws(x, self.size)
                t = np.floor(weight / rr + b)
                key[many] = pack(log_c - rr * (t - b + 1), x[:, None], t)
            lo, hi = int(np.searchsorted(first, at, "right")) - 1, int(np.searchsorted(first, stop, "left"))
            cut = np.maximum(first[lo:hi], at) - at
            out[lo:hi] = np.minimum(out[lo:hi], np.minimum.reduceat(key, cut, axis=0))
        return (out & _LOW).astype(np.uint32).view(np.int32)


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``(doc_id, n_terms, fingerprint)`` for each row of ``docs``, repeated rows included.

    A null text, and one without words, has the fingerprint null and no terms. A
    null doc_id keeps its row. No documents: no rows. Texts of one multiset of words
    have one fingerprint. Other columns aren't read, whatever their names. Nothing is shuffled:
    each fingerprint depends on its own text only, whatever the partitions.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 21):
                words, offsets = word_hashes(batch.column("text"))
                size = np.diff(offsets)
                full = size > 0
                found = sampler.signatures(words, offsets) if full.any() else np.zeros((0, samples), np.int32)
                ends = np.concatenate([[0], np.cumsum(np.where(full, samples, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~full, False)), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), lists], names=["doc_id", "n_terms", "fingerprint"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_terms long, fingerprint array<int>")
