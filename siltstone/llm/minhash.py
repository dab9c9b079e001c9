"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard.

Two permutations make the whole signature. The first scatters a document's
shingles over ``[0, UNIVERSE)``; coordinate ``k`` is the least value that the
second, shifted circularly by ``k``, gives any of them. All coordinates of one
shingle are therefore one contiguous window of the second permutation.

Documents whose bands agree are candidates. Their shingle sets are compared
exactly, and documents are grouped by the connected components of the pairs
that reach the threshold. Inside a bucket only pairs of different components
still need a comparison, so groups of thousands of copies cost one comparison
a member and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import narrow, place, positional
from .components import contract, follow, labelled
from .kernels import mix64, segments, slices, word_hashes
from .scratch import Scratch, few, small_batches

UNIVERSE = 1 << 20
ROWS, BANDS = 3, 42
SHINGLE = 3
THRESHOLD = 0.5
#: Members compared with one copy of a centre's set in one task.
MEMBERS = 2_000

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _tables:
        rng = np.random.default_rng(20240229)
        first, second = (rng.permutation(UNIVERSE).astype(np.uint32) for _ in range(2))
        # window[s] is second[s], second[s - 1], ... with wrap: shift k reads position s - k
        turned = np.concatenate([second[-size:], second])[::-1]
        _tables[size] = first, np.lib.stride_tricks.sliding_window_view(turned, size)
    return _tables[size]


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words, and each row's offsets; a row of fewer words is one shingle."""
    size = np.diff(offsets)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    if not len(words):
        return np.zeros(0, np.uint64), out
    row = segments(out)
    at = offsets[:-1][row] + np.arange(out[-1]) - out[:-1][row]
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(n, np.uint64)])
        value = np.zeros(len(at), np.uint64)
        for k in range(n):
            part = padded[at + k]
            if k:
                part = np.where(at + k < offsets[1:][row], part, np.uint64(0x5555))
            value = mix64(value * np.uint64(0x2545F4914F6CDD1D) + part)
    return value, out


def signatures(shingles: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash signatures, a row of ``size`` for each non-empty row of ``offsets``."""
    first, window = _permutations(size)
    full = np.flatnonzero(np.diff(offsets))
    out = np.empty((len(full), size), np.uint32)
    place = UNIVERSE - 1 - first[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)].astype(np.int64)
    step = 4096
    out[:] = np.iinfo(np.uint32).max
    starts = offsets[full]
    for at in range(0, len(place), step):
        stop = min(at + step, len(place))
        lo = int(np.searchsorted(starts, at, "right")) - 1
        hi = int(np.searchsorted(starts, stop, "left"))
        cut = np.maximum(starts[lo:hi], at) - at
        out[lo:hi] = np.minimum(out[lo:hi], np.minimum.reduceat(window[place[at:stop]], cut, axis=0))
    return out


def _content(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(np.diff(offsets))
    row = segments(offsets)
    with np.errstate(over="ignore"):
        place = (np.arange(len(words)) - offsets[:-1][row]).astype(np.uint64)
        part = mix64(words + place * np.uint64(0x9E3779B97F4A7C15))
        return mix64(np.add.reduceat(part, offsets[full])).view(np.int64) if len(full) else np.zeros(0, np.int64)


def distinct_counts(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of distinct values of each row."""
    row = segments(offsets)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(offsets) - 1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            words, offsets = word_hashes(batch.column("text"))
            full = np.flatnonzero(np.diff(offsets))
            shingles, bounds = shingle_hashes(words, offsets)
            sig = signatures(shingles, bounds, ROWS * BANDS)
            size = distinct_counts(shingles, bounds)[full].astype(np.int32)
            with np.errstate(over="ignore"):
                band = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407)
                for k in range(ROWS):
                    band = mix64(band * np.uint64(0x2545F4914F6CDD1D) + sig[:, k::ROWS].astype(np.uint64))
            lists = pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * BANDS, band.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(full), pa.array(_content(words, offsets)), pa.array(size), lists], names=["doc_id", "node", "size", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            words, offsets = word_hashes(batch.column("text"))
            shingles, bounds = shingle_hashes(words, offsets)
            node = np.zeros(batch.num_rows, np.int64)
            node[np.flatnonzero(np.diff(offsets))] = _content(words, offsets)
            want = batch.column("node").to_numpy()
            keep = np.flatnonzero(node == want)  # another row may share the doc_id with another text
            data = [np.unique(shingles[bounds[i] : bounds[i + 1]]).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(data, pa.binary())], names=["node", "data"])


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, None
        for batch in batches:
            keys = list(zip(batch.column("centre").to_pylist(), batch.column("salt").to_pylist(), strict=True))
            nodes, data = batch.column("node").to_pylist(), batch.column("data")
            left, right, value = [], [], []
            for i, k in enumerate(keys):
                mine = np.frombuffer(data[i].as_buffer(), np.uint64)
                if k != key:  # the centre sorts first in its group
                    key, centre = k, mine.copy()
                    continue
                small, large = sorted((len(mine), len(centre)))
                if small < threshold * large:
                    continue
                both = np.concatenate([mine, centre])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if shared >= threshold * (small + large - shared):
                    left.append(nodes[i])
                    right.append(k[0])
                    value.append(shared / (small + large - shared))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(value, pa.float64())], names=["a", "b", "jaccard"])

    return run


def _verify(docs: DataFrame, first: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (node, centre) whose shingle sets reach the threshold.

    Each text is read once for all its pairs, and each set is moved once to
    each group of members that it is compared with.
    """
    salts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / MEMBERS).alias("n"))
    member = pairs.join(salts, "centre").select("node", "centre", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("salt"), F.lit(1).alias("role"))
    # A salt that no member fell to makes a group of its centre alone, which compares nothing.
    lead = salts.select(F.col("centre").alias("node"), "centre", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("salt"), F.lit(0).alias("role"))
    roles = member.union(lead)
    # Only ids are broadcast, and only while they are few; beyond that the texts are shuffled by doc_id.
    need = roles.select("node").distinct().join(first, "node").select("doc_id", "node")
    joined = docs.join(few(need, need.count()), "doc_id").select("node", "text")
    sets = joined.mapInArrow(_sets, "node long, data binary")
    flat = sets.join(roles, "node").select("centre", "salt", "role", "node", "data")
    return flat.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role").mapInArrow(_compare(threshold), "a long, b long, jaccard double")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Groups of near-duplicate documents: ``(doc_id, group_id, group_size, keep)``.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are not read. Two
    documents belong together if the Jaccard similarity of their sets of
    3-word shingles is at least ``threshold``, directly or through others.
    ``group_id`` is the least doc_id of the group, and ``keep`` is true for it.

    * A null doc_id has no row in the result.
    * A null text, and one without words, is a group of its own.
    * A text of one or two words is one shingle of them.
    * Rows that repeat a doc_id are one row of the result; if their texts
      differ, they join the groups of each text into one.
    * No documents: no rows. Candidates are missed with a probability of
      ``(1 - s**3)**42`` at similarity ``s``: 0.4 % at 0.5, 0.05 % at 0.55.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    docs = narrow(docs, "doc_id", "text").where("doc_id is not null")
    sig = scratch.write(docs.mapInArrow(_sign, "doc_id long, node long, size int, bands array<long>"), "sig")
    ids = sig.select("doc_id", "node")
    first = ids.groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    exploded = sig.select("node", "size", F.explode("bands").alias("bucket")).repartition("bucket").distinct()
    least = exploded.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    buckets = scratch.write(exploded.join(least, "bucket").select("bucket", "node", "size", "centre"), "buckets")

    star = buckets.where("node != centre").select("node", "centre").distinct()
    tested = scratch.write(star.groupBy("node").agg(F.min("centre").alias("centre")), "pairs-0")
    # A node has one of these pairs, with a lesser one: they are pointers.
    label = follow(_verify(docs, first, tested, threshold).select(F.col("a").alias("node"), F.col("b").alias("parent")), scratch, "label-0")

    for turn, pairs in ((1, star), (2, None)):
        if pairs is None:
            # One row for each component in a bucket that holds several; their pairs are all that is left.
            mixed = labelled(buckets.select("bucket", "node", "size"), "node", "la", label)
            several = mixed.groupBy("bucket").agg(F.min("la").alias("lo"), F.max("la").alias("hi")).where("lo != hi").select("bucket")
            mixed = scratch.write(mixed.join(several, "bucket"), "mixed")
            other = mixed.select("bucket", F.col("node").alias("centre"), F.col("size").alias("other"), F.col("la").alias("lb"))
            # A set much smaller than the other can't reach the threshold.
            alike = F.least("size", "other") >= threshold * F.greatest("size", "other")
            todo = mixed.join(other, "bucket").where("la != lb and node > centre").where(alike).select("node", "centre").distinct()
        else:
            todo = labelled(labelled(pairs, "node", "la", label), "centre", "lb", label).where("la != lb").select("node", "centre")
        todo = scratch.write(todo.join(tested, ["node", "centre"], "left_anti"), f"pairs-{turn}")
        if todo.isEmpty():
            continue
        tested = tested.union(todo)
        found = scratch.write(_verify(docs, first, todo, threshold).select("a", "b"), f"edges-{turn}")
        if found.isEmpty():
            continue
        label = contract(spark, label, found, scratch, f"label-{turn}")

    # Texts that share a doc_id are one document: their nodes are one component.
    shared = ids.distinct().groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    if not shared.isEmpty():
        link = ids.join(shared.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
        label = contract(spark, label, link, scratch, "label-ids")

    grouped = labelled(ids.distinct(), "node", "label", label).select("doc_id", "label").distinct()
    total = grouped.groupBy("label").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    grouped = scratch.write(grouped.join(total, "label").select("doc_id", "group_id", "group_size"), "groups")
    scratch.drop("sig", "buckets", "mixed", *(f"{x}-{k}" for x in ("edges", "pairs", "label") for k in (0, 1, 2)))
    alone = docs.select("doc_id").join(grouped.select("doc_id"), "doc_id", "left_anti").distinct().select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"))
    return grouped.union(alone).withColumn("keep", F.col("doc_id") == F.col("group_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document left of each near-duplicate group; all its columns, whatever their names.

    The kept one has the least doc_id. Rows with a null doc_id stay, and rows
    that repeat a kept doc_id stay as one row: the one of the least text, and of
    the least JSON of the whole row among equal texts. No documents: no rows.
    """
    groups = near_duplicates(docs, threshold)
    scratch = Scratch(docs.sparkSession, "dedup")
    gone = scratch.write(groups.where("not keep").select(F.col("doc_id").alias("gone")), "gone")
    plain = positional(docs)
    doc_id, text = (F.col(f"c{place(docs, n)}") for n in ("doc_id", "text"))
    left = plain.join(few(gone, gone.count()), doc_id == F.col("gone"), "left_anti")
    again = scratch.write(plain.groupBy(doc_id.alias("again")).agg(F.count("*").alias("n")).where("n > 1 and again is not null").select("again"), "again")
    n = again.count()
    if n:
        small, row = few(again, n), F.struct(*plain.columns)
        one = left.join(small, doc_id == F.col("again"), "left_semi").groupBy(doc_id).agg(F.min_by(row, F.struct(text, F.to_json(row))).alias("row"))
        left = left.join(small, doc_id == F.col("again"), "left_anti").unionByName(one.select("row.*"))
    return left.toDF(*docs.columns)
