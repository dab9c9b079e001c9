"""The index of a store: stored postings of its segments, and its change log's documents as they are.

Postings of a segment are written once, with the segment's documents. The
text that the log adds is written once for a state of the log and indexed in the scan, what it changes or removes is left out of the
segments' postings; statistics are of the documents that are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.hashing import spark_xxhash64
from siltstone.operators.index import POSTINGS, AdHocIndex, count_terms, grouped, phrase_positions, term_buckets

LENGTHS = "document_id string, dl long"
#: Slices of a bucket of a segment, at least, and the bytes of documents from which there are more.
LEAST_SLICES, SLICE_BYTES = 4, 8 << 20


def _packed(buckets: int, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of some documents as a few rows: those of a bucket in a compressed block, sorted by term."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for n, found in enumerate(grouped(batches)):
            coded = found.column("term").dictionary_encode()
            bucket = np.array([spark_xxhash64(t.encode()) % buckets for t in coded.dictionary.to_pylist()], np.int32)
            term = coded.indices.to_numpy()
            order = np.lexsort((term, bucket[term]))
            found, own = found.take(pa.array(order)), bucket[term][order]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            data = []
            for at, stop in zip(start, np.append(start[1:], len(own)), strict=True):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, found.schema, options=options) as to:
                    to.write_batch(found.slice(at, stop - at))
                data.append(out.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(own[start]), pa.array(np.full(len(start), n % slices, np.int32)), pa.array(data, pa.binary())], names=["bucket", "slice", "data"])

    return pack


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for bucket, data in zip(whole.column("bucket"), whole.column("data"), strict=True):
            with pa.ipc.open_stream(data.as_buffer()) as blocks:
                for b in blocks:
                    yield b.append_column("bucket", pa.array(np.full(b.num_rows, bucket.as_py(), np.int32)))


def write_postings(index: AdHocIndex, root: str, segment: int, buckets: int, size: int = 0) -> None:
    """Lengths and postings of a segment's documents, ``size`` bytes of them; the postings' ``_SUCCESS`` says that both are whole.

    Postings are shuffled in compressed blocks of a bucket, of which there are as many slices as the size asks for.
    """
    index.lengths.write.mode("overwrite").parquet(f"{root}/lengths/segment={segment}")
    slices = max(LEAST_SLICES, -(-size // (buckets * SLICE_BYTES)))
    blocks = index.tokens.select("document_id", "toks").mapInArrow(_packed(buckets, slices), "bucket int, slice int, data binary")
    blocks = blocks.repartition(buckets * slices, "bucket", "slice") if slices > LEAST_SLICES else blocks.repartition("bucket", "slice")
    rows = blocks.select("bucket", "data").mapInArrow(_unpacked, f"{POSTINGS}, bucket int")
    rows.sortWithinPartitions("bucket", "term", "document_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings/segment={segment}")


class SegmentedIndex(AdHocIndex):
    """``docs`` are all documents, ``fresh`` an index of those that the log added, ``changed`` the ids that the log names."""

    def __init__(self, docs: DataFrame, fields: list[str], root: str, segments: list[int], buckets: int, fresh: AdHocIndex, changed: DataFrame | None):
        super().__init__(docs, fields)
        self.root, self.segments, self.buckets, self.fresh, self.changed = root, segments, buckets, fresh, changed

    def _read(self, what: str, schema: str) -> DataFrame:
        spark = self.docs.sparkSession
        paths = [f"{self.root}/{what}/segment={s}" for s in self.segments]
        rows = spark.read.schema(schema).option("basePath", f"{self.root}/{what}").parquet(*paths) if paths else spark.createDataFrame([], schema)
        return rows if self.changed is None else rows.join(self.changed, "document_id", "left_anti")

    @cached_property
    def _stored(self) -> DataFrame:
        return self._read("postings", f"{POSTINGS}, bucket int")

    def _own(self, terms: list[str]) -> DataFrame:
        return self._stored.where(F.col("bucket").isin(*term_buckets(terms, self.buckets)) & F.col("term").isin(*terms))

    def among(self, condition: Column) -> None:
        """Postings don't have the fields that choose documents; those are joined."""

    @cached_property
    def postings(self) -> DataFrame:
        columns = [c.split()[0] for c in POSTINGS.split(", ")]
        return self._stored.select(*columns).unionByName(self.fresh.postings)

    @cached_property
    def collection(self) -> DataFrame:
        dl = self._read("lengths", LENGTHS).select("dl").unionByName(self.fresh.lengths.select("dl"))
        return dl.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_length"), F.avg("dl").alias("avgdl"))

    def counted(self, terms: list[str]) -> tuple[DataFrame, DataFrame]:
        fresh, _ = self.fresh.counted(terms)
        columns = ["document_id", "dl", "hit", *[f"tf_{i}" for i in range(len(terms))]]
        rows = count_terms(self._own(terms), terms).select(*columns).unionByName(fresh.select(*columns))
        dfs = rows.agg(*[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))])
        return rows, self.collection.select("n", "avgdl").crossJoin(dfs)  # one row each

    def matching(self, condition: Callable[[Column], Column], held: Column | None = None) -> DataFrame:
        stored = self._stored.where(condition(F.col("term"))).select("document_id", "dl", "term", "tf")
        found = stored.unionByName(self.fresh.matching(condition, held).drop("df", "hit"))
        return found.join(found.groupBy("term").agg(F.count("*").alias("df")), "term")

    def phrase(self, terms: list[str]) -> DataFrame:
        return phrase_positions(self._own(terms), terms).unionByName(self.fresh.phrase(terms))
