"""Compressed posting lists of document numbers, for exchange in a compact form.

A term's list is cut into blocks of ``BLOCK`` consecutive numbers, so a term of
every document is many rows and no row outgrows a task. A block holds its
numbers, counted from the block's first, as gaps in variable length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from siltstone.functions.codec import decode_array, encode_varint
from siltstone.operators.index import AdHocIndex, compact_ids
from siltstone.sources.scratch import work_folder

BLOCK = 1 << 20

LISTS = "term string, block long, n long, data binary"


@pandas_udf(T.BinaryType())
def pack(sorted_numbers: pd.Series) -> pd.Series:
    """Gaps of sorted numbers, the first from 0, as varints; all lists of a batch at once, since most are short."""
    n = sorted_numbers.map(len).to_numpy(np.int64)
    if not n.sum():
        return pd.Series([b""] * len(n))
    flat, start = np.concatenate(sorted_numbers.to_list()).astype(np.int64), np.cumsum(n) - n
    gap = np.diff(flat, prepend=0)
    gap[start[n > 0]] = flat[start[n > 0]]
    size = np.ones(len(gap), np.int64)
    for k in range(1, 9):
        size += gap >= 1 << 7 * k
    data, at = encode_varint(gap), np.append(0, np.cumsum(size))
    return pd.Series([data[at[i] : at[i + k]] for i, k in zip(start, n, strict=True)])


@pandas_udf(T.ArrayType(T.LongType()))
def unpack(data: pd.Series) -> pd.Series:
    if any(d and d[-1] > 127 for d in data):
        raise ValueError("a varint is cut short")
    whole = b"".join(data)
    total = np.append(0, np.cumsum(decode_array(whole).astype(np.int64)))
    values = np.append(0, np.cumsum(np.frombuffer(whole, np.uint8) < 128))  # values before each byte
    end = np.append(0, values[np.cumsum(data.map(len).to_numpy(np.int64))])
    return pd.Series([total[i + 1 : j + 1] - total[i] for i, j in zip(end[:-1], end[1:], strict=True)])


def compress(pairs: DataFrame) -> DataFrame:
    """``(term, block, n, data)`` of ``(term, compact_id)``; a pair that comes again counts once."""
    block = F.floor(F.col("compact_id") / BLOCK).cast("long")
    rows = pairs.select("term", block.alias("block"), (F.col("compact_id") - block * BLOCK).alias("at"))
    return rows.groupBy("term", "block").agg(F.array_distinct(F.sort_array(F.collect_list("at"))).alias("at")).select("term", "block", F.size("at").cast("long").alias("n"), pack("at").alias("data"))


def decompress(lists: DataFrame) -> DataFrame:
    """``(term, compact_id)`` of ``(term, block, n, data)``."""
    return lists.select("term", "block", F.explode(unpack("data")).alias("at")).select("term", (F.col("block") * BLOCK + F.col("at")).alias("compact_id"))


def _numbered(index: AdHocIndex, ids: DataFrame) -> DataFrame:
    """``(term, compact_id)``: a document's terms go to its number in one row, before they are rows."""
    rows = index.tokens.select("document_id", F.array_distinct("toks").alias("toks")).join(ids, "document_id")
    return rows.select(F.explode("toks").alias("term"), "compact_id")


def _written(lists: DataFrame) -> DataFrame:
    """The lists in a work folder: a change reads them several times, and they are small."""
    path = work_folder(lists.sparkSession, "lists")
    lists.write.parquet(path)
    return lists.sparkSession.read.schema(LISTS).parquet(path)


@dataclass(frozen=True)
class CompressedIndex:
    """``lists`` of ``(term, block, n, data)`` and ``ids`` of ``(document_id, compact_id)``; changes give a new index."""

    lists: DataFrame
    ids: DataFrame

    @staticmethod
    def of(index: AdHocIndex) -> CompressedIndex:
        """Numbers follow the order of ids; a document without tokens has a number and no list."""
        ids = compact_ids(index.docs.select("document_id"))
        return CompressedIndex(_written(compress(_numbered(index, ids))), ids)

    def postings(self, term: str) -> DataFrame:
        """``(document_id)`` of a term; only its blocks are unpacked."""
        return decompress(self.lists.where(F.col("term") == term)).join(self.ids, "compact_id").select("document_id")

    def contains(self, term: str) -> bool:
        return not self.lists.where(F.col("term") == term).isEmpty()

    def sizes(self) -> DataFrame:
        """One row ``(terms, postings, compressed_bytes, raw_bytes)``; a raw number takes eight bytes."""
        return self.lists.agg(F.count_distinct("term").alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("compressed_bytes"), F.coalesce(F.sum(F.col("n") * 8), F.lit(0)).alias("raw_bytes"))

    def add(self, index: AdHocIndex) -> CompressedIndex:
        """With more documents; ids that are there keep their numbers, new ones count on. Only blocks that change are packed again."""
        last = self.ids.agg(F.coalesce(F.max("compact_id"), F.lit(-1).cast("long")).alias("last"))
        new = compact_ids(index.docs.select("document_id").join(self.ids, "document_id", "left_anti"))
        ids = self.ids.unionByName(new.crossJoin(F.broadcast(last)).select("document_id", (F.col("compact_id") + F.col("last") + 1).alias("compact_id")))  # `last` is one row
        return CompressedIndex(_written(self._changed(_numbered(index, ids))), ids)

    def _changed(self, pairs: DataFrame) -> DataFrame:
        """The lists with more pairs."""
        touched = pairs.select("term", F.floor(F.col("compact_id") / BLOCK).cast("long").alias("block")).distinct()
        old = decompress(self.lists.join(touched, ["term", "block"], "left_semi"))
        return self.lists.join(touched, ["term", "block"], "left_anti").unionByName(compress(old.unionByName(pairs)))

    def remove(self, gone: DataFrame) -> CompressedIndex:
        """Without the documents of ``(document_id)``; a term without documents has no list. Other numbers stay."""
        numbers = gone.select("document_id").distinct().join(self.ids, "document_id").select("compact_id")
        left = decompress(self.lists).join(numbers, "compact_id", "left_anti").select("term", "compact_id")
        return CompressedIndex(_written(compress(left)), self.ids.join(gone, "document_id", "left_anti"))

    def inverted(self) -> DataFrame:
        """``(term, document_id)`` of all lists."""
        return decompress(self.lists).join(self.ids, "compact_id").select("term", "document_id")
