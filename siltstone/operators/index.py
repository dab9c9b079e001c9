"""Inverted indexes: an ad-hoc one over a table, and a stored one.

Both give the same things: counts of a few terms in each document with their
statistics, rows of the terms that meet a condition, positions of a phrase's
words, postings and the dictionary. The ad-hoc index normalises each text once
and searches bytes; the stored one reads only the term buckets that a query names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import extract_text, normalize, occurrences, spaced, split_tokens, token_count
from siltstone.sources.scratch import work_folder

#: Term buckets of a stored index: one for so many tokens, within these bounds; a query reads those of its own terms.
BUCKET_TOKENS, LEAST_BUCKETS, MOST_BUCKETS = 1 << 25, 16, 1 << 15
#: Documents of a slice of a bucket, which is a file: a frequent term's postings are many files.
SLICE_TOKENS = 1 << 30
#: Tokens that are grouped at a time.
BLOCK = 1 << 20

POSTINGS = "term string, document_id string, tf long, dl long, positions array<int>"


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of whole documents; all tokens of a document are in its row, so nothing has to be shuffled to group them."""
    for whole in batches:
        column = whole.column("toks")
        size = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
        end = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < whole.num_rows:
            stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + BLOCK, "right")))
            part, n = whole.slice(at, stop - at), size[at:stop].astype(np.int64)
            at = stop
            coded = part.column("toks").flatten().dictionary_encode()
            if not len(coded):
                continue
            row = np.repeat(np.arange(len(n)), n)
            key = row * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            position = (order - (np.cumsum(n) - n)[row[order]]).astype(np.int32)
            owner, term = np.divmod(key[start], len(coded.dictionary))
            ends = np.append(start, len(key))
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(term)), part.column("document_id").take(pa.array(owner)), pa.array(np.diff(ends)), pa.array(n[owner]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(position))],
                names=["term", "document_id", "tf", "dl", "positions"],
            )


def postings(tokens: DataFrame) -> DataFrame:
    """``(term, document_id, tf, dl, positions)`` from ``(document_id, toks)``, one row a term of each document; no shuffle.

    Positions are token ordinals in the text. Rows that share a document_id have postings each.
    """
    return tokens.select("document_id", "toks").mapInArrow(grouped, POSTINGS)


def compact_ids(ids: DataFrame) -> DataFrame:
    """``(document_id, compact_id)``: each distinct id and its rank from 0, in the ids' order.

    Ranks are counted in range partitions and shifted by the partitions before;
    only a count a partition is gathered. Null ids have no row.
    """
    spark = ids.sparkSession
    path = work_folder(spark, "ids")
    placed = ids.select("document_id").where("document_id is not null").distinct().repartitionByRange("document_id").withColumn("part", F.spark_partition_id())
    placed.write.parquet(path)
    rows = spark.read.schema("document_id string, part int").parquet(path)
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("document_id"))
    return rows.withColumn("rank", rank).join(F.broadcast(before), "part").select("document_id", (F.col("rank") - 1 + F.col("before")).cast("long").alias("compact_id"))  # a row a partition


class AdHocIndex:
    """An index of the rows of a table, made as they are scanned.

    ``docs`` has ``document_id`` and the fields; ``fields`` limits those whose
    text is searched. ``only_if`` is a condition on the documents that may be
    hits, all by default; statistics are of ``docs`` whatever it is.
    """

    def __init__(self, docs: DataFrame, fields: list[str] | None = None, only_if: Column | None = None):
        self.docs, self.only_if = docs, only_if
        self.fields = [f for f in docs.columns if f != "document_id"] if fields is None else fields

    def text(self) -> Column:
        return extract_text(self.docs.schema, self.fields)

    def _normal(self, *more: Column) -> DataFrame:
        """``(document_id, normal, ...)``: by a generator, so that what stands above it doesn't normalise again."""
        made = F.struct(normalize(self.text()).alias("normal"), *more)
        return self.docs.select("document_id", F.inline(F.array(made)))

    @cached_property
    def tokens(self) -> DataFrame:
        return self._normal().select("document_id", split_tokens(F.col("normal")).alias("toks"))

    @cached_property
    def lengths(self) -> DataFrame:
        """``(document_id, dl)``, a row a document."""
        return self._normal().select("document_id", token_count(F.col("normal")).alias("dl"))

    def among(self, condition: Column) -> AdHocIndex | None:
        """The index with only some documents as possible hits, if it can tell them as it scans."""
        return AdHocIndex(self.docs, self.fields, condition if self.only_if is None else self.only_if & condition)

    def is_all_text(self, field: str) -> bool:
        """Whether all the text that is searched is a string field's, so that a term of the index is one of the field."""
        return self.fields == [field] and self.docs.schema[field].dataType.typeName() == "string"

    def only(self, field: str) -> AdHocIndex:
        """The index of one field, with statistics of its own."""
        return AdHocIndex(self.docs, [field])

    def counted(self, terms: list[str]) -> tuple[DataFrame, DataFrame]:
        """``(document_id, dl, hit, tf_0, tf_1, ...)`` of the documents, and one row ``(n, avgdl, df_0, df_1, ...)``.

        One scan for both: its narrow rows go through an exchange that both
        read. ``hit`` is whether a document may be a hit.
        """
        allowed = F.lit(True) if self.only_if is None else F.coalesce(self.only_if, F.lit(False))
        rows = self._normal(allowed.alias("hit")).select("document_id", "hit", "normal", F.inline(F.array(F.struct(spaced(F.col("normal")).alias("text")))))
        rows = rows.select("document_id", token_count(F.col("normal")).alias("dl"), "hit", *[occurrences(F.col("text"), t).alias(f"tf_{i}") for i, t in enumerate(terms)])
        rows = rows.repartition("document_id")
        dfs = [F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))]
        # The statistics read every column, so that neither side's exchange is narrower than the other's.
        n = (F.count_if("hit") + F.count_if(~F.col("hit"))).alias("n")
        return rows, rows.agg(n, F.avg("dl").alias("avgdl"), *dfs)

    @cached_property
    def postings(self) -> DataFrame:
        return postings(self.tokens)

    def matching(self, condition: Callable[[Column], Column], held: Column | None = None) -> DataFrame:
        """``(document_id, dl, term, tf, df, hit)`` of the terms that meet a condition, however many they are.

        ``held`` is a condition on normalised texts that any such document
        meets. A document's length is a column before its tokens are rows;
        otherwise it would be counted again for each token. Rows and document
        frequencies read one exchange, so both read every column of it.
        """
        allowed = F.lit(True) if self.only_if is None else F.coalesce(self.only_if, F.lit(False))
        rows = self._normal(allowed.alias("hit"))
        rows = rows if held is None else rows.where(held)
        rows = rows.select("document_id", "hit", F.inline(F.array(F.struct(token_count(F.col("normal")).alias("dl"), split_tokens(F.col("normal")).alias("toks")))))
        rows = rows.select("document_id", "hit", "dl", F.explode("toks").alias("term")).where(condition(F.col("term")))
        found = rows.groupBy("document_id", "dl", "term").agg(F.count("*").alias("tf"), F.bool_or("hit").alias("hit"))
        df = F.count_if((F.col("tf") > 0) & F.col("hit")) + F.count_if((F.col("tf") > 0) & ~F.col("hit"))
        return found.join(found.groupBy("term").agg(df.alias("df")), "term")

    def phrase(self, terms: list[str]) -> DataFrame:
        """``(document_id, at_0, at_1, ...)``: the positions of each term in the documents that hold all; no shuffle."""
        rows = self._normal().where(reduce(lambda a, b: a & b, [F.contains("normal", F.lit(t)) for t in terms]))
        rows = rows.select("document_id", F.inline(F.array(F.struct(split_tokens(F.col("normal")).alias("toks")))))
        at = lambda t: F.filter(F.sequence(F.lit(0), F.size("toks") - 1), lambda i: F.get(F.col("toks"), i) == F.lit(t))
        rows = rows.where(F.size("toks") > 0).select("document_id", F.inline(F.array(F.struct(*[at(t).alias(f"at_{i}") for i, t in enumerate(terms)]))))
        return rows.where(reduce(lambda a, b: a & b, [F.size(f"at_{i}") > 0 for i in range(len(terms))]))

    @cached_property
    def dictionary(self) -> DataFrame:
        """``(term, df, tf)``: documents and occurrences of each term."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))

    @cached_property
    def collection(self) -> DataFrame:
        """One row ``(n, total_length, avgdl)``."""
        return self.lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_length"), F.avg("dl").alias("avgdl"))

    def save(self, path: str, buckets: int | None = None) -> StoredIndex:
        """Write the documents, postings in term buckets, and the statistics that they imply.

        The postings are shuffled once, into files of a bucket and a slice of the
        documents, sorted by term. The number of buckets follows the collection's size.
        """
        spark = self.docs.sparkSession
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        made = AdHocIndex(spark.read.schema(self.docs.schema).parquet(f"{path}/docs"), self.fields)
        made.collection.coalesce(1).write.mode("overwrite").parquet(f"{path}/collection")
        total = spark.read.parquet(f"{path}/collection").first()["total_length"]
        buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, total // BUCKET_TOKENS))
        piece = F.pmod(F.xxhash64("document_id"), F.lit(1 + total // (SLICE_TOKENS * buckets)))
        rows = made.postings.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition("bucket", piece)
        rows.sortWithinPartitions("bucket", "term", "document_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        stored = StoredIndex(spark, path, self.fields, buckets)
        counts = stored.postings.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        return stored


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def term_buckets(terms: list[str], buckets: int) -> list[int]:
    """The buckets of some terms, without a job."""
    from siltstone.operators.hashing import spark_xxhash64

    return sorted({spark_xxhash64(t.encode()) % buckets for t in terms})


def count_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
    """``(document_id, dl, hit, tf_0, tf_1, ...)`` from postings of the terms, a row a document that holds one."""
    columns = [F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf_{i}") for i, t in enumerate(terms)]
    return rows.groupBy("document_id", "dl").agg(*columns).withColumn("hit", F.lit(True))


def phrase_positions(rows: DataFrame, terms: list[str]) -> DataFrame:
    """``(document_id, at_0, ...)`` from postings of the terms, of documents that hold all."""
    at = [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"at_{i}") for i, t in enumerate(terms)]
    return rows.groupBy("document_id").agg(*at).dropna()


class StoredIndex(AdHocIndex):
    """An index that ``save`` wrote; queries read only the buckets of their terms."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str] | None = None, buckets: int = LEAST_BUCKETS):
        super().__init__(spark.read.parquet(f"{path}/docs"), fields)
        self.path, self.buckets, self.spark = path, buckets, spark

    @cached_property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{self.path}/postings")

    @cached_property
    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df long, tf long, bucket int").parquet(f"{self.path}/terms")

    @cached_property
    def dictionary(self) -> DataFrame:
        return self.terms.select("term", "df", "tf")

    @cached_property
    def collection(self) -> DataFrame:
        return self.spark.read.schema("n long, total_length long, avgdl double").parquet(f"{self.path}/collection")

    def _own(self, table: DataFrame, terms: list[str]) -> DataFrame:
        return table.where(F.col("bucket").isin(*term_buckets(terms, self.buckets)) & F.col("term").isin(*terms))

    def among(self, condition: Column) -> None:
        """Postings don't have the fields that choose documents; those are joined."""

    def counted(self, terms: list[str]) -> tuple[DataFrame, DataFrame]:
        found = self._own(self.terms, terms)
        dfs = found.agg(*[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("df"))), F.lit(0)).alias(f"df_{i}") for i, t in enumerate(terms)])
        return count_terms(self._own(self.postings, terms), terms), self.collection.select("n", "avgdl").crossJoin(dfs)  # one row each

    def matching(self, condition: Callable[[Column], Column], held: Column | None = None) -> DataFrame:
        """The dictionary is searched; the buckets of what is found are read."""
        found = self.terms.where(condition(F.col("term"))).select("bucket", "term", "df")
        return self.postings.join(found, ["bucket", "term"]).select("document_id", "dl", "term", "tf", "df")

    def phrase(self, terms: list[str]) -> DataFrame:
        return phrase_positions(self._own(self.postings, terms), terms)
