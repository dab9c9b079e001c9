"""Mixing sources to target weights, to the token.

Every row gets a hash-random key. The narrow rows (source, key, tokens) are
range-sorted by source and key; prefix sums of the token counts are taken in
each partition and shifted by the totals of the partitions before it. A source
is cut at the last key whose prefix sum fits its budget, after as many whole
epochs as the budget holds. Texts are never shuffled: the cut is one key a
source, compared with each row's key in a second scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import narrow, place, positional
from .scratch import BROADCAST_ROWS, Scratch

SEED = "mix-1"
#: Sources without a weight of their own have this one.
DEFAULT_WEIGHT = 1.0


def token_count(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def mix_key(doc_id: Column, seed: str = SEED) -> Column:
    """Hash-random key of a doc_id, 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix sums by source in a sorted partition, whatever the batches' ends."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("source").dictionary_encode().indices.fill_null(-1).to_numpy()
        tokens = batch.column("tokens").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        run = np.cumsum(tokens)
        before = np.repeat(run[start] - tokens[start], np.diff(np.append(start, len(codes))))
        run = run - before
        first, end = batch.column("source")[0].as_py(), start[1] if len(start) > 1 else len(codes)
        if last is not None and last[0] == first:
            run[:end] += total
        last, total = (batch.column("source")[-1].as_py(),), int(run[-1])
        yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("key"), pa.array(run), pa.array(np.full(len(run), part, np.int32))], names=["source", "key", "run", "part"])


def cuts(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """``(source, total, budget, epochs, cut)`` for each source, null among them.

    ``budget`` tokens, as many as ``docs`` has by default, are shared out in
    proportion to the weights of the sources that are there and have tokens;
    each share is rounded down. ``cut`` is the greatest key of the last, partial
    epoch, null if it is empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = narrow(docs, "source", "doc_id", "text").select(F.col("source").cast("string").alias("source"), mix_key(F.col("doc_id"), seed).alias("key"), token_count(F.col("text")).alias("tokens"))
    # Rows of one key stay or go together, so they are one entry.
    entries = rows.groupBy("source", "key").agg(F.sum("tokens").alias("tokens"))
    placed = entries.repartitionByRange(spark.sparkContext._jsc.sc().defaultParallelism() if spark.conf.get("spark.sql.shuffle.partitions") is None else int(spark.conf.get("spark.sql.shuffle.partitions")), "source", "key").sortWithinPartitions("source", "key")
    sums = scratch.write(placed.mapInArrow(_running, "source string, key string, run long, part int"), "sums")

    # One row a source and partition: the totals, and what comes before.
    parts = sums.groupBy("source", "part").agg(F.max("run").alias("own"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.write(parts.withColumn("before", F.coalesce(F.sum("own").over(ahead), F.lit(0))), "parts")

    weight = F.lit(DEFAULT_WEIGHT)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    per = parts.groupBy("source").agg(F.sum("own").alias("total")).withColumn("weight", F.when(F.col("total") > 0, weight).otherwise(F.lit(0.0)))
    whole = per.agg(F.sum("total").alias("t"), F.sum("weight").alias("w"))
    share = F.floor((F.lit(budget) if budget is not None else F.col("t")) * F.col("weight") / F.col("w")).cast("long")
    per = per.crossJoin(F.broadcast(whole)).select("source", "total", F.when(F.col("w") > 0, share).otherwise(F.lit(0)).cast("long").alias("budget"))  # `whole` is one row
    per = per.withColumn("epochs", F.when(F.col("total") > 0, F.floor(F.col("budget") / F.col("total"))).otherwise(F.lit(0)).cast("long"))
    per = scratch.write(per, "sources")

    rest = parts.alias("p").join(per.alias("s"), F.expr("p.source <=> s.source")).select(F.col("p.source").alias("src"), F.col("p.part").alias("pt"), "before", (F.col("budget") - F.col("epochs") * F.col("total") - F.col("before")).alias("room")).where("room > 0")
    size = rest.count()
    fit = sums.join(F.broadcast(rest) if size <= BROADCAST_ROWS // 8 else rest, F.expr("source <=> src and part = pt and run <= room")).groupBy("source").agg(F.max("key").alias("cut"))
    return per.alias("s").join(fit.alias("f"), F.expr("s.source <=> f.source"), "left").select("s.source", "total", "budget", "epochs", "cut")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as its source's budget asks; all its columns, whatever their names.

    ``docs`` has ``doc_id``, ``text`` and ``source``. Within a source the mix is
    the longest run of whole documents, in the order of their keys and round
    after round, whose tokens don't exceed the budget.

    * A null source is a source of its own, of the default weight.
    * Null and empty texts have no tokens; they stay if their key is within the
      cut or an epoch is complete. A source without tokens gets no budget, and
      none of its rows stay.
    * Rows that share source and doc_id, null too, share a key: they stay or go
      together, as one entry of their summed tokens.
    * No documents: no rows. A weight of 0 drops its source.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    table = scratch.write(cuts(docs, weights, budget, seed).select(F.col("source").alias("mix_source"), F.col("epochs").alias("mix_epochs"), F.col("cut").alias("mix_cut")), "cuts")
    size = table.count()
    plain = positional(docs)
    source, doc_id = (F.col(f"c{place(docs, n)}") for n in ("source", "doc_id"))
    joined = plain.join(F.broadcast(table) if size <= BROADCAST_ROWS // 8 else table, source.cast("string").eqNullSafe(F.col("mix_source")))
    times = F.col("mix_epochs") + F.when(mix_key(doc_id, seed) <= F.col("mix_cut"), 1).otherwise(0)
    epochs = F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>")))
    return joined.withColumn("mix_epoch", epochs).select(*plain.columns).toDF(*docs.columns)
