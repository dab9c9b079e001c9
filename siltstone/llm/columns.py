"""Columns by place, so that extra columns may have any names.

A name with a dot, and one that differs from another only in case, can't be
told apart by Spark's own resolution; a column's place can.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices


def place(df: DataFrame, name: str) -> int:
    """Where a column is: the one of exactly this name, else the only one of this name in another case."""
    if name in df.columns:
        return df.columns.index(name)
    alike = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return alike[0]


def positional(df: DataFrame) -> DataFrame:
    """``df`` with the columns ``c0``, ``c1``, ...; ``toDF(*df.columns)`` undoes it."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only some columns, under these names."""
    return positional(df).select(*[F.col(f"c{place(df, n)}").alias(n) for n in names])


def keep_rows(docs: DataFrame, decide: Callable[[pa.Array], np.ndarray], limit: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` whose text ``decide`` keeps, in batches of about ``limit`` bytes of text; all columns, no shuffle."""
    plain, at = positional(docs), f"c{place(docs, 'text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at, limit):
                yield batch.filter(pa.array(decide(batch.column(at)), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
