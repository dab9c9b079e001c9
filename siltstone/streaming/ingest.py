"""A change feed into an index, by Structured Streaming.

The feed has ``(seq, op, id, body)``; an addition replaces a document of its id.
Each micro-batch is one batch of the index's log, and the same manifest names
both, so a batch that is delivered again after a failure is not applied twice,
wherever the failure was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources.store import Store, first_of_each, validate


def apply_batch(store: Store, name: str, batch: DataFrame, batch_id: int) -> None:
    """Apply one micro-batch: per id the last change counts; invalid additions are skipped."""
    if store.feed_batch(name) >= batch_id:
        return
    last = first_of_each(batch.select("seq", "op", F.trim("id").alias("id"), "body"), "id", [F.desc("seq")])
    checked = validate(last.where("op = 'add'").select("seq", "id", "body"), store.mapping(name)).where("error is null").select("seq", F.lit("add").alias("op"), "id", "body")
    store._append(name, checked.unionByName(last.where("op = 'remove'").select("seq", "op", "id", "body")), batch_id)


def ingest(feed: DataFrame, store: Store, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start feeding a streaming DataFrame into an index."""
    writer = feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: apply_batch(store, name, df, i))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
