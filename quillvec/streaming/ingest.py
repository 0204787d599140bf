"""Applies a stream of changes to an incremental index, a micro-batch at a time.

A change has op (add or delete), id and embedding.  Batches are numbered, and added rows carry their batch's number, written with
them: a batch that is delivered again, wherever a failure cut it off, adds nothing twice, and deleting again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.incremental import IncrementalIndex

CHANGES = "op string, id long, embedding array<float>"


def apply_changes(index: IncrementalIndex, changes: DataFrame, batch: int) -> None:
    """Adds, then deletes; the rows of a batch number that was added already are not added again."""
    if not index.has_batch(batch):
        index.add(changes.where("op = 'add'").select("id", "embedding"), batch)
    index.delete(changes.where("op = 'delete'").select("id"))


def ingest(stream: DataFrame, index: IncrementalIndex, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts to apply a stream of CHANGES; trigger: of writeStream, availableNow for what there is."""
    writer = stream.writeStream.foreachBatch(lambda df, n: apply_changes(index, df, n)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
