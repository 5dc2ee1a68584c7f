"""Appending a stream to a table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridspan.sources.files import Files
from gridspan.sources.table import Table


def append_stream(stream: DataFrame, table: Table, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Write each micro-batch once.

    The number of a stream's last batch is committed together with the batch's rows, so a batch that is repeated after a
    crash is left out. The stream goes by the identity that Spark keeps in its checkpoint: streams never share one, and
    a stream that starts anew with another checkpoint has another.
    """
    progress = Files(stream.sparkSession, checkpoint)

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()  # a write reads its rows twice
        try:
            table.write(batch, (progress.read("metadata")["id"], number))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
