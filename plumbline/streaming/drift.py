"""Drift checks over arriving snapshots: an extension, batch by batch.

Each micro-batch of a stream of keyed rows is compared with a fixed snapshot by the
same row diff that batch queries use, and its changes are appended to a Parquet table
with the batch's number.  Replayed batches overwrite their own partition, so a restart
after a failure leaves no change twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.diff import row_diff


def stream_row_drift(stream: DataFrame, snapshot: DataFrame, keys: Sequence[str], out: str, checkpoint: str, columns: Sequence[str] | None = None) -> StreamingQuery:
    """Write the changes of each batch to ``out``/batch=N; ends when what is there has been read.

    Only keys that a batch holds are compared: rows that a batch lacks are not removals.
    Each batch must have a key once.
    """

    def compare(batch: DataFrame, number: int) -> None:
        known = snapshot.join(batch.select(*keys).distinct(), list(keys), "left_semi")
        row_diff(known, batch, keys, columns).withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
