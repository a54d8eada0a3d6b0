"""Replays of a table through a stream: what a live query gives is held against what a batch gives, restarts included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from harrow.operators import records

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STOPPED = "the replay stops this batch once"


def stopping(sink: Callable[[DataFrame, int], None], at: int) -> Callable[[DataFrame, int], None]:
    """A sink that fails once after it has written a batch, before the query counts the batch as done; so it is run again."""
    left = [at]

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if batch_id in left:
            left.remove(batch_id)
            raise RuntimeError(STOPPED)

    return write


def replay(rows: DataFrame, order: str, start: Callable[[DataFrame], DataStreamWriter], slices: int = 3) -> None:
    """Feed a table to a streaming query in slices of its order (a column of numbers), the first rows first.

    The query is started for each slice, works off what has come, and ends; the next start goes on from its checkpoint. A
    failure that ``stopping`` has made is followed by one more start. Slices and checkpoint lie in the folder that the cluster shares.
    """
    spark = rows.sparkSession
    source, state = records.shared_path(spark, "replay"), records.shared_path(spark, "state")
    rows = records.cut(rows, "replayed")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return
    was = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # the only one that stateful processors work with
    try:
        for k in range(slices):
            own = F.least(F.floor((F.col(order) - low) * slices / (high - low + 1)), F.lit(slices - 1)) == k
            rows.where(own).write.parquet(f"{source}/slice-{k}")
            stream = spark.readStream.schema(rows.schema).parquet(f"{source}/slice-*")
            for attempt in range(2):
                q = start(stream).option("checkpointLocation", state).trigger(availableNow=True).start()
                try:
                    q.awaitTermination()
                    break
                except StreamingQueryException as e:
                    if STOPPED not in str(e) or attempt:
                        raise
    finally:
        spark.conf.set(STORE, was)
