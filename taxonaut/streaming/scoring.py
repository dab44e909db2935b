"""Scoring items as they arrive: stateless joins with reference tables, ranks in each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(items: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Scores a stream of items with a batch scorer and writes each batch once, in a folder named by its number.

    Scores of an item depend on that item only, so batches can be ranked
    alone; a batch that is run again overwrites its own folder.
    """

    def batch(rows: DataFrame, number: int) -> None:
        score(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
