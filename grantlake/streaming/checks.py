"""Checks over streams of requests."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import Engine


def check_stream(requests: DataFrame, engine: Callable[[], Engine], path: str, checkpoint: str, context: Mapping | None = None) -> StreamingQuery:
    """Checks each micro-batch of a stream of requests in bulk and appends the answers as Parquet.

    engine() is called for every batch, so batches see the store as it is then. Recursion needs rounds,
    which a streaming plan cannot hold; a batch can.
    """

    def one(batch: DataFrame, _: int) -> None:
        engine().bulk_check(batch, context).write.mode("append").parquet(path)

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
