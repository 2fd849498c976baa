"""Incremental jobs: references for arriving headers, and history worked off change by change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.contexts import history_pairs
from ..operators.selection import best_reference


def stream_best_references(headers: DataFrame, rules: DataFrame, parameters: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Best references of a stream of headers: every micro-batch runs the batch operator; all that is there, then stop.

    A batch may be delivered twice after a failure: a sink keyed by the batch number
    makes the result exactly-once.
    """

    def work(batch: DataFrame, number: int) -> None:
        sink(best_reference(batch, rules, parameters), number)

    return headers.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_history(history: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each new piece of history to a job as (old_context, new_context) pairs; progress is kept in the checkpoint.

    Pieces arrive in the order of ``idx``.  The last change so far is kept beside the
    checkpoint, one folder for each batch, and goes before the next batch, so a batch
    delivered twice makes the same pairs.
    """
    last = f"{checkpoint.rstrip('/')}-last"

    def work(batch: DataFrame, number: int) -> None:
        rows = batch.select("idx", "context")
        if number:
            rows = rows.unionByName(batch.sparkSession.read.schema(rows.schema).parquet(f"{last}/{number - 1}"))
        rows.orderBy(F.desc("idx")).limit(1).write.mode("overwrite").parquet(f"{last}/{number}")
        job(history_pairs(rows), number)

    return history.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
