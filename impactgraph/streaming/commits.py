"""Re-running a selection as changes arrive: a stream of changed definitions, answered batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import Graph
from ..operators.walk import impacted_tests


def watch(changes: DataFrame, graph: Callable[[], Graph], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Answers each micro-batch of changes (def_id) with the impacted tests of the current graph, handed to sink(tests, batch_id).

    The graph is read anew for each batch, so an index that was rebuilt meanwhile counts. A batch that is run again gives the same tests.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        seeds = batch.where("def_id IS NOT NULL").select("def_id").distinct()
        sink(impacted_tests(graph(), seeds), batch_id)

    writer = changes.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
