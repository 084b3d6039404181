"""New records of a stream are put in existing clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facetmill.operators.providers import Embedder, embedded
from facetmill.operators.similarity import assign


def assigned_stream(records: DataFrame, centres: np.ndarray, embedder: Embedder, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query over (record_id, text) that hands sink each batch's (record_id, cluster, similarity)."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(assign(embedded(rows, embedder, "text"), centres, "vec"), number)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) per window and type; those later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
