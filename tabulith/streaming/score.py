"""Scoring a stream of new rows with a kept run.

Preparation and model are projections with the fitted values as literals, so the
stream has no state and needs no watermark.  A column mismatch is found while the
query is built, before any row is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.runs import Run, predict_run
from ..session import checkpoint_dir


def score_stream(stream: DataFrame, run: Run, model_key: str) -> DataFrame:
    """The scored stream, ready for ``writeStream`` in append mode."""
    if not stream.isStreaming:
        raise ValueError("Expected a streaming table; use predict_run for batches.")
    return predict_run(run, model_key, stream)


def start_scoring(
    stream: DataFrame, run: Run, model_key: str, path: str, name: str, once: bool = False
) -> StreamingQuery:
    """Write scores as parquet; progress is kept in the shared checkpoint folder."""
    progress = f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/streams/{name}"
    writer = (
        score_stream(stream, run, model_key).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", progress)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
