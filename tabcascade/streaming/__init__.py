"""Fitted row rules on a stream.

Every ``apply_*`` function is a projection, so it takes a streaming frame as it
is. No state is kept and no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_applied(
    source: DataFrame,
    apply: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Start a query that writes the applied rows of all available input to Parquet."""
    return (
        apply(source)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
