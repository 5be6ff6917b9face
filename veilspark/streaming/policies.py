"""Run fitted policies on a stream.

Suppression, fences, rounding, recoding and decimals are stateless projections once
fitted, so the batch policy is the streaming policy. Noise joins its table of class
diameters, a stream-static join; ``NoisePolicy.settled`` writes that table out first, so
no micro-batch measures the classes again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def protect_stream(stream: DataFrame, policies: Sequence) -> DataFrame:
    """The stream with every policy applied in the given order."""
    return reduce(lambda df, policy: policy.transform(df), policies, stream)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, exactly once, into Parquet files, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
