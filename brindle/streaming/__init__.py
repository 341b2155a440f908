"""Queries of the dialect over streams.

The dialect has no words for watermarks or windows; a streaming DataFrame is a
table like any other, and what Spark allows on streams is allowed. Watermarks
are set on the DataFrame before it goes into the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from brindle.query import Query


def is_streaming(query: Query) -> bool:
    return query.dataframe().isStreaming


def start(query: Query, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a query into an in-memory table of that name until what is there is read."""
    df: DataFrame = query.dataframe()
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
