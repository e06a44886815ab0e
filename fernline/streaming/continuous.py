"""Running queries continuously."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from ..engine import Engine
from ..errors import QueryError
from ..lang.parser import parse
from ..sources.catalog import Catalog


def stream_query(stream: DataFrame, text: str, name: str = "events", catalog: Catalog | None = None, params: dict[str, object] | None = None) -> DataFrame:
    """The streaming result of a query whose ``.name[]`` is ``stream``; other tables come from ``catalog``."""
    tree = parse(text)
    if tree.collect is not None or tree.limit is not None or tree.order and tree.aggregate is None:
        raise QueryError("collect, limit and order by without aggregate need all rows, which a stream never has")
    if tree.distinct is not None and tree.distinct:
        raise QueryError("distinct by keeps the first row, which needs an order that a stream doesn't have")
    whole = replace(catalog, tables=dict(catalog.tables)) if catalog else Catalog()
    return Engine(whole.add(name, stream)).query(tree, params)


def append_windows(stream: DataFrame, time_column: str, window: str, watermark: str, slide: str | None = None) -> DataFrame:
    """``stream`` with window_start and window_end of a time column and a watermark on it; late rows beyond it are dropped by stateful operators."""
    if isinstance(stream.schema[time_column].dataType, TimestampNTZType):  # watermarks need an instant
        stream = stream.withColumn(time_column, F.col(time_column).cast("timestamp"))
    marked = stream.withWatermark(time_column, watermark)
    w = F.window(time_column, window, slide) if slide else F.window(time_column, window)
    return marked.withColumn("window", w).withColumn("window_start", F.col("window.start")).withColumn("window_end", F.col("window.end"))


def write_stream(df: DataFrame, path: str, checkpoint: str, form: str = "parquet", mode: str = "append", once: bool = False) -> StreamingQuery:
    """Write a streaming result to files; ``once`` takes what is there now and stops."""
    writer = df.writeStream.format(form).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
