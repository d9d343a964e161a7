"""Transcript clean-up on a stream.

The clean-up is stateless (one Column expression per row), so the same
expression runs unchanged on a Structured Streaming source: no watermark or
state store is needed, and the file sink with a checkpoint gives
exactly-once output that survives restarts and lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.numeric import col
from ..functions.text import curate


def curated(stream: DataFrame, text: str, out: str = "curated_prompt") -> DataFrame:
    """Add the cleaned prompt to a (streaming or batch) frame."""
    return stream.withColumn(out, curate(col(text)))


def start_curate_stream(
    spark: SparkSession,
    source: str,
    schema,
    text: str,
    sink: str,
    checkpoint: str,
    fmt: str = "parquet",
    available_now: bool = True,
    processing_time: str | None = None,
    glob: str | None = None,
) -> StreamingQuery:
    """Read new files of ``source`` as a stream, clean ``text``, append to ``sink``.

    ``source`` is a directory; ``glob`` narrows it to matching file names.
    ``available_now`` processes what is there and stops (a catch-up batch
    run); otherwise a ``processing_time`` trigger keeps the query running.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.load(source)
    writer = (
        curated(stream, text)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
