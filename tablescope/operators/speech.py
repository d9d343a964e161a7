"""Batch jobs over speech-to-text data: response flattening and audio screening.

``flatten_stt`` turns a table of JSON responses of a speech-to-text service
into the five-field transcription result, keeping failed rows with a status
instead of raising.  ``screen_audio`` applies the size checks made before an
upload to a table of audio files (``binaryFile`` source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import curate

NO_TRANSCRIPT = "No transcript returned"

# fixed values: default language, least size and messages for rejected input
DEFAULT_LANGUAGE = "en"
MIN_AUDIO_BYTES = 100
EMPTY_AUDIO = "Empty audio file"
TOO_SHORT = "Recording too short. Hold the button longer."

RESPONSE_SCHEMA = (
    "results struct<channels: array<struct<detected_language: string, "
    "alternatives: array<struct<transcript: string, confidence: double>>>>>, "
    "metadata struct<duration: double>"
)


def flatten_stt(df: DataFrame, response: str | Column = "response", default_language: str = DEFAULT_LANGUAGE) -> DataFrame:
    """Add ``transcript, curated_prompt, confidence, language, duration_seconds, status, error``.

    The first channel's first alternative gives transcript and confidence;
    the channel's detected language, when present and not empty, else
    ``default_language``; the metadata gives the duration.  A missing or
    empty transcript (also for text that is not JSON) is an ``error`` row.
    """
    src = F.col(response) if isinstance(response, str) else response
    parsed = F.from_json(src, RESPONSE_SCHEMA)
    channel = F.get(parsed["results"]["channels"], 0)
    alternative = F.get(channel["alternatives"], 0)
    transcript = F.coalesce(alternative["transcript"], F.lit(""))
    ok = F.length(transcript) > 0
    detected = channel["detected_language"]
    return df.select(
        "*",
        transcript.alias("transcript"),
        F.when(ok, curate(transcript)).alias("curated_prompt"),
        alternative["confidence"].alias("confidence"),
        F.coalesce(F.when(F.length(detected) > 0, detected), F.lit(default_language)).alias("language"),
        parsed["metadata"]["duration"].alias("duration_seconds"),
        F.when(ok, F.lit("complete")).otherwise(F.lit("error")).alias("status"),
        F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(NO_TRANSCRIPT)).alias("error"),
    )


def screen_audio(files: DataFrame, length: str = "length", min_bytes: int = MIN_AUDIO_BYTES) -> DataFrame:
    """Status per audio file: ``error`` when empty or under ``min_bytes``, else ``pending``."""
    n = F.col(length)
    status = F.when(n >= min_bytes, F.lit("pending")).otherwise(F.lit("error"))
    error = F.when(n == 0, F.lit(EMPTY_AUDIO)).when(n < min_bytes, F.lit(TOO_SHORT))
    return files.select("*", status.alias("status"), error.alias("error"))


def audio_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, file_name, length`` of audio files, listed without reading content.

    Spark's file sources skip zero-byte files, so an empty upload never
    appears here; ``screen_audio`` still flags length 0 when the lengths come
    from another table (upload metadata).
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "length")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
