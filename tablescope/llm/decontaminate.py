"""Benchmark decontamination: size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import windowhash


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = windowhash.CONTAINED) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment``: test items found inside documents.

    See ``windowhash.contained`` for NULLs, short items and repeated ids.
    """
    return windowhash.contained(docs, benchmark, threshold).drop("text_hash")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = windowhash.CONTAINED) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with all their columns."""
    spark = docs.sparkSession
    path = scratch_path(spark, "leaks")
    found = windowhash.contained(docs, benchmark, threshold)
    found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).distinct().write.parquet(path)
    bad = spark.read.schema("__id long, __h long").parquet(path)
    same = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__h"])
    return docs.join(bad, same, "left_anti")
