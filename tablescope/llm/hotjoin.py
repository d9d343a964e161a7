"""Joins that no key can pile up in one task, and a filter that keeps rows at home."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 4096  #: a key of fewer rows is never hot
HOT_KEYS = 2000  #: at most so many keys are hot, whatever the size of the table


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, size: str = "n") -> DataFrame:
    """``left`` joined with ``right``, which has at most one row for each value of ``keys``.

    A key that holds more than ``HOT_ROWS`` rows of ``left`` and more than its
    ``1 / HOT_KEYS`` is hot: there are at most ``HOT_KEYS`` of them, so their
    rows of ``right`` are broadcast.  All others go through a sort-merge join.
    ``counts`` has the rows of each key as ``size``, where they are known.  Keys
    are not NULL; ``how`` is ``inner`` or ``left``.  ``left`` is read more than
    once and should be a written table.
    """
    sizes = counts if counts is not None else left.groupBy(*keys).agg(F.count("*").alias(size))
    total = sizes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(sizes.filter(F.col(size) > limit).select(*keys))
    if total <= HOT_ROWS or hot.isEmpty():
        return left.join(right.hint("merge"), keys, how)
    few = F.broadcast(right.join(hot, keys, "left_semi"))
    often = left.join(hot, keys, "left_semi").join(few, keys, how)
    return often.unionByName(left.join(hot, keys, "left_anti").join(right.hint("merge"), keys, how))


MOST_BITS = 27  #: 16 MB


def only_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The rows whose long ``key`` may be among those of ``members``; a join has to follow.

    A bitmap of hashed keys, of ``MOST_BITS`` at most, is broadcast and tested
    where the rows lie, so that the join need not move the others.  A
    full bitmap lets more rows pass and loses none.
    """
    spark = rows.sparkSession
    bits = min(MOST_BITS, max(15, math.ceil(math.log2(32 * members.count() + 1))))
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    at = members.select((place + 1).alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for r in maps.toLocalIterator():  # 4,096 bytes each, 16 MB in all at most
        bitmap[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bitmap, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("__at").to_numpy()
            held = (shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            if held.any():
                yield batch.drop_columns(["__at"]).filter(pa.array(held))

    return rows.withColumn("__at", place).mapInArrow(run, rows.schema)
