"""Value distribution of columns: value counts and top values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col, percent
from . import profile as pr


def attach_total(small: DataFrame, total: DataFrame, name: str) -> DataFrame:
    """Add the single value of a one-row frame to every row of a small frame.

    Done by a union and a window over the union (``small`` plus one row), so
    no join is planned; ``small`` must be bounded (a top-n result).
    """
    marker = "__is_total"
    a = small.withColumn(name, F.lit(None).cast("bigint")).withColumn(marker, F.lit(False))
    b = total.select(
        *[F.lit(None).cast(t).alias(c) for c, t in small.dtypes],
        F.col(name).cast("bigint").alias(name),
        F.lit(True).alias(marker),
    )
    whole = Window.partitionBy()
    return a.unionByName(b).withColumn(name, F.max(name).over(whole)).where(~F.col(marker)).drop(marker)


def value_counts(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """The ``top_n`` most frequent values of a column, NULL included.

    ``value, count, percentage``: percentage of all rows with 2 decimals.
    Ties on count are ordered by value ascending, NULL last.  The grouping
    combines map-side, so a hot value costs one row per task in the shuffle.
    """
    freq = df.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    top = freq.orderBy(F.col("count").desc(), F.col("value").asc_nulls_last()).limit(top_n)
    # the row total is the sum over all groups: the grouping's shuffle is
    # reused, so the table is scanned once
    total = freq.agg(F.sum("count").alias("_total"))
    return (
        attach_total(top, total, "_total")
        .select("value", "count", percent(F.col("count"), F.col("_total"), 2).alias("percentage"))
        .orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
    )


def top_values(df: DataFrame) -> DataFrame:
    """Most frequent non-NULL value (as text) and its frequency per column.

    Only date / time and other scalar non-numeric columns get one; ties go
    to the larger value.  One narrow unpivot-and-group job for all columns.
    """
    specs = [s for s in pr.column_specs(df) if s.stat_class in ("scalar", "temporal")]
    if not specs:
        return df.sparkSession.createDataFrame([], "ordinal int, column_name string, top_value string, top_frequency bigint")
    names = pr._specs_frame(df, specs).select("ordinal", "column_name")
    dt = pr.distinct_and_top(pr.value_frequencies(df, specs), specs)
    return (
        names.join(F.broadcast(dt), "ordinal")
        .select("ordinal", "column_name", "top_value", "top_frequency")
        .orderBy("ordinal")
    )
