"""Table overview, sample rows and the sample preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literals import literal_rows
from ..functions.numeric import col
from ..sources.files import Source, total_bytes


def overview(src: Source) -> DataFrame:
    """``row_count, column_count, file_name, file_size_bytes, file_type`` in one row.

    The byte size comes from the file system's summary, without a Spark job.
    """
    # A table of the catalog has no path of its own: Spark's statistics sum up its files.
    size = int(src.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if src.fmt == "table" else total_bytes(src.df.sparkSession, src.path)
    return src.df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(src.df.columns)).alias("column_count"),
        F.lit(src.file_name).alias("file_name"),
        F.lit(size).cast("bigint").alias("file_size_bytes"),
        F.lit(src.fmt).alias("file_type"),
    )


def sample_rows(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows.

    Spark has no file order across tasks, so without ``order_by`` any ``n``
    rows are returned (a plain limit); with it, the ``n`` smallest keys
    (a per-task top-n merged once).
    """
    if order_by:
        return df.orderBy(*[col(c) for c in order_by]).limit(n)
    return df.limit(n)


def sample_preview(
    df: DataFrame, n: int = 10, order_by: list[str] | None = None, width: int = 50
) -> DataFrame:
    """Sample rows as display text: ``#`` from 1, values cut to ``width`` characters + ``...``.

    NULL stays NULL.  The row number is computed over the ``n`` sampled rows
    only.
    """
    rows = sample_rows(df, n, order_by)
    key = [col(c) for c in order_by] if order_by else [F.monotonically_increasing_id()]
    numbered = rows.withColumn("#", F.row_number().over(Window.orderBy(*key)))
    cut = []
    for name in df.columns:
        s = col(name).cast("string")
        cut.append(F.when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("..."))).otherwise(s).alias(name))
    return numbered.select(F.col("`#`").alias("#"), *cut)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def table_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, row_count, column_count`` for a set of tables (one job)."""
    parts = [
        t.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(t.columns)).alias("column_count")
        )
        for name, t in sorted(tables.items())
    ]
    if not parts:
        return literal_rows(spark, [], "table_name string, row_count bigint, column_count int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
