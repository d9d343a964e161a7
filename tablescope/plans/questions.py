"""Free SQL over loaded tables and the common follow-up questions as functions.

* ``run_sql``: any Spark SQL over the registered tables.
* ``grouped_average``: "average sales grouped by region".
* ``pair_correlation``: "correlation between price and quantity".
* ``filtered_summary``: "filter data to 2023 and provide a summary"; the
  year is a range on the raw column so the filter reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import col
from ..operators import correlate
from ..operators import profile as pr


def register_tables(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL text; ``tables`` are registered as temporary views first."""
    if tables:
        register_tables(tables)
    return spark.sql(text)


def grouped_average(df: DataFrame, by: str | list[str], metric: str, name: str | None = None) -> DataFrame:
    """Average of ``metric`` per group, with the group size."""
    keys = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*[col(k) for k in keys]).agg(
        F.avg(col(metric)).cast("double").alias(name or f"avg_{metric}"),
        F.count(F.lit(1)).alias("row_count"),
    )


pair_correlation = correlate.pair_correlation


def year_filter(df: DataFrame, column: str, year: int) -> DataFrame:
    """Rows whose ``column`` falls in ``year`` (bounds pushable to the scan)."""
    dt = df.schema[column].dataType
    target = "date" if isinstance(dt, T.DateType) else dt.simpleString()
    lo = F.lit(f"{year:04d}-01-01").cast(target)
    hi = F.lit(f"{year + 1:04d}-01-01").cast(target)
    return df.where((col(column) >= lo) & (col(column) < hi))


def filtered_summary(df: DataFrame, column: str, year: int, approx: bool = False) -> DataFrame:
    """Statistical summary of the rows of one year."""
    return pr.statistics(year_filter(df, column, year), approx=approx)
