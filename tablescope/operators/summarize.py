"""One-pass summary of every column, in the shape of SQL ``SUMMARIZE``.

``column_name, column_type, min, max, approx_unique, avg, std, q25, q50,
q75, count, null_percentage``.  Distinct counts are HyperLogLog++ sketches
and quartiles come from ``percentile_approx``: the whole summary is map-side
partial aggregates merged once, one scan per column group and no shuffle of
values.  ``min`` and ``max`` are text; numbers stay DOUBLE.  Moments and
quartiles are given for numeric columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import percent
from . import profile as pr


def summarize(df: DataFrame, accuracy: int = 10000, sketches: bool = True) -> DataFrame:
    """The summary frame; ``sketches=False`` leaves out the approximate columns
    (``approx_unique`` and the quartiles come back NULL) and their cost."""
    specs = pr.column_specs(df)
    facts = pr.column_facts(df, approx=sketches, accuracy=accuracy, text_extremes=True)
    names = pr._specs_frame(df, specs)
    return (
        names.join(F.broadcast(facts), "ordinal")
        .select(
            "ordinal",
            "column_name",
            F.col("dtype").alias("column_type"),
            F.col("min_text").alias("min"),
            F.col("max_text").alias("max"),
            "approx_unique",
            F.col("mean").alias("avg"),
            "std",
            "q25",
            F.col("median").alias("q50"),
            "q75",
            F.col("rows").alias("count"),
            percent(F.col("rows") - F.col("non_null"), F.col("rows"), 2).alias("null_percentage"),
        )
        .orderBy("ordinal")
    )
