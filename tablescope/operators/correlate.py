"""Pearson correlations between numeric columns.

Each pair uses the rows where both values are present (like SQL ``CORR``).  A
constant or all-NULL column gives NULL.

Two scans whatever the number of columns.  The first takes the range of every
column, so that columns of huge values are scaled down by a power of two and
no sum overflows.  In the second each task adds up, for every pair at once, the
count, means, root sums of squares about the means and the correlation of the
rows that have both (matrix products over Arrow batches, centred by the batch).
Where that centre is far from a pair's own values, because of values beside a
NULL of the other column, the pair is centred by its own rows.  The tasks'
figures are merged by pair, so values and NULLs in other rows or columns play
no part, and a pair's column is constant only if its own rows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.literals import literal_rows
from ..functions.numeric import col, round_half_up
from . import profile as pr

STRONG = 0.7
_SCHEMA = "col1 string, col2 string, corr double"
_SUMS = "i int, j int, n double, mx double, my double, rx double, ry double, c double"
_FAR = 1e-6  #: below this part of the sum of squares, a variance about a common centre is not exact enough
_SMALL = 1e-200  #: smaller sums of squares may have lost digits
_HUGE, _DOWN = 2.0**900, 2.0**-200  #: columns with values beyond this are scaled down by so much


def guarded_corr(x, y):
    """One pair as an aggregate; NULL instead of a division by zero."""
    xd, yd = x.cast("double"), y.cast("double")
    sx = F.stddev_samp(F.when(yd.isNotNull(), xd))
    sy = F.stddev_samp(F.when(xd.isNotNull(), yd))
    return F.try_divide(F.covar_samp(xd, yd), sx * sy)


def numeric_columns(df: DataFrame) -> list[str]:
    return [s.name for s in pr.column_specs(df) if s.stat_class == "numeric"]


def _spread(x: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Mean, root of the sum of squares about it, and the deviations as parts of that root; exact for equal values."""
    shift = x - x[0]
    mean = shift.mean()
    away = shift - mean
    widest = np.abs(away).max()
    if not widest > 0:
        return x[0] + mean, widest, away
    away /= widest
    root = np.sqrt(away @ away)
    return x[0] + mean, widest * root, away / root


def _batch_sums(x: np.ndarray, here: np.ndarray) -> np.ndarray:
    """(n, mx, my, rx, ry, c) of all pairs of columns in the rows of a batch."""
    rows, k = x.shape
    there = here.astype(float)
    first = x[here.argmax(axis=0), np.arange(k)] if rows else np.zeros(k)
    z = np.where(here, x - first, 0.0)
    mean = z.sum(axis=0) / np.maximum(there.sum(axis=0), 1)
    z = np.where(here, z - mean, 0.0)
    scale = np.abs(z).max(axis=0, initial=0.0)
    equal = scale == 0
    scale[equal] = 1.0
    z /= scale
    n = there.T @ there
    some = np.maximum(n, 1)
    sx, sxx, sxy = z.T @ there, (z * z).T @ there, z.T @ z
    vx, cov = sxx - sx * sx / some, sxy - sx * sx.T / some
    near = (vx > _FAR * sxx) & (sxx > _SMALL) | equal[:, None]
    vx = np.where(equal[:, None], 0.0, vx)
    rx = np.sqrt(np.maximum(vx, 0.0))
    c = np.divide(cov, rx * rx.T, out=np.zeros_like(cov), where=rx * rx.T > 0)
    mx = first[:, None] + mean[:, None] + scale[:, None] * sx / some
    rx = rx * scale[:, None]
    out = np.stack([n, mx, mx.T, rx, rx.T, c])
    out[:, n == 0] = 0.0
    for i, j in np.argwhere(np.triu((n > 0) & ~(near & near.T))):
        both = here[:, i] & here[:, j]
        (mi, ri, di), (mj, rj, dj) = _spread(x[both, i]), _spread(x[both, j])
        out[:, i, j] = n[i, j], mi, mj, ri, rj, di @ dj
    return out


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Figures of the rows of both; ratios only, so that neither large nor small values are lost in squares."""
    n = a[0] + b[0]
    some, none = np.maximum(n, 1), (a[0] == 0) | (b[0] == 0)
    part = np.sqrt(a[0] / some) * np.sqrt(b[0])
    dx, dy = b[1] - a[1], b[2] - a[2]
    mx, my = a[1] + dx * (b[0] / some), a[2] + dy * (b[0] / some)
    ex, ey = dx * part, dy * part
    rx, ry = np.hypot(np.hypot(a[3], b[3]), ex), np.hypot(np.hypot(a[4], b[4]), ey)
    ux, uy = np.where(rx == 0, 1.0, rx), np.where(ry == 0, 1.0, ry)
    c = a[5] * (a[3] / ux) * (a[4] / uy) + b[5] * (b[3] / ux) * (b[4] / uy) + (ex / ux) * (ey / uy)
    return np.where(none, np.where(b[0] == 0, a, b), np.stack([n, mx, my, rx, ry, c]))


def _pair_sums(scale: list[float]):
    """Batches of numeric columns -> one row of figures for each pair of columns and task."""
    k = len(scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.empty((batch.num_rows, k))
            for c in range(k):
                x[:, c] = batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False) * scale[c]
            here = np.column_stack([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in range(k)])
            with np.errstate(all="ignore"):  # NaN and infinite values make the pairs of their rows NaN
                sums = _batch_sums(x, here)
                total = sums if total is None else _merge(total, sums)
        if total is not None:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t[i, j]) for t in total]], names=["i", "j", "n", "mx", "my", "rx", "ry", "c"]
            )

    return run


def _merged(a, b):
    """``_merge`` as an expression over structs."""
    n = a["n"] + b["n"]
    part = F.sqrt(a["n"] / n) * F.sqrt(b["n"])
    ex, ey = (b["mx"] - a["mx"]) * part, (b["my"] - a["my"]) * part
    rx, ry = F.hypot(F.hypot(a["rx"], b["rx"]), ex), F.hypot(F.hypot(a["ry"], b["ry"]), ey)
    ux, uy = F.when(rx == 0, F.lit(1.0)).otherwise(rx), F.when(ry == 0, F.lit(1.0)).otherwise(ry)
    c = a["c"] * (a["rx"] / ux) * (a["ry"] / uy) + b["c"] * (b["rx"] / ux) * (b["ry"] / uy) + (ex / ux) * (ey / uy)
    mx, my = (a[m] + (b[m] - a[m]) * (b["n"] / n) for m in ("mx", "my"))
    both = F.struct(n.alias("n"), mx.alias("mx"), my.alias("my"), rx.alias("rx"), ry.alias("ry"), c.alias("c"))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def correlations(df: DataFrame, columns: list[str] | None = None, digits: int | None = 3) -> DataFrame:
    """Long form ``(col1, col2, corr)`` for every ordered pair, diagonal included.

    Fewer than two numeric columns give an empty result and a warning.  The
    first scan runs here; it brings two numbers a column to the driver.
    """
    names = columns or numeric_columns(df)
    spark = df.sparkSession
    if len(names) < 2:
        warnings.warn("not enough numeric columns for correlation analysis", stacklevel=2)
        return literal_rows(spark, [], _SCHEMA)
    numbers = df.select(*[col(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    scale = [1.0] * len(names)
    for f in pr.column_facts(numbers).select("ordinal", "min_num", "max_num").collect():
        if f.min_num is not None and max(abs(f.min_num), abs(f.max_num)) > _HUGE:
            scale[f.ordinal - 1] = _DOWN
    figures = ("n", "mx", "my", "rx", "ry", "c")
    parts = numbers.mapInArrow(_pair_sums(scale), _SUMS).groupBy("i", "j").agg(F.collect_list(F.struct(*figures)).alias("parts"))
    none = F.struct(*[F.lit(0.0).alias(f) for f in figures])
    sums = parts.select("i", "j", F.aggregate("parts", none, _merged).alias("t")).select("i", "j", "t.*")
    varies = (F.col("n") > 1) & (F.col("rx") > 0) & (F.col("ry") > 0)
    unknown = F.isnan("rx") | F.isnan("ry") | F.isnan("c")
    r = F.when((F.col("n") > 1) & unknown, F.lit(float("nan"))).when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c"))))
    lookup = F.array(*[F.lit(n) for n in names])
    r = r if digits is None else round_half_up(r, digits)
    upper = sums.select(F.get(lookup, F.col("i")).alias("a"), F.get(lookup, F.col("j")).alias("b"), r.alias("corr"))
    both = F.array(F.struct(F.col("a").alias("col1"), F.col("b").alias("col2")), F.struct(F.col("b").alias("col1"), F.col("a").alias("col2")))
    sides = F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)
    return upper.select(F.explode(sides).alias("p"), "corr").select("p.col1", "p.col2", "corr")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, digits: int | None = 3) -> DataFrame:
    """The matrix form: one row per column, one column per numeric column."""
    names = columns or numeric_columns(df)
    long = correlations(df, names, digits)
    if len(names) < 2:
        return long
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("col1"))
    return (
        long.groupBy("col1")
        .pivot("col2", names)
        .agg(F.first("corr"))
        .withColumn("_o", order)
        .orderBy("_o")
        .drop("_o")
        .withColumnRenamed("col1", "column")
    )


def strong_correlations(corr: DataFrame, threshold: float = STRONG) -> DataFrame:
    """Cells above ``threshold`` (positive) or below ``-threshold`` (negative)."""
    return corr.where(F.abs(F.col("corr")) > threshold).withColumn(
        "strength", F.when(F.col("corr") > 0, "positive").otherwise("negative")
    )


def pair_correlation(df: DataFrame, x: str, y: str, digits: int | None = 3) -> DataFrame:
    """Correlation of two columns: one row ``(col1, col2, corr)``."""
    r = guarded_corr(col(x), col(y))
    if digits is not None:
        r = round_half_up(r, digits)
    return df.agg(r.alias("corr")).select(F.lit(x).alias("col1"), F.lit(y).alias("col2"), "corr")
