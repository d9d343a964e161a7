"""Rounding and guarded arithmetic shared by all operators.

Python, Spark and DuckDB each round halves differently, so every rounded
figure goes through one formula, ``floor(x * 10^d + 0.5) / 10^d``, written the
same way in the oracle SQL.  Values too large for the intermediate ``floor``
are passed through unrounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = 2.0**53  # whole numbers below this are exact in a double


def round_half_up(col: Column | str, digits: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    c = c.cast("double")
    scale = float(10**digits)
    scaled = F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(F.abs(c) < F.lit(_EXACT / scale), scaled).otherwise(c)


def round_sql(expr: str, digits: int) -> str:
    """The same formula as SQL text (Spark SQL and DuckDB alike)."""
    scale = f"{10**digits}.0"
    return (
        f"(CASE WHEN abs(CAST({expr} AS DOUBLE)) < {_EXACT / 10**digits!r}e0 "
        f"THEN CAST(floor(CAST({expr} AS DOUBLE) * {scale} + 0.5) AS DOUBLE) / {scale} "
        f"ELSE CAST({expr} AS DOUBLE) END)"
    )


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole * 100`` rounded; 0 when ``whole`` is 0 (reference rule)."""
    raw = part.cast("double") / whole.cast("double") * F.lit(100.0)
    return F.when(whole > 0, round_half_up(raw, digits)).otherwise(F.lit(0.0))


def quote(name: str) -> str:
    """Backtick-quote a column name for Spark expressions."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))
