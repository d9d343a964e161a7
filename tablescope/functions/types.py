"""Type names and type classes.

Type names are printed the way the reference's SQL engine prints them in
DESCRIBE output (``BIGINT``, ``VARCHAR``, ``FLOAT[]``, ``TIMESTAMP``), so a
schema result reads the same to a user of the reference.  Classes are decided
by the Spark ``DataType`` class, never by substrings of the name.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

NUMERIC = "numeric"
TEXT = "text"
TEMPORAL = "temporal"
BOOLEAN = "boolean"
OTHER = "other"

_SIMPLE_NAMES = {
    T.BooleanType: "BOOLEAN",
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.BinaryType: "BLOB",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE",
    T.NullType: '"NULL"',
}

_PLAIN_FIELD = re.compile(r"^[a-z_][a-z0-9_]*$")


def _field_name(name: str) -> str:
    if _PLAIN_FIELD.match(name):
        return name
    return '"' + name.replace('"', '""') + '"'


def type_name(dt: T.DataType) -> str:
    """DuckDB-style name of a Spark type."""
    for cls, name in _SIMPLE_NAMES.items():
        if isinstance(dt, cls):
            return name
    if isinstance(dt, (T.VarcharType, T.CharType)):
        return "VARCHAR"
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    if isinstance(dt, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "INTERVAL"
    if isinstance(dt, T.ArrayType):
        return type_name(dt.elementType) + "[]"
    if isinstance(dt, T.MapType):
        return f"MAP({type_name(dt.keyType)}, {type_name(dt.valueType)})"
    if isinstance(dt, T.StructType):
        inner = ", ".join(f"{_field_name(f.name)} {type_name(f.dataType)}" for f in dt.fields)
        return f"STRUCT({inner})"
    time_type = getattr(T, "TimeType", None)
    if time_type is not None and isinstance(dt, time_type):
        return "TIME"
    variant_type = getattr(T, "VariantType", None)
    if variant_type is not None and isinstance(dt, variant_type):
        return "VARIANT"
    return dt.simpleString().upper()


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_temporal(dt: T.DataType) -> bool:
    time_type = getattr(T, "TimeType", None)
    if time_type is not None and isinstance(dt, time_type):
        return True
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested_or_interval(dt: T.DataType) -> bool:
    """Columns that only get ``count`` and ``unique_count`` in the statistics."""
    variant_type = getattr(T, "VariantType", None)
    if variant_type is not None and isinstance(dt, variant_type):
        return True
    return isinstance(
        dt,
        (T.ArrayType, T.MapType, T.StructType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.NullType),
    )


def is_groupable(dt: T.DataType) -> bool:
    """Types that Spark can group by and order (maps and variants cannot)."""
    variant_type = getattr(T, "VariantType", None)
    if variant_type is not None and isinstance(dt, variant_type):
        return False
    if isinstance(dt, T.MapType):
        return False
    if isinstance(dt, T.ArrayType):
        return is_groupable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(is_groupable(f.dataType) for f in dt.fields)
    return True


def is_orderable(dt: T.DataType) -> bool:
    """Types accepted by ``min`` / ``max``."""
    return is_groupable(dt)


def category(dt: T.DataType) -> str:
    """Display category: numeric, text, temporal, boolean or other."""
    if is_numeric(dt):
        return NUMERIC
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if is_temporal(dt):
        return TEMPORAL
    if isinstance(dt, T.BooleanType):
        return BOOLEAN
    return OTHER


def stat_class(dt: T.DataType) -> str:
    """Class that decides which statistics a column gets.

    ``numeric``: mean, std, min, max, quartiles.  ``temporal``: top value and
    text min / max.  ``scalar``: top value.  ``counts``: only count and
    distinct count (nested and interval types).
    """
    if is_numeric(dt):
        return "numeric"
    if is_temporal(dt):
        return "temporal"
    if is_nested_or_interval(dt) or not is_groupable(dt):
        return "counts"
    return "scalar"
