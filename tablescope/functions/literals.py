"""Small frames of constants, planned as a local relation: no task, no Python rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _literal(value: object) -> str:
    """A plain value as a SQL literal; the column's type is cast around it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"'{value!r}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of plain values with the columns of ``schema``."""
    fields = T.StructType.fromDDL(schema).fields
    values = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows or [(None,) * len(fields)])
    casts = ", ".join(f"CAST(c{i} AS {f.dataType.simpleString()}) AS `{f.name}`" for i, f in enumerate(fields))
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})" + ("" if rows else " WHERE false"))
