"""Column profiles of a table in a fixed number of Spark jobs.

Jobs per table:

* facts: one global aggregate per group of ``GROUP`` columns - row count,
  non-null count, mean, sample standard deviation, min and max.  Partial
  aggregation happens on the map side; the final merge sees one small buffer
  per task.  With Parquet each group reads only its own columns.
* frequencies: one scan unpivots the columns into a narrow long table
  ``(ord, value slots)`` and groups it - one row per distinct value of each
  column.  Hot values are combined map-side before the shuffle.  A second,
  tiny aggregate keyed by column gives exact distinct counts and top values.
* quantiles: the numeric part of the frequency table is range-partitioned on
  (column, value) and written with its partition id to the shared scratch
  folder; per-partition counts (one row per
  partition and column) locate each wanted rank, and only the partitions that
  hold a wanted rank are read again.  No task ever holds all the values of
  a column, unlike a global ``percentile``.  The same table gives the numeric
  columns' exact distinct counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import types as ty
from ..functions.literals import literal_rows
from ..functions.numeric import col, percent, round_half_up
from ..session import drop_scratch, scratch_path

GROUP = 24
QUANTILE_POINTS = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class ColumnSpec:
    ordinal: int
    name: str
    dtype: T.DataType
    type_name: str
    stat_class: str
    category: str

    @property
    def groupable(self) -> bool:
        return ty.is_groupable(self.dtype)


def column_specs(df: DataFrame) -> list[ColumnSpec]:
    out = []
    for i, f in enumerate(df.schema.fields, start=1):
        out.append(
            ColumnSpec(i, f.name, f.dataType, ty.type_name(f.dataType), ty.stat_class(f.dataType), ty.category(f.dataType))
        )
    return out


def _groups(items: list, n: int = GROUP) -> list[list]:
    return [items[i : i + n] for i in range(0, len(items), n)]


# A group of fixed-width aggregates stays under Spark's limit of 100
# aggregation-buffer fields for whole-stage code generation.  The budget and
# ``GROUP`` change the plan, never a result.
FIELD_BUDGET = 96


def _fact_groups(specs: list[ColumnSpec]) -> list[list[ColumnSpec]]:
    out, cur, used = [], [], 1
    for s in specs:
        cost = 8 if s.stat_class == "numeric" else 3
        if cur and used + cost > FIELD_BUDGET:
            out.append(cur)
            cur, used = [], 1
        cur.append(s)
        used += cost
    if cur:
        out.append(cur)
    return out


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def text_of(c, dt: T.DataType):
    """A value as text; booleans print ``True`` / ``False`` like the reference."""
    if isinstance(dt, T.BooleanType):
        return F.when(c.isNull(), F.lit(None).cast("string")).when(c, F.lit("True")).otherwise(F.lit("False"))
    return c.cast("string")


# ----------------------------------------------------------------------- schema
def schema_info(df: DataFrame) -> DataFrame:
    """One row per column: ordinal, column_name, dtype, nullable, category."""
    rows = [(s.ordinal, s.name, s.type_name, bool(f.nullable), s.category) for s, f in zip(column_specs(df), df.schema.fields)]
    schema = "ordinal int, column_name string, dtype string, nullable boolean, category string"
    return literal_rows(_spark(df), rows, schema)


def schema_for_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """``schema_info`` of many tables as one frame of literals, with ``table_name`` first."""
    rows = [
        (name, s.ordinal, s.name, s.type_name, bool(f.nullable), s.category)
        for name, df in tables.items()
        for s, f in zip(column_specs(df), df.schema.fields)
    ]
    schema = "table_name string, ordinal int, column_name string, dtype string, nullable boolean, category string"
    return literal_rows(_spark(next(iter(tables.values()))), rows, schema)


def _specs_frame(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    rows = [(s.ordinal, s.name, s.type_name, s.stat_class, s.category) for s in specs]
    return literal_rows(_spark(df), rows, "ordinal int, column_name string, dtype string, stat_class string, category string")


# ------------------------------------------------------------------------ facts
_FACT_FIELDS = [
    ("ordinal", "int"),
    ("rows", "bigint"),
    ("non_null", "bigint"),
    ("mean", "double"),
    ("std", "double"),
    ("min_num", "double"),
    ("max_num", "double"),
    ("min_text", "string"),
    ("max_text", "string"),
    ("approx_unique", "bigint"),
    ("q25", "double"),
    ("median", "double"),
    ("q75", "double"),
]


def _null(t: str):
    return F.lit(None).cast(t)


def _fact_row(fields: dict):
    return F.struct(*[fields.get(n, _null(t)).cast(t).alias(n) for n, t in _FACT_FIELDS])


def _fixed_facts(df: DataFrame, group: list[ColumnSpec]) -> DataFrame:
    """Counts, moments and numeric or temporal extremes: fixed-width, in generated code."""
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for s in group:
        c, k = col(s.name), s.ordinal
        aggs.append(F.count(c).alias(f"nn{k}"))
        fields = {"ordinal": F.lit(k), "rows": F.col("_rows"), "non_null": F.col(f"nn{k}")}
        lo, hi = F.col(f"min{k}"), F.col(f"max{k}")
        if s.stat_class in ("numeric", "temporal"):
            aggs += [F.min(c).alias(f"min{k}"), F.max(c).alias(f"max{k}")]
            fields |= {"min_text": lo.cast("string"), "max_text": hi.cast("string")}
        if s.stat_class == "numeric":
            d = c.cast("double")
            aggs += [F.avg(d).alias(f"mean{k}"), F.stddev_samp(d).alias(f"std{k}")]
            fields |= {"mean": F.col(f"mean{k}"), "std": F.col(f"std{k}"), "min_num": lo.cast("double"), "max_num": hi.cast("double")}
        rows.append(_fact_row(fields))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def _text_facts(df: DataFrame, group: list[ColumnSpec]) -> DataFrame:
    """Extremes of text, booleans and binaries, which Spark aggregates outside generated code."""
    aggs = [f(col(s.name)).alias(f"{n}{s.ordinal}") for s in group for n, f in (("min", F.min), ("max", F.max))]
    rows = [
        _fact_row({"ordinal": F.lit(s.ordinal), **{f"{n}_text": text_of(F.col(f"{n}{s.ordinal}"), s.dtype) for n in ("min", "max")}})
        for s in group
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def _sketch_facts(df: DataFrame, group: list[ColumnSpec], accuracy: int) -> DataFrame:
    """Approximate distinct counts and quartiles."""
    aggs, rows = [], []
    for s in group:
        c, k = col(s.name), s.ordinal
        aggs.append(F.approx_count_distinct(c if s.groupable else F.to_json(c)).alias(f"au{k}"))
        fields = {"ordinal": F.lit(k), "approx_unique": F.col(f"au{k}")}
        if s.stat_class == "numeric":
            aggs.append(F.percentile_approx(c.cast("double"), list(QUANTILE_POINTS), accuracy).alias(f"pq{k}"))
            fields |= {n: F.col(f"pq{k}")[i] for i, n in enumerate(("q25", "median", "q75"))}
        rows.append(_fact_row(fields))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def column_facts(
    df: DataFrame, approx: bool = False, accuracy: int = 10000, specs: list[ColumnSpec] | None = None, text_extremes: bool = False
) -> DataFrame:
    """Per-column counts, moments and extremes; long form, one row per column.

    With ``approx`` also approximate distinct counts and quartiles, with
    ``text_extremes`` min and max of text columns; both are aggregates of
    their own, so the fixed-width ones stay in generated code.  Only the
    columns of ``specs`` (default: all) are read.  No column, no row.
    """
    specs = specs if specs is not None else column_specs(df)
    if not specs:
        return literal_rows(_spark(df), [], ", ".join(f"{n} {t}" for n, t in _FACT_FIELDS))
    parts = [_fixed_facts(df, g) for g in _fact_groups(specs)]
    texts = [s for s in specs if s.stat_class == "scalar" and ty.is_orderable(s.dtype)] if text_extremes else []
    parts += [_text_facts(df, g) for g in _groups(texts)]
    if approx:
        parts += [_sketch_facts(df, g, accuracy) for g in _groups(specs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if not texts and not approx:
        return out
    # At most three rows for each column, each with its own fields.
    return out.groupBy("ordinal").agg(*[F.max(n).alias(n) for n, _ in _FACT_FIELDS if n != "ordinal"])


# ------------------------------------------------------------------ frequencies
_SLOTS = [("vi", "bigint"), ("vf", "double"), ("vs", "string"), ("vb", "binary")]


def _slot_of(s: ColumnSpec):
    """The slot a column's values go to, and the value expression.

    Integral numbers keep their exact value in ``vi``; floating numbers go to
    ``vf``; zoned timestamps to ``vi`` as instants (two instants may share
    their local text); decimals to ``vs`` as exact text (same scale within a column);
    booleans, text and date / time values to ``vs`` as text (ISO text orders
    like the values); binary to ``vb``.
    """
    c, dt = col(s.name), s.dtype
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "vi", c.cast("bigint")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "vf", c.cast("double")
    if isinstance(dt, T.TimestampType):
        return "vi", F.unix_micros(c)
    if isinstance(dt, T.BinaryType):
        return "vb", c
    return "vs", text_of(c, dt)


def value_frequencies(df: DataFrame, specs: list[ColumnSpec] | None = None) -> DataFrame:
    """Narrow long table ``(ord, vi, vf, vs, vb, freq)``: one row per distinct non-NULL value.

    Columns are unpivoted by value kind into ``(ord, value)`` rows (one scan
    per kind, reading only those columns), NULLs are dropped before the
    shuffle, and each kind is grouped on its own two-column key, which keeps
    Spark's fixed-width fast hash map for numbers.  Dates and local timestamps
    are grouped as they are and only their distinct values made text.  The grouping combines
    map-side, so a hot value costs one row per task in the shuffle.  Nested,
    interval and map columns are left out (see ``_counts_only``).
    """
    specs = [s for s in (specs or column_specs(df)) if s.groupable and s.stat_class != "counts"]
    spark = _spark(df)
    by_kind: dict[tuple[str, str], list] = {}
    for s in specs:
        slot, value = _slot_of(s)
        late = isinstance(s.dtype, (T.DateType, T.TimestampNTZType))  # text of one value, and of no other, whatever the session
        kind = (slot, s.dtype.typeName() if late else "")
        by_kind.setdefault(kind, []).append(F.struct(F.lit(s.ordinal).alias("ord"), (col(s.name) if late else value).alias("v")))
    parts = []
    for slot, late in sorted(by_kind, key=lambda k: ([n for n, _ in _SLOTS].index(k[0]), k[1])):
        value = F.col("v").cast("string") if late else F.col("v")
        grouped = (
            df.select(F.inline(F.array(*by_kind[slot, late])))
            .where(F.col("v").isNotNull())
            .groupBy("ord", "v")
            .agg(F.count(F.lit(1)).alias("freq"))
        )
        parts.append(
            grouped.select(
                "ord",
                *[(value if n == slot else _null(nt)).alias(n) for n, nt in _SLOTS],
                "freq",
            )
        )
    if not parts:
        return literal_rows(spark, [], "ord int, vi bigint, vf double, vs string, vb binary, freq bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_and_top(freq: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Exact distinct count, top value (as text) and its frequency per column.

    The top value excludes NULL; a tie on frequency goes to the larger value.
    A second, tiny aggregate keyed by column.
    """
    want = [s.ordinal for s in specs]
    zoned = [s.ordinal for s in specs if isinstance(s.dtype, T.TimestampType)]
    number = F.col("t.vi").cast("string")
    if zoned:
        number = F.when(F.col("ord").isin(zoned), F.timestamp_micros("t.vi").cast("string")).otherwise(number)
    best = F.max(F.struct(F.col("freq").alias("f"), "vi", "vf", "vs", "vb"))
    top_text = F.coalesce(
        F.col("t.vs"), number, F.col("t.vf").cast("string"), F.col("t.vb").cast("string")
    )
    return (
        freq.where(F.col("ord").isin(want))
        .groupBy("ord")
        .agg(F.count(F.lit(1)).alias("unique_count"), best.alias("t"))
        .select(
            F.col("ord").alias("ordinal"),
            F.col("unique_count").cast("bigint").alias("unique_count"),
            top_text.alias("top_value"),
            F.col("t.f").cast("bigint").alias("top_frequency"),
        )
    )


# -------------------------------------------------------------------- quantiles
def numeric_long(freq: DataFrame) -> DataFrame:
    """``(ord, v double, freq)`` rows of numeric values from the frequency table.

    Values were grouped by their exact value, so the row count per column
    is its exact distinct count.
    """
    v = F.coalesce(F.col("vi").cast("double"), F.col("vf"), F.col("vs").cast("double"))
    return freq.select("ord", v.alias("v"), "freq")


@dataclass
class NumericSummary:
    """Exact distinct counts and interpolated quantiles per numeric column."""

    distinct: dict[int, int]
    quantiles: dict[int, list[float | None]]


def exact_quantiles(
    df: DataFrame, specs: list[ColumnSpec], points: tuple[float, ...] = QUANTILE_POINTS
) -> NumericSummary:
    """Interpolated quantiles (``QUANTILE_CONT``) and distinct counts of the numeric columns.

    The narrow frequency table is range-partitioned on (column, value) and
    written, with its partition id, to the shared scratch folder (so the ids
    stay fixed even if an executor is lost).  Counts per (partition, column) - one row
    each - locate every wanted rank; only the partitions holding one are
    read again, and a running sum inside them picks the values.  Just a
    handful of numbers per column reach the driver.
    """
    specs = [s for s in specs if s.stat_class == "numeric"]
    ords = [s.ordinal for s in specs]
    out = NumericSummary({k: 0 for k in ords}, {k: [None] * len(points) for k in ords})
    if not specs:
        return out
    long = numeric_long(value_frequencies(df, specs))
    # The range partitioner samples its input in a job of its own; keeping
    # the frequency rows for that job and the shuffle avoids aggregating
    # twice (a lost executor only means recomputing them from lineage).
    # Not sorted here: only the few partitions holding a wanted rank are
    # sorted later, by the window that picks the values.
    # The range partition id is stored as a column of a table written to the
    # shared scratch folder: reading it back may pack files differently, but
    # the ids (and the ranks they locate) stay fixed, and a filter on ``pid``
    # skips whole files.
    spark = _spark(long)
    path = scratch_path(spark, "ranked-values")
    long = long.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        long.repartitionByRange("ord", "v").withColumn("pid", F.spark_partition_id()).write.parquet(path)
        return _select_ranks(spark.read.parquet(path), out, points)
    finally:
        long.unpersist()
        drop_scratch(spark, path)


def _select_ranks(ranged: DataFrame, out: NumericSummary, points: tuple[float, ...]) -> NumericSummary:
    """Locate and read the values at the wanted ranks of a range-partitioned table."""
    # One row per (partition, column): bounded by partitions + columns.
    sizes = ranged.groupBy("pid", "ord").agg(F.sum("freq").alias("n"), F.count(F.lit(1)).alias("d")).collect()
    by_col: dict[int, list[tuple[int, int]]] = {}
    for r in sizes:
        by_col.setdefault(r.ord, []).append((r.pid, r.n))
        out.distinct[r.ord] = out.distinct.get(r.ord, 0) + r.d
    wanted = []  # (pid, ord, local_rank, rank)
    plan = {}  # ord -> list of (lo_rank, hi_rank, frac)
    for k, parts in by_col.items():
        parts.sort()
        total = sum(n for _, n in parts)
        if total == 0:
            continue
        plan[k] = []
        ranks = set()
        for p in points:
            h = (total - 1) * p
            lo, hi = math.floor(h), math.ceil(h)
            plan[k].append((lo, hi, h - lo))
            ranks.update((lo, hi))
        for rank in sorted(ranks):
            before = 0
            for pid, n in parts:
                if before <= rank < before + n:
                    wanted.append((pid, k, rank - before, rank))
                    break
                before += n
    if not wanted:
        return out
    spark = _spark(ranged)
    targets = literal_rows(spark, wanted, "pid int, ord int, local_rank bigint, rank bigint")
    keys = targets.select("pid", "ord").distinct()
    w = Window.partitionBy("pid", "ord").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (
        ranged.where(F.col("pid").isin(sorted({w[0] for w in wanted})))
        .join(F.broadcast(keys), ["pid", "ord"], "left_semi")
        .withColumn("cum", F.sum("freq").over(w))
        .join(F.broadcast(targets), ["pid", "ord"])
        .where((F.col("cum") - F.col("freq") <= F.col("local_rank")) & (F.col("local_rank") < F.col("cum")))
        .select("ord", "rank", "v")
        .collect()  # at most two values per column and point
    )
    at = {(r.ord, r.rank): r.v for r in hits}
    for k, specs in plan.items():
        vals = []
        for lo, hi, frac in specs:
            a, b = at.get((k, lo)), at.get((k, hi))
            if a is None or b is None:
                vals.append(None)
            elif lo == hi:
                vals.append(a)
            else:
                vals.append(a + (b - a) * frac)
        out.quantiles[k] = vals
    return out


def _quantile_frame(spark: SparkSession, q: dict[int, list[float | None]]) -> DataFrame:
    rows = [(k, v[0], v[1], v[2]) for k, v in sorted(q.items())]
    return literal_rows(spark, rows, "ordinal int, q25 double, median double, q75 double")


# ------------------------------------------------------------------- statistics
@dataclass
class Profile:
    """Lazily joined per-column results of one table."""

    specs: list[ColumnSpec]
    specs_frame: DataFrame
    facts: DataFrame
    uniques: DataFrame
    quantiles: DataFrame


def _counts_only(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Distinct counts of nested and interval columns (maps and variants via their JSON text)."""
    targets = [(col(s.name) if s.groupable else F.to_json(col(s.name))) for s in specs]
    return df.agg(*[F.count_distinct(t).alias(f"u{s.ordinal}") for s, t in zip(specs, targets)]).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(s.ordinal).alias("ordinal"),
                        F.col(f"u{s.ordinal}").cast("bigint").alias("unique_count"),
                        _null("string").alias("top_value"),
                        _null("bigint").alias("top_frequency"),
                    )
                    for s in specs
                ]
            )
        )
    )


def build_profile(df: DataFrame, approx: bool = False, facts: DataFrame | None = None) -> Profile:
    """Plan (and, for numeric columns, run) the per-column jobs of one table.

    ``facts`` are those of ``column_facts`` where they are known already.

    Exact mode: non-numeric columns get distinct counts and top values from
    a lazy aggregate over their narrow frequency table; numeric columns go
    through one range-partitioned frequency table that yields exact distinct
    counts and quantiles together (run here, a few small jobs).  Approximate
    mode: sketches in the facts aggregate, plus exact top values.
    """
    specs = column_specs(df)
    spark = _spark(df)
    specs_frame = _specs_frame(df, specs)
    facts = facts if facts is not None else column_facts(df, approx=approx)
    top_specs = [s for s in specs if s.stat_class in ("scalar", "temporal")]
    empty = literal_rows(spark, [], "ordinal int, unique_count bigint, top_value string, top_frequency bigint")
    if approx:
        top = distinct_and_top(value_frequencies(df, top_specs), top_specs).drop("unique_count") if top_specs else None
        uniques = facts.select("ordinal", F.col("approx_unique").alias("unique_count"))
        if top is not None:
            uniques = uniques.join(F.broadcast(top), "ordinal", "left")
        else:
            uniques = uniques.withColumn("top_value", _null("string")).withColumn("top_frequency", _null("bigint"))
        return Profile(specs, specs_frame, facts, uniques, facts.select("ordinal", "q25", "median", "q75"))
    parts = []
    if top_specs:
        parts.append(distinct_and_top(value_frequencies(df, top_specs), top_specs))
    counts_only = [s for s in specs if s.stat_class == "counts"]
    if counts_only:
        parts.append(_counts_only(df, counts_only))
    numeric = [s for s in specs if s.stat_class == "numeric"]
    summary = exact_quantiles(df, numeric) if numeric else NumericSummary({}, {})
    if numeric:
        parts.append(
            literal_rows(spark, 
                [(k, n, None, None) for k, n in sorted(summary.distinct.items())],
                "ordinal int, unique_count bigint, top_value string, top_frequency bigint",
            )
        )
    uniques = empty
    for p in parts:
        uniques = uniques.unionByName(p)
    return Profile(specs, specs_frame, facts, uniques, _quantile_frame(spark, summary.quantiles))


def statistics(df: DataFrame, approx: bool = False, profile: Profile | None = None) -> DataFrame:
    """Statistical summary, one row per column in table order.

    ``ordinal, column_name, dtype, count, unique_count, mean, std, min_num,
    max_num, min_text, max_text, median, q25, q75, top_value, top_frequency``.
    ``count`` counts all rows (NULLs included), ``unique_count`` ignores
    NULLs.  Numeric columns get moments and quartiles, date and time columns
    a top value and min / max as text, other scalar columns a top value;
    nested and interval columns only the two counts.
    """
    p = profile or build_profile(df, approx=approx)
    j = (
        p.specs_frame.join(F.broadcast(p.facts.drop("q25", "median", "q75", "approx_unique")), "ordinal")
        .join(F.broadcast(p.uniques), "ordinal", "left")
        .join(F.broadcast(p.quantiles), "ordinal", "left")
    )
    num = F.col("stat_class") == "numeric"
    tmp = F.col("stat_class") == "temporal"
    top = F.col("stat_class").isin("scalar", "temporal")
    return j.select(
        "ordinal",
        "column_name",
        F.upper("dtype").alias("dtype"),
        F.col("rows").alias("count"),
        "unique_count",
        *[F.when(num, F.col(c)).alias(c) for c in ("mean", "std", "min_num", "max_num")],
        *[F.when(tmp, F.col(c)).alias(c) for c in ("min_text", "max_text")],
        *[F.when(num, F.col(c)).alias(c) for c in ("median", "q25", "q75")],
        F.when(top, F.col("top_value")).alias("top_value"),
        F.when(top, F.col("top_frequency")).alias("top_frequency"),
    ).orderBy("ordinal")


# ------------------------------------------------------------------------ nulls
def null_columns(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Per column: null_count, null_percentage (2 decimals), non_null_count."""
    specs = column_specs(df)
    facts = facts if facts is not None else _null_facts(df)
    return (
        _specs_frame(df, specs)
        .join(F.broadcast(facts), "ordinal")
        .select(
            "ordinal",
            "column_name",
            "dtype",
            (F.col("rows") - F.col("non_null")).alias("null_count"),
            percent(F.col("rows") - F.col("non_null"), F.col("rows"), 2).alias("null_percentage"),
            F.col("non_null").alias("non_null_count"),
            F.col("rows").alias("row_count"),
        )
        .orderBy("ordinal")
    )


def _null_facts(df: DataFrame) -> DataFrame:
    """Row and non-null counts only: one light aggregate per column group."""
    specs = column_specs(df)
    if not specs:
        return literal_rows(_spark(df), [], "ordinal int, rows bigint, non_null bigint")
    parts = []
    for group in _groups(specs, 64):
        aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(col(s.name)).alias(f"nn{s.ordinal}") for s in group]
        structs = [
            F.struct(F.lit(s.ordinal).alias("ordinal"), F.col("_rows").alias("rows"), F.col(f"nn{s.ordinal}").alias("non_null"))
            for s in group
        ]
        parts.append(df.agg(*aggs).select(F.inline(F.array(*structs))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_totals(df: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """total_cells = rows x columns, total_nulls, total_null_percentage (2 decimals)."""
    cols = columns if columns is not None else null_columns(df)
    n = len(df.columns)
    agg = cols.agg(
        F.coalesce(F.max("row_count"), F.lit(0)).cast("bigint").alias("_rows"),
        F.coalesce(F.sum("null_count"), F.lit(0)).cast("bigint").alias("total_nulls"),
    )
    cells = F.col("_rows") * F.lit(n)
    return agg.select(
        cells.cast("bigint").alias("total_cells"),
        "total_nulls",
        percent(F.col("total_nulls"), cells, 2).alias("total_null_percentage"),
    )


def completeness(df: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Null % and completeness % with one decimal, and a has_nulls flag."""
    cols = columns if columns is not None else null_columns(df)
    raw = F.when(F.col("row_count") > 0, F.col("null_count").cast("double") / F.col("row_count") * 100.0).otherwise(0.0)
    return cols.select(
        "ordinal",
        "column_name",
        "dtype",
        "null_count",
        round_half_up(raw, 1).alias("null_pct"),
        round_half_up(F.lit(100.0) - raw, 1).alias("complete_pct"),
        (F.col("null_count") > 0).alias("has_nulls"),
    ).orderBy("ordinal")


def null_severity(df: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Columns ranked by null % (descending, table order on ties) with severity.

    Column severity: high above 20 %, medium above 5 %, else low.  The table
    is flagged when its total null % exceeds 10; overall completeness is
    100 minus the total, one decimal.
    """
    cols = columns if columns is not None else null_columns(df)
    n = len(df.columns)
    # Windows over the column list (one row per column), not over the data.
    whole = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("null_percentage").desc(), F.col("ordinal")))
    cells = F.max("row_count").over(whole) * F.lit(n)
    total_pct = percent(F.sum("null_count").over(whole), cells, 2)
    sev = (
        F.when(F.col("null_percentage") > 20, "high").when(F.col("null_percentage") > 5, "medium").otherwise("low")
    )
    return (
        cols.select(
            "ordinal",
            "column_name",
            "null_count",
            "null_percentage",
            sev.alias("severity"),
            rank.alias("rank"),
            total_pct.alias("total_null_percentage"),
        )
        .withColumn("table_alert", F.col("total_null_percentage") > 10)
        .withColumn("overall_completeness", round_half_up(F.lit(100.0) - F.col("total_null_percentage"), 1))
        .orderBy("rank")
    )


# ------------------------------------------------------------------ cardinality
CARDINALITY_LABELS = {
    # fixed values: class labels of the reference's cardinality table
    "unique": "Unique (potential key)",
    "binary": "Binary",
    "low": "Low (categorical)",
    "high": "High (continuous)",
}


def cardinality(df: DataFrame, max_categories: int = 20, uniques: DataFrame | None = None) -> DataFrame:
    """Distinct count, uniqueness % (1 decimal) and class per column.

    The class is tested in this order: all values distinct (also 0 = 0 on an
    empty table), at most 2, at most ``max_categories``, else high.
    """
    specs = column_specs(df)
    u = uniques if uniques is not None else distinct_counts(df)
    uc, rc = F.col("unique_count"), F.col("count")
    cls = (
        F.when(uc == rc, "unique").when(uc <= 2, "binary").when(uc <= max_categories, "low").otherwise("high")
    )
    label = F.create_map(*[x for kv in CARDINALITY_LABELS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return (
        _specs_frame(df, specs)
        .join(F.broadcast(u.select("ordinal", "count", "unique_count")), "ordinal")
        .select(
            "ordinal",
            "column_name",
            "unique_count",
            round_half_up(F.when(rc > 0, uc.cast("double") / rc * 100.0).otherwise(0.0), 1).alias("uniqueness_pct"),
            cls.alias("cardinality"),
            label[cls].alias("label"),
        )
        .orderBy("ordinal")
    )


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """``count`` (all rows) and ``unique_count`` (NULLs ignored) per column.

    Exact counts come from the narrow frequency table (one unpivot-and-group
    job for all columns, see ``value_frequencies``); ``approx`` uses
    HyperLogLog++ sketches in the facts aggregate.
    """
    specs = column_specs(df)
    spark = _spark(df)
    names = _specs_frame(df, specs).select("ordinal", "column_name")
    rows = df.agg(F.count(F.lit(1)).alias("count"))
    if approx:
        u = column_facts(df, approx=True).select("ordinal", F.col("approx_unique").alias("unique_count"))
    else:
        grouped = [s for s in specs if s.stat_class != "counts"]
        parts = []
        if grouped:
            freq = value_frequencies(df, grouped)
            found = freq.groupBy(F.col("ord").alias("ordinal")).agg(F.count(F.lit(1)).alias("unique_count"))
            # columns with only NULLs have no row in the frequency table
            zeros = literal_rows(spark, [(s.ordinal, 0) for s in grouped], "ordinal int, unique_count bigint")
            parts.append(zeros.unionByName(found).groupBy("ordinal").agg(F.max("unique_count").alias("unique_count")))
        nested = [s for s in specs if s.stat_class == "counts"]
        if nested:
            parts.append(_counts_only(df, nested).select("ordinal", "unique_count"))
        u = literal_rows(spark, [], "ordinal int, unique_count bigint")
        for p in parts:
            u = u.unionByName(p)
    total = rows.select(F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("bigint").alias("unique_count"), "count")
    whole = Window.partitionBy()
    # one row per column plus one total row: the window spans the column list
    return (
        u.withColumn("count", F.lit(None).cast("bigint"))
        .unionByName(total)
        .withColumn("count", F.max("count").over(whole))
        .where(F.col("ordinal").isNotNull())
        .join(F.broadcast(names), "ordinal")
        .select("ordinal", "column_name", "count", F.col("unique_count").cast("bigint").alias("unique_count"))
        .orderBy("ordinal")
    )


def quantiles(df: DataFrame, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """``ordinal, column_name, q25, median, q75`` of the numeric columns.

    Exact by default (distributed rank selection, see ``exact_quantiles``);
    ``approx`` uses ``percentile_approx`` sketches in one aggregate.
    """
    specs = [s for s in column_specs(df) if s.stat_class == "numeric"]
    spark = _spark(df)
    names = _specs_frame(df, specs).select("ordinal", "column_name")
    if not specs:
        return literal_rows(spark, [], "ordinal int, column_name string, q25 double, median double, q75 double")
    if approx:
        qf = column_facts(df, approx=True, accuracy=accuracy, specs=specs).select("ordinal", "q25", "median", "q75")
    else:
        qf = _quantile_frame(spark, exact_quantiles(df, specs).quantiles)
    return names.join(F.broadcast(qf), "ordinal").select("ordinal", "column_name", "q25", "median", "q75").orderBy("ordinal")


def numeric_stats(df: DataFrame) -> DataFrame:
    """``ordinal, column_name, mean, std, min_num, max_num`` of the numeric columns."""
    specs = column_specs(df)
    return (
        _specs_frame(df, specs)
        .join(F.broadcast(column_facts(df, specs=[s for s in specs if s.stat_class == "numeric"])), "ordinal")
        .select("ordinal", "column_name", "mean", "std", "min_num", "max_num")
        .orderBy("ordinal")
    )


def temporal_range(df: DataFrame) -> DataFrame:
    """``ordinal, column_name, min_text, max_text`` of the date and time columns."""
    specs = column_specs(df)
    return (
        _specs_frame(df, specs)
        .join(F.broadcast(column_facts(df, specs=[s for s in specs if s.stat_class == "temporal"])), "ordinal")
        .select("ordinal", "column_name", "min_text", "max_text")
        .orderBy("ordinal")
    )
