"""Reports: the full explorer report and the service report as JSON lines.

``full_report`` returns the explorer's sections as DataFrames (overview,
schema, sample, summary, nulls, cardinality, correlations) for one table or
a table set.  ``report_sections`` builds the service report - ordered
sections ``overview, schema, sample, statistics, nulls, complete`` (or one
``error``) - as rows ``(seq, type, data, message)`` where ``data`` is JSON
text; ``write_report`` stores it as JSON lines, section by section, and
``read_report`` parses it back into typed sections, skipping lines that do not
parse.  Sections can be read while later ones run.

Every section is built from aggregates whose size is bounded by the number
of columns (or the sample size), so the JSON assembly never collects data.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import literal_rows
from ..functions.numeric import col, percent
from ..operators import correlate, overview, profile, summarize
from ..session import drop_scratch, scratch_path
from ..sources.files import Source

# Section names, message and sample sizes of the report's contract.
SECTION_ORDER = ["overview", "schema", "sample", "statistics", "nulls", "complete"]
COMPLETE_MESSAGE = "Analysis complete"
SERVICE_SAMPLE_ROWS = 10
EXPLORER_SAMPLE_ROWS = 5

_SECTION_SCHEMA = "seq int, type string, data string, message string"


# ------------------------------------------------------------------ explorer
def full_report(
    tables: dict[str, Source] | Source, table: str | None = None, sample_rows: int = EXPLORER_SAMPLE_ROWS,
    max_categories: int = 20, order_by: dict[str, list[str]] | None = None,
) -> dict[str, dict[str, DataFrame]]:
    """Sections per table: overview, schema, sample, summary, nulls, cardinality, correlations.

    ``order_by`` names the columns that order a table's sample; its first
    column does otherwise, so a report can be repeated.
    """
    if isinstance(tables, Source):
        tables = {tables.name: tables}
    names = [table] if table else sorted(tables)
    out = {}
    for name in names:
        src = tables[name]
        df = src.df
        nulls = profile.null_columns(df)
        out[name] = {
            "overview": overview.overview(src),
            "schema": profile.schema_info(df),
            "sample": overview.sample_rows(df, sample_rows, (order_by or {}).get(name, df.columns[:1])),
            "summary": summarize.summarize(df),
            "nulls": profile.completeness(df, nulls),
            "cardinality": profile.cardinality(df, max_categories),
            "correlations": correlate.correlations(df),
        }
    return out


def full_report_table(report: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """All sections as one long frame ``(table_name, seq, section, row)`` with JSON rows."""
    parts = []
    for table_name, sections in report.items():
        for seq, (section, df) in enumerate(sections.items(), start=1):
            parts.append(
                df.select(
                    F.lit(table_name).alias("table_name"),
                    F.lit(seq).alias("seq"),
                    F.lit(section).alias("section"),
                    F.to_json(F.struct(*[col(c) for c in df.columns])).alias("row"),
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------- service
def _one(df: DataFrame, seq: int, kind: str, data) -> DataFrame:
    return df.select(F.lit(seq).alias("seq"), F.lit(kind).alias("type"), data.alias("data"), F.lit(None).cast("string").alias("message"))


def _json_cell(c, dt: T.DataType):
    """A sample cell as JSON: numbers, text and booleans as they are, others as text."""
    keep = isinstance(dt, (T.NumericType, T.StringType, T.BooleanType)) and not isinstance(dt, T.DecimalType)
    j = F.to_json(F.array(c if keep else c.cast("string")))
    return j.substr(F.lit(2), F.length(j) - 2)


def report_sections(src: Source, sample_rows: int = SERVICE_SAMPLE_ROWS, order_by: list[str] | None = None) -> DataFrame:
    """The service report of one source as six rows ``(seq, type, data, message)``.

    Planning the statistics runs jobs (see ``profile.build_profile``).
    """
    prof = profile.build_profile(src.df)
    out = _overview_section(src)
    for p in (
        _schema_section(src.df),
        _sample_section(src.df, sample_rows, order_by),
        _statistics_section(src.df, prof),
        # the statistics' facts already hold row and non-NULL counts: no extra scan
        _nulls_section(src.df, prof.facts.select("ordinal", "rows", "non_null")),
        _complete_section(src.df.sparkSession),
    ):
        out = out.unionByName(p)
    return out


def _sections_apart(src: Source, sample_rows: int, order_by: list[str] | None, scratch: list[str]):
    """The sections one by one, each planned only when it is asked for.

    Statistics and NULLs share one table of facts, whose path joins ``scratch``.
    """
    spark = src.df.sparkSession

    def facts() -> DataFrame:
        if not scratch:
            path = scratch_path(spark, "report-facts")
            scratch.append(path)
            profile.column_facts(src.df).write.parquet(path)
        return spark.read.parquet(scratch[0])

    yield "overview", lambda: _overview_section(src)
    yield "schema", lambda: _schema_section(src.df)
    yield "sample", lambda: _sample_section(src.df, sample_rows, order_by)
    yield "statistics", lambda: _statistics_section(src.df, profile.build_profile(src.df, facts=facts()))
    yield "nulls", lambda: _nulls_section(src.df, facts().select("ordinal", "rows", "non_null"))
    yield "complete", lambda: _complete_section(spark)


def _overview_section(src: Source) -> DataFrame:
    ov = overview.overview(src)
    return _one(ov, 1, "overview", F.to_json(F.struct(*ov.columns)))


def _schema_section(df: DataFrame) -> DataFrame:
    sch = profile.schema_info(df)
    return _one(
        sch.agg(F.sort_array(F.collect_list(F.struct("ordinal", F.col("column_name").alias("name"), "dtype", "nullable"))).alias("c")),
        2,
        "schema",
        F.to_json(F.struct(F.transform("c", lambda x: x.dropFields("ordinal")).alias("columns"))),
    )


def _sample_section(df: DataFrame, sample_rows: int, order_by: list[str] | None) -> DataFrame:
    sample = overview.sample_rows(df, sample_rows, order_by)
    key = [col(c) for c in order_by] if order_by else [F.monotonically_increasing_id()]
    cells = [_json_cell(col(f.name), f.dataType) for f in df.schema.fields]
    row_json = F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")) if cells else F.lit("[]")
    numbered = sample.select(F.row_number().over(Window.orderBy(*key)).alias("i"), row_json.alias("r"))
    columns_json = F.to_json(F.array(*[F.lit(c) for c in df.columns])) if df.columns else F.lit("[]")
    return _one(
        numbered.agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("rows")),
        3,
        "sample",
        F.concat(
            F.lit('{"columns":'),
            columns_json,
            F.lit(',"rows":['),
            F.coalesce(F.array_join(F.transform("rows", lambda x: x["r"]), ","), F.lit("")),
            F.lit("]}"),
        ),
    )


def _statistics_section(df: DataFrame, prof: profile.Profile) -> DataFrame:
    stats = profile.statistics(df, profile=prof)
    stat_fields = [c for c in stats.columns if c != "ordinal"]
    return _one(
        stats.agg(F.sort_array(F.collect_list(F.struct("ordinal", *stat_fields))).alias("c")),
        4,
        "statistics",
        F.to_json(F.struct(F.transform("c", lambda x: x.dropFields("ordinal")).alias("columns"))),
    )


def _nulls_section(df: DataFrame, facts: DataFrame | None) -> DataFrame:
    nulls = profile.null_columns(df, facts=facts)
    n = len(df.columns)
    cells = F.coalesce(F.max("row_count"), F.lit(0)) * F.lit(n)
    total_nulls = F.coalesce(F.sum("null_count"), F.lit(0))
    null_agg = nulls.agg(
        cells.cast("bigint").alias("total_cells"),
        total_nulls.cast("bigint").alias("total_nulls"),
        F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "null_count", "null_percentage", "non_null_count"))).alias("c"),
    ).withColumn("total_null_percentage", percent(F.col("total_nulls"), F.col("total_cells"), 2))
    return _one(
        null_agg,
        5,
        "nulls",
        F.to_json(
            F.struct(
                "total_cells",
                "total_nulls",
                "total_null_percentage",
                F.transform("c", lambda x: x.dropFields("ordinal")).alias("columns"),
            )
        ),
    )

def _complete_section(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, [(6, "complete", None, COMPLETE_MESSAGE)], _SECTION_SCHEMA)


def error_section(spark: SparkSession, message: str, seq: int = 1) -> DataFrame:
    return literal_rows(spark, [(seq, "error", None, message)], _SECTION_SCHEMA)


# Files of a report folder besides its sections; readers pass over their names.
_STAGING, _MANIFEST = "_staging", "_manifest.json"


class ReportFolder:
    """A report that grows by whole sections.

    A section is written below ``_staging`` and then renamed into the folder,
    so a reader sees all of it or nothing; the manifest, renamed into place
    last, says that no section will follow.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.done: list[dict] = []

    def at(self, *parts: str):
        return self.hadoop.Path("/".join((self.path, *parts)))

    def exists(self) -> bool:
        return self.fs.exists(self.at())

    def start(self) -> None:
        self.fs.mkdirs(self.at(_STAGING))

    def add(self, seq: int, kind: str, section: DataFrame) -> None:
        """Commit one section."""
        staged = f"{_STAGING}/{seq}"
        section.coalesce(1).write.json(f"{self.path}/{staged}")
        part = [s.getPath() for s in self.fs.listStatus(self.at(staged)) if s.getPath().getName().startswith("part-")]
        self._move(part[0], self.at(f"{seq:02d}-{kind}.json"))
        self.done.append({"seq": seq, "type": kind})

    def finish(self, status: str) -> None:
        """Write the manifest; nothing is left in the staging folder."""
        staged = self.at(_STAGING, _MANIFEST)
        out = self.fs.create(staged)
        out.write(bytearray(json.dumps({"status": status, "sections": self.done}).encode()))
        out.close()
        self._move(staged, self.at(_MANIFEST))
        self.fs.delete(self.at(_STAGING), True)

    def _move(self, source, target) -> None:
        if not self.fs.rename(source, target):
            raise OSError(f"cannot move {source} to {target}")


def report_status(spark: SparkSession, path: str) -> str:
    """``running`` until the manifest is there, then ``complete`` or ``error``."""
    folder = ReportFolder(spark, path)
    if not folder.fs.exists(folder.at(_MANIFEST)):
        return "running"
    opened = folder.fs.open(folder.at(_MANIFEST))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))["status"]
    finally:
        opened.close()


def stream_report(src: Source, path: str, sample_rows: int = SERVICE_SAMPLE_ROWS, order_by: list[str] | None = None) -> Iterator[tuple[int, str]]:
    """Write the service report of ``src`` section by section; yields ``(seq, type)`` after each is there to be read.

    When a section fails, an ``error`` section takes its place, its cause is
    given as a warning and the report ends.  A folder that exists already is
    an error before anything is planned or written.
    """
    spark = src.df.sparkSession
    folder = ReportFolder(spark, path)
    if folder.exists():
        raise AnalysisException(f"[PATH_ALREADY_EXISTS] {path} exists already; a report is never overwritten")
    folder.start()
    status, scratch = "complete", []
    try:
        for seq, (kind, section) in enumerate(_sections_apart(src, sample_rows, order_by, scratch), start=1):
            try:
                folder.add(seq, kind, section())
            except Exception as exc:  # noqa: BLE001 - the report carries the error
                warnings.warn(f"section {kind!r} of the report {path} failed: {exc}", stacklevel=2)
                folder.fs.delete(folder.at(f"{_STAGING}/{seq}"), True)
                kind, status = "error", "error"
                folder.add(seq, kind, error_section(spark, str(exc), seq))
            yield seq, kind
            if status == "error":
                break
        folder.finish(status)
    finally:
        for made in scratch:
            drop_scratch(spark, made)


def write_report(src: Source, path: str, sample_rows: int = SERVICE_SAMPLE_ROWS, order_by: list[str] | None = None, replace: bool = False) -> str:
    """Write the service report of ``src`` as JSON lines and return the folder; see ``stream_report``.

    With ``replace`` an older report gives way to a complete one in one
    rename.  A run that fails leaves it as it is, byte for byte, and raises
    ``RuntimeError``; the failed report stays in the folder that this names.
    """
    spark = src.df.sparkSession
    if not replace or not ReportFolder(spark, path).exists():
        for _ in stream_report(src, path, sample_rows, order_by):
            pass
        return path
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex[:12]}"
    last = [kind for _, kind in stream_report(src, f"{beside}.new", sample_rows, order_by)][-1]
    if last == "error":
        raise RuntimeError(f"the report failed and {path} stays as it was; see {beside}.new")
    new, old = ReportFolder(spark, path), ReportFolder(spark, f"{beside}.old")
    new._move(new.at(), old.at())
    new._move(ReportFolder(spark, f"{beside}.new").at(), new.at())
    old.fs.delete(old.at(), True)
    return path


# Typed shapes of the sections, for reading a report back.
OVERVIEW_T = "row_count bigint, column_count int, file_name string, file_size_bytes bigint, file_type string"
SCHEMA_T = "columns array<struct<name: string, dtype: string, nullable: boolean>>"
SAMPLE_T = "columns array<string>, rows array<array<string>>"
STATISTICS_T = (
    "columns array<struct<column_name: string, dtype: string, count: bigint, unique_count: bigint, mean: double, "
    "std: double, min_num: double, max_num: double, min_text: string, max_text: string, median: double, q25: double, "
    "q75: double, top_value: string, top_frequency: bigint>>"
)
NULLS_T = (
    "total_cells bigint, total_nulls bigint, total_null_percentage double, columns array<struct<column_name: string, "
    "null_count: bigint, null_percentage: double, non_null_count: bigint>>"
)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Parse a JSON-lines report into typed sections; lines that do not parse are skipped."""
    raw = (
        spark.read.schema(_SECTION_SCHEMA + ", _corrupt string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    ok = raw.where(F.col("_corrupt").isNull() & F.col("type").isNotNull())
    t, d = F.col("type"), F.col("data")
    return ok.select(
        "seq",
        "type",
        "message",
        F.when(t == "overview", F.from_json(d, OVERVIEW_T)).alias("overview"),
        F.when(t == "schema", F.from_json(d, SCHEMA_T)).alias("schema"),
        F.when(t == "sample", F.from_json(d, SAMPLE_T)).alias("sample"),
        F.when(t == "statistics", F.from_json(d, STATISTICS_T)).alias("statistics"),
        F.when(t == "nulls", F.from_json(d, NULLS_T)).alias("nulls"),
    )


def section_for_tables(tables: dict[str, DataFrame], section) -> DataFrame:
    """``section(df)`` of every table in one frame, with a ``table_name`` column first."""
    if not tables:
        raise ValueError("the table set holds no tables")
    parts = [section(tables[n]).select(F.lit(n).alias("table_name"), "*") for n in sorted(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def statistics_for_tables(tables: dict[str, Source] | dict[str, DataFrame], approx: bool = False) -> DataFrame:
    """Statistics of every table of a set in one frame, with a ``table_name`` column first."""
    frames = {n: t.df if isinstance(t, Source) else t for n, t in tables.items()}
    return section_for_tables(frames, lambda df: profile.statistics(df, approx=approx))
