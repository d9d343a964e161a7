"""File and table-set sources.

``open_source`` reads a CSV, Parquet or JSON file (or a directory or glob of
them) as a DataFrame, with the inference fixes that make Spark's schema read
like the reference's: CSV delimiter and header sniffed from the first lines,
small integers widened to BIGINT, timestamps without a zone, JSON date
strings typed, JSON columns in order of appearance.

A *table set* is a directory whose entries are tables: sub-directories of
part files, or single files with a known suffix.  It stands in for a database
file of several tables.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import col
from . import stitch

FORMATS = ("csv", "parquet", "json")
_SUFFIXES = {"csv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "ndjson": "json"}
# Formats the reference accepts that are a database file of its own engine;
# here a directory of tables (``open_table_set``) takes their place.
_DATABASE_SUFFIXES = ("duckdb", "db")

_SNIFF_LINES = 20
_SNIFF_CHARS = 65_536
_BROKEN = "__not_json"
_QUOTED_EMPTY = "\x01\x01"  # stands for ``""`` while reading; Spark alone takes it for NULL
_DELIMITERS = [",", ";", "\t", "|"]
_NUMBER = re.compile(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$")
_DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"
_TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"


@dataclass
class Source:
    """A loaded table and the facts about where it came from."""

    name: str
    path: str
    fmt: str
    df: DataFrame
    file_name: str = ""
    options: dict = field(default_factory=dict)

    def register(self, view: str | None = None) -> "Source":
        """Register the table as a temporary view (``data`` by default)."""
        self.df.createOrReplaceTempView(view or "data")
        return self


def suffix_format(path: str) -> str | None:
    """Format from a path suffix, case-insensitive; ``None`` when unknown."""
    base = path.rstrip("/").rsplit("/", 1)[-1]
    if "." not in base:
        return None
    suffix = base.rsplit(".", 1)[-1].lower()
    return _SUFFIXES.get(suffix)


def file_name_of(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _file_system(spark: SparkSession, path: str):
    """The path as Hadoop sees it and its file system."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def matches(spark: SparkSession, path: str) -> list:
    """File statuses of a path or glob; raises ``FileNotFoundError`` when there are none."""
    hpath, fs = _file_system(spark, path)
    found = fs.globStatus(hpath)
    if found is None or len(found) == 0:
        raise FileNotFoundError(f"no such file or directory: {path}")
    return list(found)


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path or glob, from the file system's own summary; no Spark job."""
    _, fs = _file_system(spark, path)
    return sum(fs.getContentSummary(m.getPath()).getLength() for m in matches(spark, path))


def check_source(spark: SparkSession, path: str, fmt: str | None = None) -> str:
    """Validate a source path and return its format.

    Raises ``FileNotFoundError`` for a missing path and ``ValueError`` for a
    format that is neither given nor known from the suffix.
    """
    if fmt is not None:
        fmt = fmt.lower()
        if fmt == "jsonl":
            fmt = "json"
        if fmt not in FORMATS:
            raise ValueError(f"unsupported format {fmt!r}; expected one of {', '.join(FORMATS)}")
    else:
        base = file_name_of(path).lower()
        if base.endswith(tuple("." + s for s in _DATABASE_SUFFIXES)):
            raise ValueError(
                f"{path}: database files are not read; point to a directory of tables (open_table_set)"
            )
        fmt = suffix_format(path)
        if fmt is None:
            raise ValueError(
                f"cannot tell the format of {path!r}; use a .csv, .parquet or .json suffix or pass fmt="
            )
    matches(spark, path)
    return fmt


# --------------------------------------------------------------------------- CSV
def _first_lines(spark: SparkSession, path: str, n: int = _SNIFF_LINES) -> list[str]:
    """The first lines, each cut to ``_SNIFF_CHARS`` before it leaves its executor."""
    return [r.value for r in spark.read.text(path).select(F.substring("value", 1, _SNIFF_CHARS).alias("value")).limit(n).collect()]


def split_quoted(line: str, sep: str) -> list[str]:
    """Fields of one line; a separator between double quotes is text."""
    fields, quoted, current = [], False, []
    for ch in line:
        if ch == '"':
            quoted = not quoted
        if ch == sep and not quoted:
            fields.append("".join(current))
            current = []
        else:
            current.append(ch)
    return [f.strip().strip('"') for f in [*fields, "".join(current)]]


def whole_records(lines: list[str]) -> list[str]:
    """Lines joined while a quote is open; a last record that stays open is left out."""
    records, held = [], ""
    for ln in lines:
        held = f"{held}\n{ln}" if held else ln
        if held.count('"') % 2 == 0:
            records.append(held)
            held = ""
    return records or lines[:1]


def sniff_csv(lines: list[str]) -> tuple[str, bool]:
    """Pick a delimiter and decide whether the first record is a header."""
    records = [r for r in whole_records(lines) if r.strip()]
    if not records:
        return ",", True
    best, best_score = ",", -1.0
    for d in _DELIMITERS:
        counts = [len(split_quoted(r, d)) - 1 for r in records]
        if counts[0] == 0:
            continue
        consistent = sum(1 for c in counts if c == counts[0]) / len(counts)
        score = consistent * 1000 + counts[0]
        if score > best_score:
            best, best_score = d, score
    first = split_quoted(records[0], best)
    return best, not any(_NUMBER.match(f) or re.match(_DATE_TEXT, f) for f in first if f)


def has_open_quotes(spark: SparkSession, path: str, sep: str = ",") -> bool:
    """Whether a quoted field goes on behind the end of any line."""
    return spark.read.text(path).filter(stitch.csv_scan(sep).opens(F.col("value"), False)).limit(1).count() > 0


def files_below(spark: SparkSession, path: str) -> list[str]:
    """The files that Spark reads for a path, a folder or a glob."""
    return spark.read.text(path).inputFiles()


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool | None = None, multiline: bool | None = None) -> DataFrame:
    """CSV with sniffed delimiter and header and types inferred from every row.

    A doubled quote inside a quoted field is one quote.  Quoted line breaks
    are looked for in the whole input unless ``multiline`` says whether
    there are any; files that have them are rewritten in the shared scratch
    folder with one record a line, by a task for each byte range.  Rows
    that do not have the columns of the first one raise ``ValueError``: the
    delimiter or header was guessed wrong, or the file is broken.
    """
    if sep is None or header is None:
        s, h = sniff_csv(_first_lines(spark, path))
        sep = s if sep is None else sep
        header = h if header is None else header
    if multiline is None:
        multiline = has_open_quotes(spark, path, sep)
    opts = {"sep": sep, "header": header, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    names = None
    if multiline:
        path, head = stitch.csv_lines(spark, files_below(spark, path), sep, header)
        if header:
            names = [stitch.plain_breaks(n) for n in spark.read.csv(head, **opts).columns]
            opts["header"] = path == head  # then there is no record
    df = spark.read.csv(path, inferSchema=True, **opts)
    if names and len(names) == len(df.columns):
        df = df.toDF(*names)
    stamps = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    # Timestamps are read as text with the inferred schema (no second
    # inference pass) and parsed without a time zone, so wall-clock values in
    # a daylight-saving gap of the session zone stay as written.
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in stamps else f.dataType, True) for f in df.schema.fields])
    _refuse_misfits(spark, path, schema, opts)
    return _widen_csv(spark.read.csv(path, schema=schema, emptyValue=_QUOTED_EMPTY, **opts), stamps, multiline)


def _refuse_misfits(spark: SparkSession, path: str, schema: T.StructType, opts: dict) -> None:
    bad = _unused_name("_misfit", schema.names)
    rows = spark.read.csv(path, schema=T.StructType([*schema.fields, T.StructField(bad, T.StringType())]), columnNameOfCorruptRecord=bad, **opts)
    # The hash of every column keeps the reader from parsing some columns only, which would hide misfits.
    every = F.xxhash64(*[col(n) for n in schema.names])
    example = rows.select(F.substring(col(bad), 1, 100).alias("t"), every.alias("h")).filter("t IS NOT NULL").limit(1).collect()
    if example:
        raise ValueError(f"{path}: a row does not fit the columns {schema.names} (separator {opts['sep']!r}): {example[0].t!r}; pass sep= and header=")


def _unused_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _widen_csv(df: DataFrame, stamps: set[str], marked: bool = False) -> DataFrame:
    """Integers to BIGINT; timestamp text to wall-clock timestamps.

    Text with an explicit offset falls back to the zoned parse, converted to
    the session's wall clock.
    """
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif f.name in stamps:
            c = F.coalesce(c.try_cast("timestamp_ntz"), c.try_cast("timestamp").cast("timestamp_ntz"))
        elif isinstance(f.dataType, T.StringType):
            c = F.when(c == _QUOTED_EMPTY, "").otherwise(stitch.with_breaks(c) if marked else c)  # ``""`` is a text, nothing is NULL
        out.append(c.alias(f.name))
    return df.select(*out)


# -------------------------------------------------------------------------- JSON
def read_json(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """JSON lines, top-level arrays or objects over many lines; date strings typed.

    Columns come in order of appearance in the first record.  Which of these a
    file is, is told for each file.  Arrays and objects over many lines are
    rewritten as lines in the shared scratch folder, by a task for each byte
    range; ``multiline=False`` says that all files are lines.  Text that is not
    JSON raises ``ValueError``.
    """
    heads = {} if multiline is False else _heads(spark, path)
    arrays = [f for f, h in heads.items() if h.startswith("[")]
    lines: list[str] | str = [f for f in heads if f not in set(arrays)]
    if not arrays:
        lines = path
    df = spark.read.json(lines, mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN) if lines else None
    objects = sorted(_joined_objects(spark, lines)) if heads and lines else []
    if df is not None and _BROKEN in df.columns and multiline is not False:
        objects = sorted({*objects, *_not_lines(spark, lines)})
    if objects:
        lines = [f for f in heads if f not in set(arrays) | set(objects)]
    if arrays or objects:
        df = spark.read.json([*lines, stitch.json_lines(spark, arrays, objects)], mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN)
    if _BROKEN in df.columns:
        raise ValueError(f"{path}: not every record is JSON")
    order = top_level_keys(_head_text(spark, min(heads)) if heads else "\n".join(_first_lines(spark, path, 1)))
    if order:
        names = [n for n in order if n in df.columns] + [n for n in df.columns if n not in order]
        df = df.select(*[col(n) for n in names])
    return type_date_strings(df)


def _heads(spark: SparkSession, path: str) -> dict[str, str]:
    """The first character of every file that is not blank; a row a file reaches the driver.

    A single line may be a whole file, so files are read up to closing braces.
    """
    first = _openings(spark, path).select("file", "id", F.substring("text", 1, 1).alias("text"))
    return {r.file: r.text for r in first.groupBy("file").agg(F.min_by("text", "id").alias("text")).collect()}


def _openings(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the first byte range of every file that are not blank, each cut and without space before it."""
    first = stitch.pieces(spark, [path], "}").filter("block = 0")
    text = F.regexp_replace(F.substring("value", 1, _SNIFF_CHARS), r"^[\s\ufeff]+", "")
    return first.select("file", "id", F.concat(text, F.lit("}")).alias("text"), text.alias("bare")).filter("bare <> ''")


def _head_text(spark: SparkSession, file: str) -> str:
    """The opening of one file: as many braces as are needed to see its member names in most cases."""
    rows = _openings(spark, file).orderBy("id").limit(_SNIFF_LINES).select("text").collect()
    return "".join(r.text for r in rows)[:_SNIFF_CHARS]


def _joined_objects(spark: SparkSession, paths: list[str] | str) -> list[str]:
    """The files in which an object may follow another in the same line, where Spark would read the first only.

    What looks so inside of a string counts as well: such a file takes the longer way.
    """
    found = stitch.pieces(spark, [paths] if isinstance(paths, str) else paths, "}").withColumn("follows", F.col("value").rlike(r"^[ \t]*\{"))
    opening = F.min_by("follows", F.when(F.col("block") == 0, F.col("id")))  # nothing stands before a file's first piece
    seen = found.groupBy("file").agg((F.count_if("follows") - F.coalesce(opening, F.lit(False)).cast("int")).alias("n"))
    return [r.file for r in seen.filter("n > 0").select("file").collect()]  # files, not rows


def _not_lines(spark: SparkSession, paths: list[str] | str) -> list[str]:
    """The files that have a line which is no JSON object of its own."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    bad = rows.filter(F.col("value").rlike(r"\S") & F.json_object_keys("value").isNull())
    return [r.file for r in bad.select("file").distinct().collect()]  # files, not rows


def top_level_keys(text: str) -> list[str]:
    """Names of the first object's members in order, also when the text is cut off."""
    start = text.find("{")
    keys: list[str] = []
    depth, at = 0, start
    while 0 <= at < len(text):
        ch = text[at]
        if ch == '"':
            end = at + 1
            while end < len(text) and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            if depth == 1 and re.match(r"\s*:", text[end + 1 :]):
                keys.append(json.loads(text[at : end + 1]))
            at = end
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if depth == 0:
                break
        at += 1
    return keys


def type_date_strings(df: DataFrame) -> DataFrame:
    """Cast string columns whose every non-null value is a date or timestamp.

    One aggregate job over the string columns decides all of them.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    checks = []
    for i, name in enumerate(strings):
        c = col(name)
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.rlike(_DATE_TEXT) & F.try_to_date(c, "yyyy-MM-dd").isNotNull()).alias(f"d{i}"),
            F.count_if(c.rlike(_TIMESTAMP_TEXT) & c.try_cast("timestamp_ntz").isNotNull()).alias(f"t{i}"),
        ]
    row = df.agg(*checks).first()
    casts = {}
    for i, name in enumerate(strings):
        n, d, t = row[f"n{i}"], row[f"d{i}"], row[f"t{i}"]
        if n and d == n:
            casts[name] = "date"
        elif n and d + t == n:
            casts[name] = "timestamp_ntz"
    if not casts:
        return df
    return df.select(
        *[
            (col(f.name).try_cast(casts[f.name]) if f.name in casts else col(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


# ------------------------------------------------------------------------ entry
def open_source(spark: SparkSession, path: str, fmt: str | None = None, name: str | None = None, **options) -> Source:
    """Check, read and name one source; ``sep``, ``header`` and ``multiline`` override what is guessed."""
    unknown = set(options) - {"sep", "header", "multiline"}
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    fmt = check_source(spark, path, fmt)
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        df = read_csv(spark, path, sep=options.get("sep"), header=options.get("header"), multiline=options.get("multiline"))
    else:
        df = read_json(spark, path, multiline=options.get("multiline"))
    fname = file_name_of(path)
    table = name or (fname.rsplit(".", 1)[0] if "." in fname else fname)
    return Source(name=table, path=path, fmt=fmt, df=df, file_name=fname, options=dict(options))


def table_entries(spark: SparkSession, directory: str) -> list[tuple[str, str, str]]:
    """Tables of a directory: ``(name, path, format)`` sorted by name.

    A sub-directory is one table (its part files share a format); a file with
    a known suffix is one table named after the file.  The file system lists
    them, without a Spark job; hidden files and folders are passed over.
    """
    root = directory.rstrip("/")
    matches(spark, root)
    hpath, fs = _file_system(spark, root)
    out = []
    for status in fs.listStatus(hpath):
        entry = status.getPath().getName()
        if _hidden(entry):
            continue
        formats = sorted({f for f in _formats_below(fs, status) if f})
        if not formats:
            continue
        if len(formats) > 1:
            raise ValueError(f"{root}/{entry}: files of several formats in one table: {', '.join(formats)}")
        # ``t.parquet`` may be one file or a directory of part files
        name = entry.rsplit(".", 1)[0] if suffix_format(entry) else entry
        out.append((name, f"{root}/{entry}", formats[0]))
    return sorted(out)


def _hidden(name: str) -> bool:
    """Names that Spark's file sources do not read."""
    return name.startswith((".", "_")) and "=" not in name


def _formats_below(fs, status):
    """The formats of the files of an entry, whatever the depth."""
    if not status.isDirectory():
        yield suffix_format(status.getPath().getName())
        return
    for inner in fs.listStatus(status.getPath()):
        if not _hidden(inner.getPath().getName()):
            yield from _formats_below(fs, inner)


def open_database(spark: SparkSession, database: str) -> dict[str, Source]:
    """All tables and views of a database of the session's catalog, by name."""
    if not spark.catalog.databaseExists(database):
        raise ValueError(f"no such database: {database}")
    found = [t for t in spark.catalog.listTables(database) if not t.isTemporary]
    quoted = lambda n: "`" + n.replace("`", "``") + "`"
    return {t.name: Source(t.name, f"{database}.{t.name}", "table", spark.table(f"{quoted(database)}.{quoted(t.name)}")) for t in sorted(found, key=lambda t: t.name)}


def open_table_set(spark: SparkSession, directory: str) -> dict[str, Source]:
    """All tables of a directory, by name (first by name is the default)."""
    return {name: open_source(spark, path, fmt, name=name) for name, path, fmt in table_entries(spark, directory)}


def default_table(tables: dict[str, Source]) -> Source:
    if not tables:
        raise ValueError("the table set holds no tables")
    return tables[sorted(tables)[0]]


def register_all(tables: dict[str, Source]) -> None:
    """Register every table of a set as a temporary view under its name."""
    for name, src in tables.items():
        src.df.createOrReplaceTempView(name)
