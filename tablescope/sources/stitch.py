"""Records that span lines, or lines that hold many records, cut by many tasks.

Spark's text source reads a file in byte ranges at any separator byte.  What
lies between two separators is a piece here: a line of CSV, or JSON up to a
closing brace.  Whether a piece ends a record depends on what came before it
in the file: whether a quote is open, and how deep brackets are nested.  That
is a prefix scan, done in two levels:

1. inside each byte range a running sum over its pieces, for both states the
   range may begin in; only numbers are shuffled for this;
2. over the ranges of each file, a row each, which gives the state, the depth
   and the number of records at the start of every range.

With these, the texts are read again, partitioned by range, and joined to
records where they lie.  Only records that cross a border between ranges
travel once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_path

_RANGE = ["file", "block"]


class Scan:
    """What a piece does: ``opens(value, inside)`` and ``depth(value, inside)``.

    ``opens`` tells whether a quote is open at the end of a piece that begins
    inside or outside of one, ``depth`` by how much brackets nest deeper then.
    ``closes``: without a separator behind it, a file's last piece is no record.
    """

    def __init__(self, sep: str, opens: Callable[[Column, bool], Column], depth: Callable[[Column, bool], Column], closes: bool):
        self.sep, self.opens, self.depth, self.closes = sep, opens, depth, closes


def pieces(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """``file, size, block, id, value`` of every piece; ``id`` grows along a byte range."""
    raw = spark.read.option("lineSep", sep).text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )


def _running(rows: DataFrame) -> DataFrame:
    """Adds, for both states a range may begin in, whether a quote is open after each piece and the depth there.

    A piece keeps the state, turns it over, or sets it whatever it was.  The
    state is that of the last piece that set it, turned over as often as
    pieces since then do.
    """
    along = Window.partitionBy(*_RANGE).orderBy("id")
    turned = F.sum(F.when(F.col("o0") & ~F.col("o1"), 1).otherwise(0)).over(along) % 2
    rows = rows.withColumn("turned", turned)
    fixed = F.when(F.col("o0") == F.col("o1"), (F.col("o0").cast("int") + F.col("turned")) % 2)
    rows = rows.withColumn("fixed", F.last(fixed, ignorenulls=True).over(along))
    for s in (0, 1):
        rows = rows.withColumn(f"open{s}", (F.coalesce("fixed", F.lit(s)) + F.col("turned")) % 2)
    for s in (0, 1):
        before = F.lag(f"open{s}", 1, s).over(along)
        rows = rows.withColumn(f"step{s}", F.when(before == 1, F.col("d1")).otherwise(F.col("d0")))
    for s in (0, 1):
        rows = rows.withColumn(f"depth{s}", F.sum(f"step{s}").over(along))
    rows = rows.withColumn("last", F.lead("id").over(along).isNull())
    return rows.drop("turned", "fixed", "step0", "step1", "o0", "o1", "d0", "d1")


def _marked(rows: DataFrame, scan: Scan) -> DataFrame:
    v = F.col("value")
    return rows.select(
        *_RANGE, "size", "id", "value", (F.octet_length(v) + 1).alias("bytes"), scan.opens(v, False).alias("o0"), scan.opens(v, True).alias("o1"), scan.depth(v, False).alias("d0"), scan.depth(v, True).alias("d1")
    )


def _starts(narrow: DataFrame) -> list[tuple]:
    """``(file, block, state, depth, cut)`` at the start of each range; one row a range reaches the driver.

    ``cut``: the range is its file's last, and no separator ends it.
    """
    last = F.max(F.struct("id", "open0", "open1", "depth0", "depth1"))
    totals = narrow.groupBy(*_RANGE).agg(last.alias("e"), F.sum("bytes").alias("bytes"), F.max("size").alias("size")).orderBy(*_RANGE).collect()
    out, file, state, depth, read = [], None, 0, 0, 0
    for i, r in enumerate(totals):
        if r.file != file:
            file, state, depth, read = r.file, 0, 0, 0
        read += r.bytes
        out.append((r.file, r.block, state, depth, (i + 1 == len(totals) or totals[i + 1].file != file) and read > r.size))
        state, depth = (r.e.open1, depth + r.e.depth1) if state else (r.e.open0, depth + r.e.depth0)
    return out


def records(spark: SparkSession, paths: list[str], scan: Scan, base: Column) -> DataFrame:
    """``file, nth, whole, text``: every record with its separators, and what is left behind a file's last one (``whole`` is false).

    A record ends with a piece that leaves no quote open and the depth of
    ``base``, a column over ``file``.
    """
    path = scratch_path(spark, "pieces")
    _running(_marked(pieces(spark, paths, scan.sep), scan).drop("value")).write.parquet(path)
    narrow = spark.read.parquet(path)
    starts = spark.createDataFrame(_starts(narrow), "file string, block long, state int, depth long, cut boolean")

    def ended(rows: DataFrame) -> DataFrame:
        at = rows.join(F.broadcast(starts), _RANGE)
        is_open = F.when(F.col("state") == 1, F.col("open1")).otherwise(F.col("open0"))
        depth = F.col("depth") + F.when(F.col("state") == 1, F.col("depth1")).otherwise(F.col("depth0"))
        short = F.col("last") & F.col("cut") if scan.closes else F.lit(False)
        return at.withColumn("ends", (is_open == 0) & (depth == base) & ~short).drop("state", "depth", "cut", "last", "open0", "open1", "depth0", "depth1")

    counts = ended(narrow).groupBy(*_RANGE).agg(F.count_if("ends").alias("n")).orderBy(*_RANGE).collect()  # one row a range
    firsts, file, before = [], None, 0
    for r in counts:
        before = 0 if r.file != file else before
        file = r.file
        firsts.append((r.file, r.block, before, r.n))
        before += r.n
    drop_scratch(spark, path)
    firsts = spark.createDataFrame(firsts, "file string, block long, before long, n long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    along = Window.partitionBy(*_RANGE).orderBy("id")
    texts = _marked(pieces(spark, paths, scan.sep).repartition(parts, *_RANGE), scan)
    placed = ended(_running(texts)).withColumn("e", F.sum(F.col("ends").cast("long")).over(along) - F.col("ends").cast("long"))
    own = placed.groupBy(*_RANGE, "e").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda x: x["value"]), scan.sep).alias("text"), F.max("ends").alias("whole")
    )
    own = own.join(F.broadcast(firsts), _RANGE)
    # The first record of a range may have begun before it, and the last goes on behind it.
    crosses = ((F.col("e") == 0) & (F.col("block") > 0)) | ~F.col("whole")
    nth = (F.col("before") + F.col("e")).alias("nth")
    inside = own.filter(~crosses).select("file", nth, "whole", "text")
    across = own.filter(crosses).select("file", nth, "block", "whole", "text").groupBy("file", "nth").agg(
        F.max("whole").alias("whole"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), scan.sep).alias("text")
    )
    return inside.unionByName(across.select("file", "nth", "whole", "text"))


# ------------------------------------------------------------------------ JSON
def json_scan() -> Scan:
    """Pieces of JSON end at ``}``; brackets count outside of strings, escaped characters count nowhere."""

    def parts(value: Column, odd: int) -> Column:
        plain = F.split(F.regexp_replace(value, r"(?s)\\.", ""), '"')
        return F.array_join(F.filter(plain, lambda x, i: i % 2 == odd), "")

    def open_after(value: Column, inside: bool) -> Column:
        quotes = F.size(F.split(F.regexp_replace(value, r"(?s)\\.", ""), '"')) - 1
        return (quotes % 2 == 1) != F.lit(inside)

    def deeper(value: Column, inside: bool) -> Column:
        # What lies outside of strings are the even parts of a piece that begins outside.
        out = parts(value, 1 if inside else 0)
        opened = F.length(out) - F.length(F.translate(out, "[{", ""))
        closed = F.length(out) - F.length(F.translate(out, "]", ""))
        return (opened - closed - F.when(open_after(value, inside), 0).otherwise(1)).cast("long")

    return Scan("}", open_after, deeper, True)


def json_lines(spark: SparkSession, arrays: list[str], objects: list[str]) -> str:
    """Rewrites JSON arrays and objects over many lines as one record a line; returns the folder.

    Text that is left behind the last record, other than the end of the array, raises ``ValueError``.
    """
    target = scratch_path(spark, "json-lines")
    for paths, base, start, rest in ((arrays, 1, r"^[\s,\[\]]*", r"^[\s\[\]]*$"), (objects, 0, r"^[\s,]*", r"^\s*$")):
        if not paths:
            continue
        found = records(spark, paths, json_scan(), F.lit(base))
        path = scratch_path(spark, "json-records")
        found.write.parquet(path)
        found = spark.read.parquet(path)
        left = found.filter(~F.col("whole") & ~F.col("text").rlike(rest)).select("file", F.substring("text", 1, 100).alias("t")).limit(1).collect()
        if left:
            raise ValueError(f"{left[0].file}: not every record is JSON: {left[0].t!r}")
        line = F.regexp_replace(F.regexp_replace(F.col("text"), start, ""), r"[\r\n]+", " ")  # strings hold no line break
        found.filter("whole").select(F.concat(line, F.lit("}")).alias("value")).write.mode("append").option("compression", "gzip").text(target)
        drop_scratch(spark, path)
    return target


# ------------------------------------------------------------------------- CSV
def _tail_of_field(value: Column, sep: str) -> tuple[Column, str]:
    edge = "(?=" + _escaped(sep) + r"|\r?$)"
    return F.replace(value, F.lit('""'), F.lit("")), edge


def _escaped(sep: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "\t" else c for c in sep)


def csv_scan(sep: str) -> Scan:
    """Pieces of CSV are lines; a quote opens at the start of a field and closes at its end, a doubled one does neither."""
    begin = "(^|" + _escaped(sep) + ")"

    def open_after(value: Column, inside: bool) -> Column:
        plain, edge = _tail_of_field(value, sep)
        closing = '(?s)^.*?"' + edge
        rest = F.regexp_replace(plain, closing, "") if inside else plain
        left = F.regexp_replace(rest, '(?s)' + begin + '".*?"' + edge, "$1")
        opens = left.rlike(begin + '"')
        return F.when(plain.rlike(closing), opens).otherwise(True) if inside else opens

    return Scan("\n", open_after, lambda value, inside: F.lit(0).cast("long"), False)


_HEAD = "\x02h"
_BREAKS = [("\x02", "\x02s"), ("\n", "\x02n"), ("\r", "\x02r")]


def csv_lines(spark: SparkSession, paths: list[str], sep: str, header: bool) -> tuple[str, str | None]:
    """Rewrites CSV as one record a line; returns the folder and, with ``header``, that of the first file's header.

    Each task writes a file of its own, compressed, since as many tasks will read them.

    Line breaks inside of fields are marks; ``with_breaks`` brings them back.
    """
    found = records(spark, paths, csv_scan(sep), F.lit(0))
    text = F.regexp_replace(F.col("text"), r"\r$", "")
    for a, b in _BREAKS:
        text = F.replace(text, F.lit(a), F.lit(b))
    # One pass writes both: headers with the name of their file before them, records as they are.
    is_head = (F.col("nth") == 0) if header else F.lit(False)
    lines = found.select(F.when(is_head, F.concat("file", F.lit(_HEAD), text)).otherwise(text).alias("value"), is_head.cast("int").alias("head"))
    target = scratch_path(spark, "csv-lines")
    lines.write.partitionBy("head").option("compression", "gzip").text(target)
    if not header:
        return f"{target}/head=0", None
    heads = spark.read.text(f"{target}/head=1").select(F.split("value", _HEAD).alias("v"))
    head = scratch_path(spark, "csv-header")
    heads.select(F.col("v")[0].alias("file"), F.col("v")[1].alias("value")).orderBy("file").limit(1).select("value").coalesce(1).write.text(head)
    if heads.count() and not matches_any(spark, f"{target}/head=0"):
        return head, head  # a header and no record
    return f"{target}/head=0", head


def matches_any(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def with_breaks(value: Column) -> Column:
    """A field as it was before ``csv_lines``."""
    for a, b in reversed(_BREAKS):
        value = F.replace(value, F.lit(b), F.lit(a))
    return value


def plain_breaks(name: str) -> str:
    """``with_breaks`` of a plain text."""
    for a, b in reversed(_BREAKS):
        name = name.replace(b, a)
    return name
