"""Exact deduplication by Grace hash partitioning and complete comparison.

1. Every task runs its rows through an open-addressing table of bounded size
   and writes one row per document; only the first row of each distinct text
   of a table keeps the text.  So a text that fills a third of the corpus
   travels once per table, not once per document.
2. The kept texts are dealt into hash buckets.  A bucket that is larger than
   a table may be is dealt again on further hash bits, until each fits.
   Equal texts cannot be parted by their hash: a text whose copies alone
   exceed the bound is folded in salted rounds first.
3. Each bucket goes through an open-addressing table that compares complete
   texts; a hash alone never decides.

The files of step 1 are in the shared scratch folder, so a lost executor
costs a re-read, and shuffle files are the spill files of the buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import SPACE_CLASS, byte_slices, unused_name

TABLE_BYTES = 24 << 20  #: text bytes that one open-addressing table may hold
FAN_OUT_BITS = 6  #: each dealing splits a bucket in 2**6
MAX_LEVELS = 8
NAMED_BUCKETS = 1000  #: so many large buckets are named in a plan
SALTS = 64

#: one row per document; the columns after ``first`` are set where a table met a text for the first time
_ROWS = "uid long, doc_id long, head long, first boolean, h long, text string, held long, n long, least long, text_sha256 string"
_ARROW = pa.schema(
    [
        ("uid", pa.int64()),
        ("doc_id", pa.int64()),
        ("head", pa.int64()),
        ("first", pa.bool_()),
        ("h", pa.int64()),
        ("text", pa.string()),
        ("held", pa.int64()),
        ("n", pa.int64()),
        ("least", pa.int64()),
        ("text_sha256", pa.string()),
    ]
)
_CLASSES = "uid long, into long"


class OpenTable:
    """Open addressing with linear probing; equality is of complete texts."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.texts: list[str] = []
        self.held = 0

    def _probe(self, h: int, text: str) -> tuple[int, int]:
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.texts[entry] == text:
                return at, int(entry)
            at = (at + 1) & mask
        return at, -1

    def add(self, h: int, text: str) -> tuple[int, bool]:
        """The entry of ``text`` and whether it is new."""
        if 2 * len(self.texts) >= len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            mask = len(self.slots) - 1
            for entry, key in enumerate(self.hashes):
                at = key & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = entry
        at, entry = self._probe(h, text)
        if entry >= 0:
            return entry, False
        self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.held += len(text)
        return len(self.texts) - 1, True


def _folded(table: OpenTable, rows: list[tuple[int, int | None, int, bool]]) -> pa.RecordBatch:
    """The rows that one table has seen: group size, smallest id and its row for each distinct text."""
    heads = [0] * len(table.texts)
    sizes = [0] * len(table.texts)
    least: list[tuple[bool, int, int]] = [(True, 0, 0)] * len(table.texts)
    for uid, doc_id, entry, new in rows:
        mine = (doc_id is None, doc_id or 0, uid)
        if new:
            heads[entry], least[entry] = uid, mine
        least[entry] = min(least[entry], mine)
        sizes[entry] += 1
    out = []
    for uid, doc_id, entry, new in rows:
        no_id, least_id, least_uid = least[entry]
        row = (uid, doc_id, heads[entry], uid == least_uid)
        if new:
            text = table.texts[entry].encode()
            digest = hashlib.sha256(text).hexdigest()
            out.append((*row, table.hashes[entry], table.texts[entry], len(text), sizes[entry], None if no_id else least_id, digest))
        else:
            out.append((*row, *[None] * 6))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)


def _fold_rows(bound: int):
    """Rows (uid, doc_id, h, text) of a task through tables of at most about ``bound`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = OpenTable(), []
        for part in byte_slices(batches, "text", bound // 4):
            for uid, doc_id, h, text in zip(*(part.column(c).to_pylist() for c in ("uid", "doc_id", "h", "text"))):
                rows.append((uid, doc_id, *table.add(h, text)))
            if table.held >= bound or len(rows) >= 1 << 17:
                yield _folded(table, rows)
                table, rows = OpenTable(), []
        if rows:
            yield _folded(table, rows)

    return run


def _match_bucket(group: pa.Table) -> pa.Table:
    """Texts of one bucket -> (uid, uid of the first row of the same text)."""
    table, first, out = OpenTable(), [], []
    for uid, h, text in zip(*(group.column(c).to_pylist() for c in ("uid", "h", "text"))):
        entry, new = table.add(h, text)
        if new:
            first.append(uid)
        out.append(first[entry])
    return pa.table({"uid": group.column("uid"), "into": pa.array(out, pa.int64())})


def _dealt(heads: DataFrame, bound: int) -> tuple[DataFrame, bool]:
    """``heads`` with a column ``bucket``, dealt again until a bucket holds at most ``bound`` bytes.

    Only bucket sizes travel.  Also returns whether some bucket stays too
    large because one hash fills it.
    """
    deal = lambda level: F.concat(F.lit(f"{level}:"), F.col("h").bitwiseAND(F.lit((1 << (FAN_OUT_BITS * level)) - 1)))
    bucket, level = deal(1), 1
    while True:
        sized = (
            heads.select(bucket.alias("bucket"), "held", "h")
            .groupBy("bucket")
            .agg(F.sum("held").alias("held"), F.min("h").alias("low"), F.max("h").alias("high"))
            .filter(F.col("held") > bound)
        )
        over = sized.limit(NAMED_BUCKETS + 1).collect()
        mixed = [r.bucket for r in over if r.low != r.high]
        if not mixed or level == MAX_LEVELS:
            return heads.withColumn("bucket", bucket), len(over) > len(mixed)
        level += 1
        # Beyond the bound on names in a plan, every bucket is dealt again.
        bucket = deal(level) if len(over) > NAMED_BUCKETS else F.when(bucket.isin(mixed), deal(level)).otherwise(bucket)


def _classes(spark: SparkSession, heads: DataFrame, bound: int) -> DataFrame:
    """(uid, into) of every head: ``into`` is the same for equal texts."""
    dealt, hot = _dealt(heads, bound)
    if not hot:
        return dealt.select("bucket", "uid", "h", "text").groupBy("bucket").applyInArrow(_match_bucket, _CLASSES)
    # One text fills a bucket: fold its copies in salted groups, then compare what is left.
    path = scratch_path(spark, "grace-fold")
    salted = dealt.select("bucket", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).alias("salt"), "uid", "h", "text")
    salted.groupBy("bucket", "salt").applyInArrow(_match_bucket, _CLASSES).write.parquet(path)
    folded = spark.read.schema(_CLASSES).parquet(path)
    left = heads.join(folded.filter("uid = into").select("uid"), "uid", "left_semi")
    again = _dealt(left, bound)[0].select("bucket", "uid", "h", "text").groupBy("bucket").applyInArrow(_match_bucket, _CLASSES)
    return folded.withColumnRenamed("into", "mid").join(again.withColumnRenamed("uid", "mid"), "mid").select("uid", "into")


def assign(docs: DataFrame, text: str = "text", key: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``uid, doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    ``uid`` is ``monotonically_increasing_id()`` of ``docs``, stable for a
    table that is read from files.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(key).cast("long").alias("doc_id"),
        F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE_CLASS, " ").alias("text"),
    ).select("uid", "doc_id", F.xxhash64("text").alias("h"), "text")
    path = scratch_path(spark, "grace")
    rows.mapInArrow(_fold_rows(table_bytes), _ROWS).write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(_ROWS).parquet(path)
    heads = written.filter("text IS NOT NULL")
    classes = _classes(spark, heads.select("uid", "h", "held", "text"), table_bytes)
    counted = heads.select("uid", "n", "least", "text_sha256").join(classes, "uid")
    smallest = F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "uid"))
    sums = counted.groupBy("into").agg(F.sum("n").alias("group_size"), smallest.alias("keep"))
    of_head = counted.join(sums, "into").select(F.col("uid").alias("head"), "group_size", "keep", "text_sha256")
    return written.select("uid", "doc_id", "head", "first").join(of_head, "head").select(
        "uid",
        "doc_id",
        F.col("keep.least").alias("keep_id"),
        "group_size",
        (F.col("first") & (F.col("head") == F.col("keep.uid"))).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space is
    replaced by one blank; NULL counts as empty.  Of equal texts the row with
    the smallest id stays.  A NULL id counts as larger than any other, and
    ``keep_id`` is NULL when a group has no other id; of several rows with the
    smallest id the first read is ``kept``, so exactly one row of a group is.
    An empty table gives an empty result.  Other columns, whatever their
    names, are not looked at.
    """
    return assign(docs, text, key, table_bytes).drop("uid")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with all their columns.

    ``docs`` must be read from files, so that both readings number its rows
    alike.
    """
    # The list grows with the corpus: a sort-merge join at every size, never a broadcast.
    uid = unused_name("__uid", docs.columns)
    kept = assign(docs, text, key).filter("kept").select(F.col("uid").alias(uid)).hint("merge")
    return docs.withColumn(uid, F.monotonically_increasing_id()).join(kept, uid, "left_semi").drop(uid)
