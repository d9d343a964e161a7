"""Importance resampling of documents towards a target collection.

Every run of one to three words is a feature that falls into one of
``BUCKETS`` by its CRC-32.  A bucket's gain is the smoothed log ratio of its
share in the target and in the corpus, a document's weight the sum of the
gains of its features, its score the weight and a Gumbel noise that its id
decides.  The documents of the highest scores are drawn, which is a draw
without replacement in proportion to the weights.

1. Every task adds up its features in one array of ``BUCKETS`` counts; only
   those arrays are shuffled, for the corpus and for the target.
2. Scoring reads the texts again, looks the gains up in an array and writes
   the scores as a table in the shared scratch folder.
3. The cutoff is found by bisection on numbers: each job counts the rows up to
   ``PROBES`` thresholds at once.  Rows tied at the cutoff are bisected by id,
   and rows that are tied in that too by their place in the table.  Nothing is
   sorted and nothing but counts travels.
4. The drawn rows are range-partitioned by (score, id) and written with their
   place; the rows before a partition, one number each, give the ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import literal_rows
from ..session import drop_scratch, scratch_path
from .common import byte_slices, bytes_of
from .spans import FOLD, byte_class, word_spans

BUCKETS = 10_000
RUN = 3  #: words of the longest feature
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SCALE = 1000  #: gains and noise are in thousandths
PROBES = 15
SHORT = 64  #: words of more bytes go through CRC-32 one by one

_INSIDE = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_SCORED = "uid long, doc_id long, n_words long, n_features long, weight long"


# ---------------------------------------------------------------- CRC-32 of runs
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_STEP = _byte_table()


def _advanced(crc: np.ndarray) -> np.ndarray:
    """Checksums after one more zero byte."""
    return _STEP[crc & np.uint32(255)] ^ (crc >> np.uint32(8))


def _shift_tables() -> np.ndarray:
    """``[length, place of a byte, byte]``: what each byte of a checksum becomes ``length`` bytes later."""
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    out = np.empty((SHORT + 2, 4, 256), np.uint32)
    for length in range(SHORT + 2):
        out[length] = now
        now = _advanced(now)
    return out


_SHIFT = _shift_tables()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of the same bytes when ``length`` zero bytes follow, without the final inversions."""
    crc = crc.copy()
    for far in np.unique(length[length > SHORT + 1]):  # few: words of many bytes
        rows, left = np.flatnonzero(length == far), int(far)
        while left > 0:
            step = min(left, SHORT + 1)
            crc[rows] = _shift(crc[rows], np.full(len(rows), step))
            left -= step
    near = np.where(length > SHORT + 1, 0, length)
    return _shift(crc, near)


def _shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = _SHIFT[length, 0, crc & np.uint32(255)]
    for j in (1, 2, 3):
        out ^= _SHIFT[length, j, (crc >> np.uint32(8 * j)) & np.uint32(255)]
    return out


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, byte by byte over all ranges at once."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    long = np.flatnonzero(size > SHORT)
    order = np.argsort(-np.where(size > SHORT, 0, size), kind="stable")
    sorted_size = size[order]
    sorted_size = np.where(sorted_size > SHORT, 0, sorted_size)
    begin, crc = start[order], out[order]
    for p in range(int(sorted_size[0]) if len(sorted_size) else 0):
        n = int(np.searchsorted(-sorted_size, -p, "left"))  # ranges of more than p bytes
        crc[:n] = _STEP[(crc[:n] ^ data[begin[:n] + p]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in long:
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def run_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... ``RUN`` words: CRC-32 of the words joined by a blank, and the place of the first word.

    The checksum of a joined text is that of its front, moved on by the
    length of its rest, against that of its rest.
    """
    crc, size = word_crcs(data, start, end), end - start
    blank = shifted(np.full(len(size), zlib.crc32(b" "), np.uint32), size) ^ crc  # of a blank and the word
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = [(crc, np.arange(len(crc)))]
    for words in range(2, RUN + 1):
        front, first = out[-1]
        last = first + (words - 1)
        fits = last < len(crc)
        fits[fits] = text[last[fits]] == text[first[fits]]
        front, first, last = front[fits], first[fits], last[fits]
        out.append((shifted(front, size[last] + 1) ^ blank[last], first))
    return out


def _features(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Word offsets of texts, and buckets of their runs with the place of each run's first word."""
    data, offsets = bytes_of(column)
    data = FOLD[data]
    start, end, at = word_spans(data, offsets, _INSIDE)
    return at, [((crc % np.uint32(BUCKETS)).astype(np.int64), first) for crc, first in run_crcs(data, start, end, at)]


# ------------------------------------------------------------------ two passes
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (bucket, n), one row for each bucket that a task has met."""
    counts = np.zeros(BUCKETS, np.int64)
    for part in byte_slices(batches, "text"):
        for bucket, _ in _features(part.column("text"))[1]:
            counts += np.bincount(bucket, minlength=BUCKETS)
    met = np.flatnonzero(counts)
    if len(met):
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts in each bucket."""
    rows = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(_count, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(ratio of smoothed shares))`` of every bucket."""
    s_all, t_all = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratio = [float((int(t) + 1) * s_all) / float((int(s) + 1) * t_all) for s, t in zip(corpus, target)]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], np.int64)


def _weigh(gain: np.ndarray):
    """Rows (uid, doc_id, text) -> words, features and weight of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            at, runs = _features(part.column("text"))
            per_word = np.zeros(int(at[-1]) + 1, np.int64)
            for bucket, first in runs:
                per_word[first + 1] += gain[bucket]
            total = np.cumsum(per_word)
            words = np.diff(at)
            features = sum(np.maximum(words - k, 0) for k in range(RUN))
            columns = [part.column("uid"), part.column("doc_id"), pa.array(words), pa.array(features), pa.array(total[at[1:]] - total[at[:-1]])]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that the id decides; a NULL id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


# ---------------------------------------------------------------------- cutoff
def least_reaching(rows: DataFrame, column: str, want: int) -> tuple[int, int, int]:
    """The least value ``v`` of a long column so that ``want`` rows are at most ``v``; rows below ``v`` and at ``v``.

    ``rows`` is a written table of at least ``want`` rows, ``want`` at least 1.
    """
    low, high, total = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    below = 0  # rows under ``low``
    upto = total  # rows up to ``high``
    while low < high:
        span = high - low
        cuts = sorted({low + span * (i + 1) // (PROBES + 1) for i in range(PROBES)} - {high})
        counts = rows.agg(*[F.count_if(F.col(column) <= F.lit(c)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        for cut, n in zip(cuts, counts):
            if n >= want:
                high, upto = cut, n
                break
            low, below = cut + 1, n
    return low, below, upto - below


def chosen(rows: DataFrame, want: int, keys: list[str]) -> Column:
    """A condition that holds for the ``want`` rows that come first by ``keys`` (long columns without NULLs)."""
    if want <= 0:
        return F.lit(False)
    picked, level = F.lit(False), F.lit(True)
    for key in keys:
        value, below, at = least_reaching(rows, key, want)
        picked = picked | (level & (F.col(key) < F.lit(value)))
        level = level & (F.col(key) == F.lit(value))
        want -= below
        if want == at:
            break
        rows = rows.filter(F.col(key) == F.lit(value))
    return picked | level


# -------------------------------------------------------------------- operator
def _stored(rows: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with a column ``rank`` from 1 in the order of ``keys``, without one task for all."""
    spark: SparkSession = rows.sparkSession
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("part"), inner.alias("place"))
    placed, _ = _stored(ranged, "resample-ranked")
    sizes = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = literal_rows(spark, starts, "part int, before long")
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("place") + 1)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id", least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    Of the rows with at least ``least_words`` words, ``floor(percent * N /
    100)`` are drawn and ranked from 1; ``rank`` is NULL for all others.  Ties
    go to the smaller id, a NULL id counts as larger than any other, and rows
    that agree in score and id go by their place in ``docs``, which must be
    read from files.  A NULL text is empty: no feature, weight 0.  An empty
    ``target`` or an empty ``docs`` is no error.  Other columns are not
    looked at.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    weighed = rows.mapInArrow(_weigh(gain), _SCORED).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    ordered = weighed.select(
        "*",
        (-F.col("score")).alias("down"),
        F.col("doc_id").isNull().cast("long").alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
    )
    scored, _ = _stored(ordered, "resample-scores")
    keys = ["down", "no_id", "id", "uid"]
    usable, path = _stored(scored.filter(F.col("n_words") >= least_words).select(*keys), "resample-usable")
    want = percent * usable.count() // 100
    # The condition names numbers only, so it holds for the rows of ``scored`` as well.
    drawn = (F.col("n_words") >= least_words) & chosen(usable, want, keys)
    drop_scratch(scored.sparkSession, path)
    out = ["doc_id", "n_features", "weight", "score"]
    ranked = _ranked(scored.filter(drawn).select(*out, *keys), keys).select(*out, F.col("rank").cast("long").alias("rank"))
    return ranked.union(scored.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
