"""Helpers shared by the training-data operators.

Texts travel to Python as Arrow batches; ``byte_slices`` cuts a batch into
pieces of a few megabytes, so memory in a worker does not depend on how long
the documents are (one very long text is a piece of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: white space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column is called so in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def id_remainder(doc_id: Column, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; a NULL id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, view: Column, text: str = "text", key: str = "doc_id"
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``per_class`` labelled texts of each class 0 and 1, and the size of each class.

    ``learn`` is a condition on the columns of ``docs``.  Rows are taken in
    the order of a hash of their id, so the sample does not depend on files
    or partitions.  ``view`` is what of a text travels.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("__id"), F.col(label).cast("int").alias("y"))
    usable = docs.filter(learn & F.col(text).isNotNull())
    both = usable.select(F.col(key).alias("__id")).join(known, "__id").withColumn("h", F.xxhash64("__id", F.lit(17)))
    counts = {r.y: r.n for r in both.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # Ids first: about a third more than are needed pass the hash, the least hashes are taken.
    chance = F.when(F.lit(False), 0.0)
    for y, n in counts.items():
        chance = chance.when(F.col("y") == y, 1.3 * per_class / n + 50 / n)
    narrow = both.filter(F.pmod("h", F.lit(1 << 30)) / (1 << 30) < chance).select("y", "h", "__id").limit(8 * per_class + 1000).collect()
    taken = [r for y in sorted(counts) for r in sorted([r for r in narrow if r.y == y], key=lambda r: (r.h, r["__id"]))[:per_class]]
    if not taken:
        return [], counts
    ids = docs.sparkSession.createDataFrame([(r["__id"], r.y, r.h) for r in taken], both.select("__id", "y", "h").schema)
    texts = usable.select(F.col(key).alias("__id"), view.alias("t")).join(F.broadcast(ids.distinct()), "__id")
    rows = texts.limit(4 * per_class + 1000).collect()
    return [(r.t, r.y) for r in sorted(rows, key=lambda r: (r.y, r.h, r.t))], counts


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the texts; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces of about ``limit`` bytes of ``column``."""
    for batch in batches:
        _, off = bytes_of(batch.column(column))
        start, n = 0, batch.num_rows
        while start < n:
            end = int(np.searchsorted(off, off[start] + limit, "right")) - 1
            end = min(n, max(start + 1, end))
            yield batch.slice(start, end - start)
            start = end


# ---------------------------------------------------------------- word hashes
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for b in (_BASE, _INVERSE):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            np.multiply.accumulate(t, out=t)
            tables.append(t)
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


HASH_BLOCK = 1 << 20  #: bytes that are hashed at once; blocks end at white space


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, spans: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the white-space separated words of many texts.

    Returns ``(hashes, word_offsets)``: text ``i`` has the hashes
    ``hashes[word_offsets[i]:word_offsets[i + 1]]``.  A polynomial prefix sum
    modulo 2**64 gives all words in a few passes over the bytes.  White
    space is ASCII only; with ``lower`` A-Z are folded first, with ``spans``
    the first byte and the end of every word follow.
    """
    n = len(data)
    cuts = [0]
    while n - cuts[-1] > HASH_BLOCK:
        at = cuts[-1] + HASH_BLOCK
        while at < n and not len(found := np.flatnonzero(_IS_SPACE[data[at : at + HASH_BLOCK]])):
            at += HASH_BLOCK
        if at >= n:
            break
        cuts.append(at + int(found[0]))
    parts = []
    for a, b in zip(cuts, [*cuts[1:], n]):
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        hashes, start, end = _hash_block(_LOWER[data[a:b]] if lower else data[a:b], inner)
        parts.append((hashes, start + a, end + a))
    hashes, start, end = (np.concatenate(c) for c in zip(*parts))
    return hashes, np.searchsorted(start, offsets, "left"), *((start, end) if spans else ())


def _hash_block(data: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of the words of a block; texts also part at ``inner``."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    word = ~_IS_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[inner] = word[inner]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64)), start, end


_STEP = [np.uint64(c) for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words of one text.

    A text of one to ``width - 1`` words has a single shingle of all its
    words; a text without words has none.
    """
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    runs = max(1, n - width + 1)
    total = np.full(runs, np.uint64(min(n, width)))
    for k in range(min(n, width)):
        total = total + hashes[k : k + runs] * _STEP[k]
    return np.unique(mix(total))
