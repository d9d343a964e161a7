"""SimHash near-deduplication with bit-sliced comparison.

1. A text's fingerprint has a bit for each bit of the 64-bit hashes of its
   three-word shingles that is set in over half of them, repeats included.
   Equal fingerprints are one class from here on.
2. Two fingerprints within ``RADIUS`` bits agree in one of ``RADIUS + 1``
   bands of 16 bits at least, so classes are compared where a band agrees.
   There are 4 x 65,536 buckets; one of more than ``BLOCK`` classes is dealt
   into blocks, and each pair of blocks is a group of its own.
3. Groups are compared in bit slices.  The fingerprints of a group lie
   vertically: word ``w`` of plane ``p`` has bit ``p`` of 64 fingerprints.  A
   fingerprint against such a word is one exclusive or for each plane; the
   64 distances are carried along in two words of carry-save counters and a
   word that notes what has passed the radius.  Words in which all have are
   abandoned as the planes go by.
4. A group gives a forest of its links, not the pairs; the components of all
   forests are found by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_path
from .common import byte_slices, bytes_of
from .components import components
from .hotjoin import join_hot
from .spans import FOLD, byte_class, word_spans

WIDTH = 3
SEED = 42
RADIUS = 3
BANDS = RADIUS + 1
BAND_BITS = 64 // BANDS
BLOCK = 4096  #: classes of a block of a large bucket
CHUNK = 1 << 16  #: words of 64 comparisons that are under way at once
ROWS = 1 << 16  #: classes whose groups are compared together
TEXT_BLOCK = 1 << 20  #: bytes of shingles that are hashed at once

_WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


# ---------------------------------------------------------------- fingerprints
def _shingle_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """XXH64 of the words ``first`` to ``last``, joined by single blanks; these words lie in one text."""
    lo, hi = int(start[first[0]]), int(end[last].max())
    own = data[lo:hi]
    word = _WORD[own]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first white space after a word stays, as a blank
    text = np.where(word, own, np.uint8(0x20))[keep].tobytes()
    place = np.cumsum(keep) - 1
    a, b = place[start[first] - lo].tolist(), (place[end[last] - 1 - lo] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))


def fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of every text, unsigned."""
    data, offsets = bytes_of(column)
    data = FOLD[data]
    start, end, at = word_spans(data, offsets, _WORD)
    words = np.diff(at)
    total = np.where(words > 0, np.maximum(words - WIDTH + 1, 1), 0)
    ones = np.zeros((len(words), 64), np.int64)
    text = np.repeat(np.arange(len(words)), total)
    before = np.cumsum(total) - total
    first = at[:-1][text] + np.arange(len(text)) - before[text]
    last = first + np.minimum(words, WIDTH)[text] - 1
    k = 0
    while k < len(first):
        j = int(np.searchsorted(start[first], start[first[k]] + TEXT_BLOCK, "left"))
        hashes = _shingle_hashes(data, start, end, first[k:j], last[k:j])
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = text[k:j]
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
        k = j
    set_bits = 2 * ones > total[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in byte_slices(batches, "text"):
        fp = fingerprints(part.column("text")).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])


# ------------------------------------------------------------------ comparison
def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of ``a`` and ``b`` in ``label``, in which every member points to the least of its tree."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _near(fp: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, over: np.ndarray, order: list[int], radius: int) -> tuple[np.ndarray, ...]:
    """Cells (query, word) -> those with a lane within the radius, and their lanes.

    ``over`` has a bit set for each lane that does not count from the start.
    """
    bits = max(1, int(radius).bit_length())
    start = (1 << bits) - 1 - radius  # so that the counter runs over at ``radius + 1``
    counter = [np.full(len(query), _ALL if start >> i & 1 else np.uint64(0)) for i in range(bits)]
    for done, p in enumerate(order, 1):
        carry = planes[p][word] ^ (np.uint64(0) - ((fp[query] >> np.uint64(p)) & _ONE))
        for i in range(bits):
            carry, counter[i] = counter[i] & carry, counter[i] ^ carry
        over = over | carry
        if done % 8 == 0:
            live = over != _ALL
            n = int(live.sum())
            if not n:
                break
            if n < 0.7 * len(live):  # the rest of the block is abandoned
                query, word, over, counter = query[live], word[live], over[live], [c[live] for c in counter]
    live = np.flatnonzero(over != _ALL)
    lanes = np.unpackbits((~over[live]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cell, lane = np.nonzero(lanes)
    return query[live][cell], word[live][cell], lane


def forests(fp: np.ndarray, bounds: np.ndarray, other: np.ndarray, skip: tuple[int, int] = (0, 0), radius: int = RADIUS) -> np.ndarray:
    """The least member of the tree of every fingerprint when those within the radius are linked, group by group.

    Group ``g`` is ``fp[bounds[g]:bounds[g + 1]]``.  Where ``other[g]`` is its
    start, all members are compared; else those before ``other[g]`` with
    those from there on.  Planes ``skip[0]`` to ``skip[1] - 1`` agree in every group.
    """
    label = np.arange(len(fp))
    low, high = bounds[:-1], bounds[1:]
    whole = other == low
    words = -(-(high - other) // 64)
    base = np.cumsum(words) - words
    row = np.concatenate([np.arange(a, b) for a, b in zip(other, high)]) if len(low) else np.zeros(0, np.int64)
    nth = row - np.repeat(other, high - other)
    first = np.flatnonzero(nth % 64 == 0)
    head = row[first]  # the row of lane 0 of each word
    lane = (nth % 64).astype(np.uint64)
    order = [p for p in range(64) if not skip[0] <= p < skip[1]]
    planes = np.zeros((64, len(first)), np.uint64)
    for p in order:
        planes[p] = np.bitwise_or.reduceat(((fp[row] >> np.uint64(p)) & _ONE) << lane, first) if len(first) else 0
    group = np.repeat(np.arange(len(low)), np.where(whole, high, other) - low)
    query = np.concatenate([np.arange(a, b) for a, b in zip(low, np.where(whole, high, other))]) if len(low) else row
    # Where all are compared, the words before a member's own have been seen from the other side.
    skipped = np.where(whole[group], (query - low[group]) // 64, 0)
    cells = words[group] - skipped
    ends = np.cumsum(cells)
    k = 0
    while k < len(query):
        j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CHUNK, "right")))
        of = np.repeat(np.arange(k, j), cells[k:j])
        nth_word = np.arange(len(of)) - np.repeat(np.cumsum(cells[k:j]) - cells[k:j], cells[k:j]) + skipped[of]
        g = group[of]
        word = base[g] + nth_word
        mine = np.where(whole[g], query[of] - low[g] - 64 * nth_word, -1)  # lanes up to this one do not count
        least = np.clip(mine + 1, 0, 63).astype(np.uint64)
        over = np.where(mine >= 63, _ALL, (_ONE << least) - _ONE)
        held = high[g] - other[g] - 64 * nth_word
        over |= np.where(held >= 64, np.uint64(0), ~((_ONE << np.clip(held, 0, 63).astype(np.uint64)) - _ONE))
        q, w, at = _near(fp, planes, query[of], word, over, order, radius)
        _union(label, q, head[w] + at)
        k = j
    return label


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, key, bi, bj, b, fp) sorted by all but the last -> edges between near fingerprints."""
    names = ["band", "key", "bi", "bj"]

    def edges(own: pa.Table) -> pa.RecordBatch | None:
        columns = [own.column(c).to_numpy() for c in names]
        change = np.ones(own.num_rows, bool)
        change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        low = np.flatnonzero(change)
        bounds = np.append(low, own.num_rows)
        band, _, bi, bj = columns
        before = np.concatenate([[0], np.cumsum(own.column("b").to_numpy() == bi)])
        other = np.where(bi[low] == bj[low], low, low + before[bounds[1:]] - before[low])
        fp = own.column("fp").to_numpy()
        skip = (int(band[0]) * BAND_BITS, (int(band[0]) + 1) * BAND_BITS) if band[0] == band[-1] else (0, 0)
        label = forests(fp.view(np.uint64), bounds, other, skip)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        own = pa.Table.from_batches(held).combine_chunks()
        # The last group may go on in the next batch.
        same = np.logical_and.reduce([c == c[-1] for c in (own.column(n).to_numpy() for n in names)])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield edges(own.slice(0, cut))
        held = own.slice(cut).to_batches()
        rows = own.num_rows - cut
    if held:
        yield edges(pa.Table.from_batches(held).combine_chunks())


def near_edges(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges ``u, v`` between the distinct fingerprints ``fp`` of ``classes`` whose components hold all links."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mask = F.lit((1 << BAND_BITS) - 1)
    bands = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", i * BAND_BITS).bitwiseAND(mask).cast("int").alias("key")) for i in range(BANDS)]
    rows = classes.select("fp", F.inline(F.array(*bands)))
    # One row for each bucket of two classes and more: 4 x 65,536 at most.
    held = rows.groupBy("band", "key").agg(F.count("*").alias("held")).filter("held > 1")
    blocks = F.ceil(F.col("held") / block).cast("int")
    dealt = rows.join(F.broadcast(held), ["band", "key"]).withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = dealt.select("band", "key", "fp", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    cells = cells.select("band", "key", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "b", "fp")
    keys = ["band", "key", "bi", "bj"]
    return cells.repartition(parts, *keys).sortWithinPartitions(*keys, "b").mapInArrow(_compare, "u long, v long")


# -------------------------------------------------------------------- operator
def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest
    id of the rows that can be reached over fingerprints of at most ``RADIUS``
    differing bits, the row itself included.  A-Z are folded; words are parted
    by ASCII white space; a text of one or two words has one shingle of all
    of them, one without words and a NULL text have the fingerprint zero,
    which links like any other.  A NULL id is no candidate for
    ``component_id``, which is NULL where no row that is reached has an id.
    Repeated rows come back as often; other columns are not looked at.
    """
    spark = docs.sparkSession
    made: list[str] = []

    def stored(rows: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        rows.write.parquet(path)
        made.append(path)
        return spark.read.schema(rows.schema).parquet(path)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = stored(rows.mapInArrow(_fingerprint_rows, "doc_id long, fp long"), "simhash")
    classes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    edges = stored(near_edges(classes, block), "simhash-links")
    labels = components(edges).withColumnRenamed("node", "fp")
    labelled = stored(classes.join(labels.hint("merge"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "simhash-labels")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    least = stored(least, "simhash-components")
    of_class = stored(join_hot(labelled.drop("n"), least.drop("n"), ["label"], counts=least.select("label", "n")).select("fp", "component_id"), "simhash-classes-labelled")
    out = join_hot(found, of_class, ["fp"], counts=classes.select("fp", "n"))
    for path in made[2:5]:  # the others are read when the result is
        drop_scratch(spark, path)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
