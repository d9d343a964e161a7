"""Phrase collocations by Toivonen's sampling.

A phrase of ``LONGEST`` words or fewer is frequent in a language when it
occurs ``LEAST`` times; parts of frequent phrases are frequent.

1. A sample of the documents is mined level by level with a lowered
   threshold.  What it proposes is held as bits of a filter for each level,
   whose size has a bound: a full filter lets more phrases be counted, it
   never loses one.
2. One pass over all documents counts all words and exactly each proposed
   phrase.  In the same pass it counts the negative border, which need not be
   written down: phrases that are not proposed while their two parts of one
   word less are.  Borders are wide, so theirs are counted under a hash of
   at least 33 bits, a quarter of the bytes: no phrase occurs more often than
   its hash.
3. A word that proves frequent but was not proposed, and a phrase of the border
   whose hash reaches the threshold, are failures of the border.  They join
   the filters, and an expansion pass counts exactly the failures and what
   they admit.  What is admitted counts as proposed for the phrases one word
   longer at once, so the pass climbs to the longest phrases and closes the
   border: every part of a frequent phrase is frequent, so it was proposed or
   failed and is in a filter now, or it is admitted.

Counts travel as 64-bit hashes of words; a vocabulary in which two words of a
language share one is counted again with another seed.  Counts are added up in
each task and dealt by phrase into buckets, which Spark shuffles as compressed
arrays, so a word of a third of the corpus costs an entry for each task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, bytes_of, mix
from .hotjoin import join_hot
from .scratch import Scratch
from .spans import FOLD, byte_class, span_hashes, word_spans

LEAST = 30
LONGEST = 4
COVERED = 80  #: percent of its occurrences that lie in a longer candidate drop a candidate
TOP = 2000
SCALE = 2_000_000
SAMPLE = 10  #: one document in so many is in the sample
MISS = 0.2  #: the sample may miss a phrase of exactly ``LEAST`` occurrences with this chance
MAX_BITS = 27  #: 16 MB for each level
SLICE = 1 << 20  #: bytes of texts that are cut into words at once
BLOCK = 1 << 16  #: words that are counted at once
HELD = 1 << 20  #: distinct phrases that a task holds
BUCKET_BYTES = 4 << 20  #: texts whose phrases one bucket counts, as the sample lets expect
MOST_BUCKET_BITS = 20
KEY_BITS = 32  #: of the hash under which the border is counted, besides its bucket
NOBODY = "und"

_ENDS = byte_class((0x0A, 0x0D))
_ENDS[[ord(c) for c in ".,;:!?"]] = True
_INSIDE = ~(_ENDS | byte_class((0x20, 0x20), (0x09, 0x09)))
_TURN = np.uint64(0x9E3779B97F4A7C15)
_WORDS = ["w1", "w2", "w3", "w4"]
_KEY = ["lang", *_WORDS]
_ROWS = "k int, lang string, w1 long, w2 long, w3 long, w4 long, text string, c long"
#: some counted phrases of a level and a bucket, column by column
_PARCELS = "bucket int, k int, langs array<string>, n int, numbers binary, texts binary, text_bytes int"
_PARCEL = ["bucket", "k", "langs", "n", "numbers", "texts", "text_bytes"]
_BYTES, _CLASH = -1, -2  #: levels of rows that hold the bytes of texts, or two words with one hash
_BORDER = 10  #: border hashes of phrases of k words have level 10 + k; the hash stands for the first word



def lowered(least: int = LEAST, share: float = 1 / SAMPLE, miss: float = MISS) -> int:
    """The greatest threshold in the sample that misses a phrase of ``least`` occurrences with chance ``miss`` at most."""
    below, t = 0.0, 0
    while True:
        below += math.comb(least, t) * share**t * (1 - share) ** (least - t)
        if below > miss:
            return max(1, t)
        t += 1


# --------------------------------------------------------------------- filters
@dataclass
class Filters:
    """For each level a bitmap of phrase hashes, two bits a phrase."""

    bits: int
    maps: dict[int, np.ndarray] = field(default_factory=dict)

    def places(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        return p & mask, (p >> np.uint64(self.bits)) & mask

    def has(self, level: int, p: np.ndarray) -> np.ndarray:
        if level not in self.maps:
            return np.zeros(len(p), bool)
        out = np.ones(len(p), bool)
        for at in self.places(p):
            out &= (self.maps[level][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def joined(self, more: "Filters") -> "Filters":
        maps = dict(self.maps)
        for level, bitmap in more.maps.items():
            maps[level] = maps[level] | bitmap if level in maps else bitmap
        return Filters(self.bits, maps)


def _salt(lang: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), seed)


def _one(words: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Hashes of single words of languages."""
    return mix(words ^ salt)


def _more(front: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on with a word."""
    return mix(front * _TURN + word)


def _phrase_hashes(rows: pa.RecordBatch, seed: int) -> np.ndarray:
    """Hashes of the phrases of counted rows."""
    k = rows.column("k").to_numpy()
    langs = rows.column("lang").dictionary_encode()
    salts = np.array([_salt(v, seed) for v in langs.dictionary.to_pylist()], np.uint64)
    words = [rows.column(w).to_numpy().view(np.uint64) for w in _WORDS]
    p = _one(words[0], salts[langs.indices.to_numpy()])
    for i in range(1, LONGEST):
        p = np.where(k > i, _more(p, words[i]), p)
    return np.where(k > _BORDER, mix(words[0]), p)


def _build(phrases: DataFrame, bits: int, seed: int, known: Filters | None = None) -> Filters:
    """Bitmaps of the phrases of counted rows, of those that ``known`` lacks where it is given.

    What reaches the driver is bitmaps: ``2**bits`` bits for each level at most.
    """
    spark = phrases.sparkSession
    shared = spark.sparkContext.broadcast(known)
    empty = Filters(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for rows in batches:
            k, p = rows.column("k").to_numpy(), _phrase_hashes(rows, seed)
            for level in np.unique(k):
                own = p[k == level]
                if have is not None:
                    own = own[~have.has(int(level), own)]
                at = np.concatenate(empty.places(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level, np.int32)), pa.array(at + 1)], names=["k", "at"])

    rows = phrases.mapInArrow(run, "k int, at long")
    maps = rows.groupBy("k", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    out = Filters(bits)
    for r in maps.toLocalIterator():
        own = out.maps.setdefault(r.k, np.zeros(1 << max(bits - 3, 12), np.uint8))
        own[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bitmap, np.uint8)
    return out


# -------------------------------------------------------------------- counting
def _taken(columns: list, rows: np.ndarray) -> list:
    return [c.take(rows) if isinstance(c, np.ndarray) else c.take(pa.array(rows)) for c in columns]


def _add_up(p: np.ndarray, columns: list, counts: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """One row for each distinct ``(p, *columns)``; ``columns`` are numbers that decide ``p``, or an Arrow array of what comes along."""
    order = np.argsort(p, kind="stable")
    p, columns, counts = p[order], _taken(columns, order), counts[order]
    new = np.ones(len(p), bool)
    new[1:] = p[1:] != p[:-1]
    numbers = [c for c in columns if isinstance(c, np.ndarray)]
    changed = np.zeros(len(p), bool)
    if numbers:
        changed[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in numbers])
    if (changed & ~new).any():  # two phrases share a hash: order by the phrases themselves
        order = np.lexsort(numbers)
        p, columns, counts = p[order], _taken(columns, order), counts[order]
        numbers = [c for c in columns if isinstance(c, np.ndarray)]
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in numbers])
    first = np.flatnonzero(new)
    return p[first], _taken(columns, first), np.add.reduceat(counts, first) if len(first) else counts


class _Held:
    """The phrases of a level that a task has counted so far."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, list, np.ndarray]] = []

    @property
    def rows(self) -> int:
        """Phrases, long texts counted as more."""
        return sum(len(p) + sum(c.nbytes for c in columns if not isinstance(c, np.ndarray)) // 32 for p, columns, _ in self.parts)

    def add(self, p: np.ndarray, columns: list, counts: np.ndarray) -> None:
        self.parts.append((p, columns, counts))

    def merged(self) -> tuple[np.ndarray, list, np.ndarray]:
        if len(self.parts) > 1:
            p = np.concatenate([x[0] for x in self.parts])
            columns = [np.concatenate(c) if isinstance(c[0], np.ndarray) else pa.concat_arrays(c) for c in zip(*[x[1] for x in self.parts])]
            self.parts = [_add_up(p, columns, np.concatenate([x[2] for x in self.parts]))]
        return self.parts[0]


@dataclass
class Task:
    """What a pass counts."""

    levels: tuple[int, ...]  # 0: all words of a language
    seed: int
    filters: Filters | None = None  # what is proposed
    border: bool = False  # what is not proposed is counted by hash
    failed: Filters | None = None  # in an expansion pass: what failed; only this and what it admits is counted
    bucket_bits: int = 1

    def border_hash(self, p: np.ndarray) -> np.ndarray:
        return p >> np.uint64(64 - KEY_BITS - self.bucket_bits)


def _packed(columns: list[np.ndarray]) -> bytes:
    raw = b"".join(c.tobytes() for c in columns)
    return pa.compress(raw, codec="zstd", asbytes=True) if len(raw) > 256 else raw


def _unpacked(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True) if size > 256 else raw


def _planes(keys: np.ndarray) -> np.ndarray:
    """The bytes of border keys, place by place."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].T)


def _keys(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : KEY_BITS // 8] = planes.T
    return out.view("<u8").reshape(-1)


def _parcels(task: Task, names: list[str], k: int, p: np.ndarray, columns: list, counts: np.ndarray) -> Iterator[tuple]:
    """Counts of a level, sorted by hash -> a row for each bucket."""
    if k > _BORDER:
        bucket = p >> np.uint64(KEY_BITS)
    else:
        bucket = p >> np.uint64(64 - task.bucket_bits)
        if k > 1:  # equal first words side by side
            order = np.argsort((bucket << np.uint64(64 - task.bucket_bits)) | (columns[1] >> np.uint64(task.bucket_bits)))
            bucket, counts, columns = bucket[order], counts[order], _taken(columns, order)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        head, texts, langs = (int(bucket[a]), k), None, None
        if k > _BORDER:
            numbers = [_planes(p[a:b] & np.uint64((1 << KEY_BITS) - 1))]
        else:
            used, code = np.unique(columns[0][a:b], return_inverse=True)
            langs = [names[c] for c in used]
            numbers = [code.astype(np.int64), *(c[a:b] for c in columns[1 : 1 + k] if k > 1)]
            texts = "\n".join(columns[-1][a:b].to_pylist()).encode() if k == 1 else None  # no word holds a line feed
        yield (*head, langs, b - a, _packed([*numbers, counts[a:b]]), None if texts is None else pa.compress(texts, codec="zstd", asbytes=True), len(texts or b""))


def _counter(shared):
    """Rows (lang, text) -> parcels of a task's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task: Task = shared.value
        names: list[str] = []
        code_of: dict[str, int] = {}
        held: dict[int, _Held] = {}
        totals: dict[int, int] = {}
        size = 0

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_PARCEL)

        def emptied(k: int) -> Iterator[pa.RecordBatch]:
            rows = []
            for row in _parcels(task, names, k, *held.pop(k).merged()):
                rows.append(row)
                if len(rows) == 1000:
                    yield sent(rows)
                    rows = []
            if rows:
                yield sent(rows)

        for part in byte_slices(batches, "text", SLICE):
            size += part.column("text").nbytes
            langs = part.column("lang").to_pylist()
            for lang in langs:
                if lang not in code_of:
                    code_of[lang] = len(names)
                    names.append(lang)
            for k, found in _count_slice(part.column("text"), np.array([code_of[v] for v in langs]), names, task, totals):
                held.setdefault(k, _Held()).add(*found)
            if sum(own.rows for own in held.values()) > HELD:
                for own in held.values():
                    own.merged()
                while sum(own.rows for own in held.values()) > HELD // 2:
                    yield from emptied(max(held, key=lambda x: held[x].rows))
        for k in list(held):
            yield from emptied(k)
        if 0 in task.levels and totals:
            yield sent([(0, 0, [names[c]], 1, _packed([np.array([n], np.int64)]), None, 0) for c, n in totals.items()])
        if _BYTES in task.levels and size:
            yield sent([(0, _BYTES, [""], 1, _packed([np.array([size], np.int64)]), None, 0)])

    return run


class _Bucket:
    """The parcels of a level that meet in a bucket."""

    def __init__(self, bucket: int, k: int, seed: int):
        self.bucket, self.k, self.seed = bucket, k, seed
        self.code_of: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, list, np.ndarray]] = []

    def add(self, langs: list[str], n: int, raw: bytes, texts: bytes | None, text_bytes: int) -> None:
        if self.k > _BORDER:
            flat = np.frombuffer(_unpacked(raw, n * (KEY_BITS // 8 + 8)), np.uint8)
            keys = _keys(flat[: n * (KEY_BITS // 8)].reshape(-1, n))
            p = keys | np.uint64(self.bucket << KEY_BITS)
            self.parts.append((p, [], np.frombuffer(flat[n * (KEY_BITS // 8) :].tobytes(), np.int64)))
            return
        words = 0 if self.k <= 1 else self.k
        columns = 2 + words if self.k > 0 else 1
        numbers = np.frombuffer(_unpacked(raw, 8 * columns * n), np.uint64).reshape(columns, n)
        code = np.array([self.code_of.setdefault(v, len(self.code_of)) for v in langs])
        code = code[numbers[0].astype(np.int64)] if self.k > 0 else np.repeat(code, n)
        of = list(numbers[1 : 1 + words])
        if self.k == 1:
            text = pa.array(pa.decompress(texts, decompressed_size=text_bytes, codec="zstd", asbytes=True).decode().split("\n"), pa.string())
            data, offsets = bytes_of(text)
            of = [span_hashes(data, offsets[:-1], offsets[1:], self.seed), text]
            of[0][of[0] == 0] = 1
        p = of[0] ^ self._salts()[code] if of else code.astype(np.uint64)
        self.parts.append((p, [code, *of], numbers[-1].view(np.int64)))

    def _salts(self) -> np.ndarray:
        return np.array([_salt(v, self.seed) for v in self.code_of], np.uint64)

    def summed(self, least: int) -> pa.RecordBatch | None:
        """The phrases that occur ``least`` times, or the totals."""
        if self.k > _BORDER:
            p, _, counts = _joined(self.parts)
            often = counts >= least
            return self._made([], [p[often]], None, counts[often])
        if self.k == 1:
            return self._words(least)
        p, (code, *words), counts = _joined([(self._phrase(code, words) if words else p, [code, *words], counts) for p, (code, *words), counts in self.parts])
        often = np.flatnonzero(counts >= (least if self.k > 0 else 0))
        names = list(self.code_of)
        return self._made([names[c] for c in code[often]], [w[often] for w in words], None, counts[often])

    def _phrase(self, code: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        p = _one(words[0], self._salts()[code])
        for w in words[1:]:
            p = _more(p, w)
        return p

    def _words(self, least: int) -> pa.RecordBatch | None:
        """Words are compared as texts: two with one hash are a clash."""
        code, word = (np.concatenate([columns[i] for _, columns, _ in self.parts]) for i in (0, 1))
        texts = pa.concat_arrays([columns[2] for _, columns, _ in self.parts]).dictionary_encode()
        key = code.astype(np.uint64) << np.uint64(32) | texts.indices.to_numpy().astype(np.uint64)
        _, (code, word, text), counts = _add_up(key, [code, word, texts.indices], np.concatenate([x[2] for x in self.parts]))
        if len(np.unique(_one(word, self._salts()[code]))) < len(counts):
            return self._made([""], [], None, np.array([1]), _CLASH)
        often = np.flatnonzero(counts >= least)
        names = list(self.code_of)
        return self._made([names[c] for c in code[often]], [word[often]], texts.dictionary.take(text.take(pa.array(often))), counts[often])

    def _made(self, langs: list[str], words: list[np.ndarray], texts: pa.Array | None, counts: np.ndarray, k: int | None = None) -> pa.RecordBatch | None:
        n = len(counts)
        if not n:
            return None
        own = [pa.array(words[i].view(np.int64) if i < len(words) else np.zeros(n, np.int64)) for i in range(LONGEST)]
        level = pa.array(np.full(n, self.k if k is None else k, np.int32))
        own = [level, pa.array(langs or [""] * n, pa.string()), *own, texts if texts is not None else pa.nulls(n, pa.string()), pa.array(counts)]
        return pa.RecordBatch.from_arrays(own, names=["k", "lang", *_WORDS, "text", "c"])


def _joined(parts: list[tuple[np.ndarray, list, np.ndarray]]) -> tuple[np.ndarray, list, np.ndarray]:
    p, counts = (np.concatenate([x[i] for x in parts]) for i in (0, 2))
    return _add_up(p, [np.concatenate(c) for c in zip(*[x[1] for x in parts])], counts)


def _summed(seed: int, least: int):
    """Parcels sorted by bucket and level -> phrases that occur ``least`` times, and the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for bucket, k, *parcel in zip(*(batch.column(c).to_pylist() for c in _PARCEL)):
                if own is None or (own.bucket, own.k) != (bucket, k):
                    if own is not None and (out := own.summed(least)) is not None:
                        yield out
                    own = _Bucket(bucket, k, seed)
                own.add(*parcel)
        if own is not None and (out := own.summed(least)) is not None:
            yield out

    return run


def _count_slice(column: pa.Array, codes: np.ndarray, names: list[str], task: Task, totals: dict[int, int]):
    """(level, (hashes, [language, words..., text], counts)) of the phrases of some texts."""
    data, offsets = bytes_of(column)
    data = FOLD[data]
    start, end, at = word_spans(data, offsets, _INSIDE)
    words = span_hashes(data, start, end, task.seed)
    words[words == 0] = 1
    second = span_hashes(data, start, end, ~task.seed) if 1 in task.levels else words
    code = np.repeat(codes.astype(np.int32), np.diff(at))
    salts = np.array([_salt(v, task.seed) for v in names], np.uint64)
    goes_on = np.zeros(len(words) + 1, bool)  # a word stands in the piece of the one before
    piece = np.searchsorted(np.flatnonzero(_ENDS[data]), start)
    goes_on[1 : len(words)] = piece[1:] == piece[:-1]
    goes_on[at] = False
    if 0 in task.levels:
        for c, n in zip(*np.unique(code, return_counts=True)):
            totals[int(c)] = totals.get(int(c), 0) + int(n)
    deepest = max(task.levels)
    for a in range(0, len(words), BLOCK):
        n = min(BLOCK, len(words) - a)
        b = min(len(words), a + n + deepest - 1)
        w, lang = words[a:b], code[a:b]
        p = _one(w, salts[lang])
        if 1 in task.levels:
            own, (_, word, check, place), counts = _add_up(p[:n], [lang[:n], w[:n], second[a : a + n], pa.array(np.arange(a, a + n))], np.ones(n, np.int64))
            place = place.to_numpy()
            yield 1, (own, [code[place], word, check, _texts(data, start[place], end[place])], counts)
        if deepest < 2:
            continue
        proposed = task.filters.has(1, p)
        inside = proposed if task.failed is None else proposed | task.failed.has(1, p)
        fits = np.ones(len(w), bool)
        for k in range(2, deepest + 1):
            if len(w) < k:
                break
            fits = fits[:-1] & goes_on[a + k - 1 : b]
            p = _more(p[:-1], w[k - 1 :])
            wanted = fits & inside[:-1] & inside[1:]
            before = proposed[:-1] & proposed[1:]  # the full pass has counted it, exactly if it was proposed
            proposed = task.filters.has(k, p)
            if task.failed is not None:
                wanted &= ~before | (~proposed & task.failed.has(_BORDER + k, mix(task.border_hash(p))))
            inside = proposed if task.failed is None else proposed | wanted
            if k not in task.levels:
                continue
            exact = wanted & proposed if task.border else wanted
            rows = np.flatnonzero(exact[:n])
            if len(rows):
                yield k, _add_up(p[rows], [lang[rows], *[w[rows + i] for i in range(k)]], np.ones(len(rows), np.int64))
            rows = np.flatnonzero((wanted & ~exact)[:n])
            if len(rows):
                yield _BORDER + k, _add_up(task.border_hash(p[rows]), [], np.ones(len(rows), np.int64))


def _texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of ranges as an array of texts."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    places = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[places]))


def _counts(texts: DataFrame, task: Task, least: int) -> DataFrame:
    """Counts of what ``task`` asks for, from ``least`` on."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parcels = texts.mapInArrow(_counter(spark.sparkContext.broadcast(task)), _PARCELS)
    dealt = parcels.repartition(parts, "bucket").sortWithinPartitions("bucket", "k")
    return dealt.mapInArrow(_summed(task.seed, least), _ROWS)


def _bucket_bits(spark: SparkSession, size: int) -> int:
    """Buckets for texts of ``size`` bytes, as a power of two."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BUCKET_BITS, max(1, (max(parts, size // BUCKET_BYTES) - 1).bit_length()))


# ---------------------------------------------------------------------- mining
def propose(sample: DataFrame, least: int, seed: int, scratch: Scratch) -> tuple[Filters, int]:
    """Filters of what is frequent in a sample, level by level, and its bytes; the longest phrases need no filter."""
    filters, size = None, 0
    for level in range(1, LONGEST):
        task = Task((level, *((_BYTES,) if level == 1 else ())), seed, filters, bucket_bits=_bucket_bits(sample.sparkSession, size))
        found = scratch.keep(_counts(sample, task, least), "proposed")
        if filters is None:  # room for the levels above, which hold a few phrases for each word
            size = found.filter(F.col("k") == _BYTES).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
            found = found.filter("k > 0")
            bits = min(MAX_BITS, max(15, math.ceil(math.log2(128 * found.count() + 1))))
            filters = Filters(bits)
        filters = filters.joined(_build(found, filters.bits, seed))
    return filters, size


def frequent(texts: DataFrame, sample: DataFrame, least: int = LEAST, lowered_least: int | None = None, seed: int = 0) -> DataFrame:
    """All phrases ``(k, lang, w1..w4, text, c)`` that occur ``least`` times, and rows of level 0 with all words of a language.

    ``texts`` and ``sample`` have the columns ``lang`` and ``text``; the sample
    decides what is counted in which pass, never the result.
    """
    scratch = Scratch(texts.sparkSession)
    filters, size = propose(sample, lowered_least or lowered(least), seed, scratch)
    bucket_bits = _bucket_bits(texts.sparkSession, size * SAMPLE)
    full = _counts(texts, Task((0, *range(1, LONGEST + 1)), seed, filters, True, None, bucket_bits), least)
    counted = scratch.keep(full, "phrases", temporary=False)
    if not counted.filter(F.col("k") == _CLASH).isEmpty():
        scratch.drop()
        return frequent(texts, sample, least, lowered_least, seed + 1)
    found = counted.filter(F.col("k") <= LONGEST)
    failed = _build(counted.filter((F.col("k") == 1) | (F.col("k") > _BORDER)), filters.bits, seed, filters)
    if failed.maps:
        task = Task(tuple(range(2, LONGEST + 1)), seed, filters, False, failed, bucket_bits)
        found = found.unionByName(scratch.keep(_counts(texts, task, least), "phrases-more", temporary=False))
    scratch.drop()
    return found


# --------------------------------------------------------------------- scoring
def _part(first: int, words: int) -> list:
    """The key columns of the phrase of ``words`` words from word ``first`` on; 0 stands behind its end."""
    return [F.col(f"w{first + i}").alias(f"p{i + 1}") if i < words else F.lit(0).cast("long").alias(f"p{i + 1}") for i in range(LONGEST - 1)]


def _exploded(rows: DataFrame, parts: list[tuple[int, list]]) -> DataFrame:
    """A row for each part, of those that apply to phrases of so many words."""
    cells = F.array(*[F.when(F.col("k") == k, F.struct(*columns)) for k, columns in parts])
    return rows.select(*_KEY, "a", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("part")).select(*_KEY, "a", "part.*")


def best_cuts(phrases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Key, ``l, r, score`` of the lowest-scoring cut of each candidate."""
    sides = []
    for k in range(2, LONGEST + 1):
        for cut in range(1, k):
            for side, first, words in ((0, 1, cut), (1, cut + 1, k - cut)):
                sides.append((k, [F.lit(cut).alias("cut"), F.lit(side).alias("side"), *_part(first, words)]))
    rows = _exploded(candidates, sides)
    keys = ["lang", "p1", "p2", "p3"]
    short = phrases.filter(F.col("k") < LONGEST).select("lang", *[F.col(f"w{i}").alias(f"p{i}") for i in range(1, LONGEST)], "c")
    looked = join_hot(rows, short, keys)
    of_side = lambda s: F.sum(F.when(F.col("side") == s, F.col("c")))
    cuts = looked.groupBy(*_KEY, "cut").agg(F.max("a").alias("a"), of_side(0).alias("l"), of_side(1).alias("r"))
    scored = cuts.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(19,0)) * {SCALE}) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"))
    return scored.groupBy(*_KEY).agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select(*_KEY, "best.l", "best.r", "best.score")


def covered(candidates: DataFrame) -> DataFrame:
    """Key and the most occurrences of a longer candidate around it, of the candidates that lie in one."""
    inner = []
    for k in range(3, LONGEST + 1):
        for words in range(2, k):
            inner += [(k, _part(first, words)) for first in range(1, k - words + 2)]
    rows = _exploded(candidates, inner).groupBy("lang", "p1", "p2", "p3").agg(F.max("a").alias("around"))
    return rows.select("lang", *[F.col(f"p{i}").alias(f"w{i}") for i in range(1, LONGEST)], F.lit(0).cast("long").alias(f"w{LONGEST}"), "around")


def _with_texts(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with the column ``phrase``."""
    spelt = rows.select(*_KEY, F.posexplode(F.array(*_WORDS)).alias("at", "w")).filter("w <> 0")
    looked = join_hot(spelt, words.select("lang", F.col("w1").alias("w"), "text"), ["lang", "w"])
    texts = [F.max(F.when(F.col("at") == i, F.col("text"))).alias(f"t{i}") for i in range(LONGEST)]
    phrase = F.concat_ws(" ", *[f"t{i}" for i in range(LONGEST)])
    spelt = looked.groupBy(*_KEY).agg(*texts).select(*_KEY, phrase.alias("phrase"))
    return rows.join(spelt, _KEY)


def _leading(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with ``rank``; a large language is narrowed in salted groups first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salts = rows.count() // (16 * top) + 1
    while salts > 1:
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).drop("rank")
        salts //= 16
    by = Window.partitionBy("lang").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", top: int = TOP, least: int = LEAST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the strongest collocations of each language.

    A-Z are folded; texts are parted into pieces at ``.,;:!?`` and line ends
    and these into words at blanks and tabs; phrases of two to ``LONGEST``
    words lie in one piece.  ``a`` counts the phrase, ``n`` all words of the
    language, ``l`` and ``r`` the two parts of the cut that scores least,
    ``score`` is ``floor(2000000 * a / (l + r))``.  A candidate that lies in a
    longer one with ``COVERED`` percent of its occurrences is dropped.  Ties go
    to more occurrences, then to the phrase in byte order.  A NULL language
    is ``und``; NULL texts are empty; an empty table, or one without frequent
    phrases, gives no rows.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NOBODY)).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.xxhash64(F.col(key).cast("string"), F.lit(11)).alias("h"),
    )
    found = frequent(texts.select("lang", "text"), texts.filter(F.pmod("h", F.lit(SAMPLE)) == 0).select("lang", "text"), least)
    phrases = scratch.keep(found, "phrases-all", temporary=False)
    candidates = phrases.filter("k > 1").select("k", *_KEY, F.col("c").alias("a"))
    inside = F.coalesce(F.lit(100) * F.col("around") >= F.lit(COVERED) * F.col("a"), F.lit(False))
    kept = candidates.join(covered(candidates).hint("merge"), _KEY, "left").filter(~inside).drop("around")
    kept = scratch.keep(kept, "collocations")
    scored = scratch.keep(kept.drop("k").join(best_cuts(phrases, kept).hint("merge"), _KEY), "collocations-scored")
    spelt = scratch.keep(_with_texts(scored, phrases.filter("k = 1")).drop(*_WORDS), "collocations-spelt")
    first = scratch.keep(_leading(spelt, top), "collocations-first", temporary=False)
    scratch.drop()
    totals = phrases.filter("k = 0").select("lang", F.col("c").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
