"""Language-model scoring with an Elias-Fano n-gram trie.

Counting.  Tokens are counted over all training documents: in each task on
sorted arrays, then in a shuffle of partial counts.  Every word is in the
first level of the trie, and every longer n-gram that occurs ``KEPT`` times is
in the level of its length, whatever the size of the corpus.  Such an n-gram's
context and suffix occur as often at least, so an n-gram is counted only where
both are found in the levels before; nothing is lost by that.

Smoothing.  Absolute discounting, interpolated down to add-one-half unigrams:
``p(w | c) = (n(cw) - D) / n(c) + b(c) * p(w | shorter c)`` for kept n-grams and
``b(c) * p(w | shorter c)`` for others, ``b(c)`` being what the discounts leave.

The trie.  Each level is a set of files in the shared scratch folder, one for
each range of keys.  The first has the sorted word hashes and the running
counts, both Elias-Fano coded.  Each other level has the sorted contexts, the
monotone pointers to their children and the children (context by context, made
monotone by the context's place), with probabilities and back-off weights in
16 bits: 1/4096 of a decimal log, rounded down, so that no distribution sums
to more than one.  An n-gram's number is its place in its level; contexts are
numbers of the level before, words numbers of the first.  Workers map the files
into memory, in training and in scoring; nothing of the trie travels but the
first key and the size of each file.

A child is looked for by a successor search between its context's pointers.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import byte_slices, bytes_of, mix, word_hashes
from .eliasfano import EliasFano, mapped

ORDER = 3
KEPT = 2  #: an n-gram of two or more words is in the trie when it occurs so often
DISCOUNT = 0.75
UNIT = 4096  #: quantised steps in a decimal log
SLICE_BYTES = 4 << 20
SHARD_WORDS = 1 << 21  #: n-grams of a file of a level
STEP = 1 << 17  #: n-grams that are looked up or sent at once while counts go out and files are written
_FLIP = np.uint64(1 << 63)
_END = int(mix(np.array([0xE4D], np.uint64)).view(np.int64)[0])


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (signed) of texts, the end of each included, and where each text starts."""
    hashes, at = word_hashes(*bytes_of(column), lower=True)
    n = len(at) - 1
    out = np.full(len(hashes) + n, _END, np.int64)
    words = np.ones(len(out), bool)
    words[at[1:] + np.arange(n)] = False
    out[words] = hashes.view(np.int64)
    return out, at + np.arange(n + 1)


def posix_folder(spark: SparkSession, label: str) -> str:
    """A folder below the session's shared scratch folder that every worker can map files from."""
    path = scratch_path(spark, label)
    scheme, _, rest = path.partition(":") if path.split("/")[0].endswith(":") else ("", "", path)
    if scheme not in ("", "file"):
        raise ValueError(f"the trie is memory-mapped: spark.checkpoint.dir must be a mounted folder, not {scheme}:")
    folder = "/" + rest.lstrip("/")
    os.makedirs(folder, exist_ok=True)
    return folder


def _quantise(log10: np.ndarray) -> np.ndarray:
    """Steps below zero; rounded towards smaller probabilities."""
    return np.minimum(np.ceil(-log10 * UNIT - 1e-9), 65535).astype(np.uint16)


# ------------------------------------------------------------------- counting
def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal sorted keys start."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs; ``keys`` is emptied. A sort of the keys alone is several times faster than one of their places."""
    joined = np.concatenate(keys)
    keys.clear()
    joined.sort()
    first = _runs(joined)
    return joined[first], np.diff(first, append=len(joined))


def _emit(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Add up (key, count) of equal keys."""
    if len(parts) == 1:
        return parts[0]
    keys, counts = (np.concatenate(c) for c in zip(*parts))
    parts.clear()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    del order
    first = _runs(keys)
    return keys[first], np.add.reduceat(counts, first)


def _sent(counted: tuple[np.ndarray, np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Keys and counts in small batches: Spark holds a whole batch beside its heap."""
    for a in range(0, len(counted[0]), STEP):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + STEP]) for c in counted], names=names)


def _partial_counts(names: list[str], occurrences, limit: int = 1 << 21):
    """Batches of texts -> counts that one task adds up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        raw: list[np.ndarray] = []
        held = 0
        for part in byte_slices(batches, "text", SLICE_BYTES):
            raw.append(occurrences(*tokens(part.column("text"))))
            held += len(raw[-1])
            if held > limit:
                parts.append(_counted(raw))
                parts = [_emit(parts)]
                held = len(parts[0][0])
                if held > limit // 2:
                    yield from _sent(parts.pop(), names)
                    held = 0
        if raw:
            parts.append(_counted(raw))
        if held:
            yield from _sent(_emit(parts), names)

    return run


def _words(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return hashes


# ---------------------------------------------------------------------- model
@dataclass
class Model:
    """Where the trie lies, and what workers hold of it: a key and a number for each file."""

    folder: str
    train_tokens: int
    distinct: int
    bounds: list[np.ndarray] = field(default_factory=list)  # of each level, the first key of each file
    bases: list[np.ndarray] = field(default_factory=list)  # of each level, the number of each file's first n-gram, and of all

    @property
    def width(self) -> int:
        return max(1, self.distinct)

    def word_log(self, count: np.ndarray) -> np.ndarray:
        """Add-one-half log10 probability of words that occur ``count`` times."""
        return np.log10((count + 0.5) / (self.train_tokens + 0.5 * (self.distinct + 1)))


def _before(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What stands at the token before; -1 where a text starts."""
    out = np.concatenate([[-1], numbers[:-1]])
    out[at[:-1]] = -1  # every text has a token, its end
    return out


class Trie:
    """The memory-mapped levels of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.files: dict[tuple[int, int], dict] = {}

    def _file(self, level: int, k: int) -> dict:
        if (level, k) not in self.files:
            folder = os.path.join(self.model.folder, f"level{level}-{k}")
            names = ("hashes", "counts") if level == 1 else ("contexts", "pointers", "children")
            parts = {n: EliasFano.open(folder, n) for n in names}
            if level > 1:
                arrays = [n for n in ("prob", "back", "n", "lp") if os.path.exists(os.path.join(folder, f"{n}.npy"))]
                parts |= {n: mapped(folder, n) for n in arrays}
            self.files[level, k] = parts
        return self.files[level, k]

    def _split(self, level: int, of: np.ndarray) -> Iterator[tuple[int, dict, np.ndarray]]:
        n = len(self.model.bounds[level - 1])
        order = np.arange(len(of)) if n == 1 or not np.any(of[1:] < of[:-1]) else np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(n + 1))
        for k in range(n):
            if cut[k] < cut[k + 1]:
                yield int(self.model.bases[level - 1][k]), self._file(level, k), order[cut[k] : cut[k + 1]]

    def _each_file(self, level: int, keys: np.ndarray) -> Iterator[tuple[int, dict, np.ndarray]]:
        """(base, file, places in ``keys``) for the files that may hold these keys."""
        return self._split(level, np.searchsorted(self.model.bounds[level - 1], keys, "right") - 1)

    def _numbered(self, level: int, numbers: np.ndarray) -> Iterator[tuple[int, dict, np.ndarray]]:
        """(base, file, places in ``numbers``) for the files that hold the n-grams of these numbers."""
        return self._split(level, np.searchsorted(self.model.bases[level - 1], numbers, "right") - 1)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of words, 0 for unknown ones, and their numbers, -1 for those below ``KEPT``."""
        out, number = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1)
        keys = hashes.view(np.uint64) ^ _FLIP
        for base, file, rows in self._each_file(1, keys):
            p = file["hashes"].find(keys[rows])
            known = p >= 0
            out[rows[known]] = _word_counts(file, p[known])
            number[rows[known]] = base + p[known]
        return out, np.where(out >= KEPT, number, -1)

    def _contexts(self, level: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct contexts: the base of the last file that has children of theirs (-1: none), place there, and where its children lie."""
        at, place, lo, hi = (np.full(len(own), -1) for _ in range(4))
        width = np.uint64(self.model.width)
        # The file that starts last, not behind a context's last possible child, has the context if any has.
        for base, file, rows in self._each_file(level, own.astype(np.uint64) * width + (width - np.uint64(1))):
            c = file["contexts"].find(own[rows].astype(np.uint64))
            rows, c = rows[c >= 0], c[c >= 0]
            at[rows], place[rows] = base, c
            lo[rows], hi[rows] = _children(file, c)
        return at, place, lo, hi

    def _places(self, level: int, context: np.ndarray, word: np.ndarray, of: np.ndarray, known: tuple[np.ndarray, ...]) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray]]:
        """(base, file, rows, places) of the n-grams that are there; ``known`` are ``_contexts`` and ``of`` which of them a row has."""
        width = np.uint64(self.model.width)
        at, place, lo, hi = known
        there = np.flatnonzero(at[of] >= 0)
        for base, file, rows in self._each_file(level, context[there].astype(np.uint64) * width + word[there].astype(np.uint64)):
            rows = there[rows]
            own = of[rows]
            c, a, b = place[own], lo[own], hi[own]
            other = np.flatnonzero(at[own] != base)  # children of a context that goes on in a later file
            c[other] = file["contexts"].find(context[rows[other]].astype(np.uint64))
            other = other[c[other] >= 0]
            a[other], b[other] = _children(file, c[other])
            rows, a, b, c = (x[c >= 0] for x in (rows, a, b, c))
            child = file["children"].find(c.astype(np.uint64) * width + word[rows].astype(np.uint64), a, b)
            yield base, file, rows[child >= 0], child[child >= 0]

    def numbers(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams of contexts and words; -1 for those not kept."""
        out = np.full(len(context), -1)
        own, of = _distinct(context)
        for base, _, rows, place in self._places(level, context, word, of, self._contexts(level, own)):
            out[rows] = base + place
        return out

    def continuation(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(quantised probability or -1, quantised back-off, number or -1) of words after contexts; a word may be -1."""
        prob, number = np.full(len(context), -1), np.full(len(context), -1)
        own, of = _distinct(context)
        known = self._contexts(level, own)
        left = np.zeros(len(own), np.int64)
        for k, base in enumerate(self.model.bases[level - 1][:-1]):
            rows = np.flatnonzero(known[0] == base)
            if len(rows):
                left[rows] = self._file(level, k)["back"][known[1][rows]]
        asked = np.flatnonzero(word >= 0)
        for base, file, rows, place in self._places(level, context[asked], word[asked], of[asked], known):
            prob[asked[rows]] = file["prob"][place]
            number[asked[rows]] = base + place
        return prob, left[of], number

    def facts(self, level: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, log10 probability) of n-grams below the longest, by number."""
        n, lp = np.zeros(len(numbers), np.int64), np.zeros(len(numbers))
        for base, file, rows in self._numbered(level, numbers):
            place = numbers[rows] - base
            if level == 1:
                n[rows] = _word_counts(file, place)
                lp[rows] = self.model.word_log(n[rows])
            else:
                n[rows], lp[rows] = file["n"][place], file["lp"][place]
        return n, lp

    def tails(self, level: int, numbers: np.ndarray) -> np.ndarray:
        """Numbers of n-grams without their first word."""
        context, last = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        for base, file, rows in self._numbered(level, numbers):
            child, width = file["children"].at(numbers[rows] - base), np.uint64(self.model.width)
            context[rows] = file["contexts"].at((child // width).astype(np.int64))
            last[rows] = child % width
        return last if level == 2 else self.numbers(level - 1, self.tails(level - 1, context), last)

    def ends(self, upto: int, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the ``upto``-grams that end at each token; -1 where none is kept."""
        found = numbers
        for level in range(2, upto + 1):
            before = _before(found, at)
            rows = np.flatnonzero((before >= 0) & (numbers >= 0))
            key, place = np.unique(before[rows] * self.model.width + numbers[rows], return_inverse=True)
            found = np.full(len(numbers), -1)
            found[rows] = self.numbers(level, key // self.model.width, key % self.model.width)[place]
        return found

    def grams(self, level: int, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys (context, word) of the n-grams of ``level`` words whose context and suffix are kept, one for each occurrence."""
        distinct, where = np.unique(hashes, return_inverse=True)
        numbers = self.words(distinct)[1][where]
        ends = self.ends(level - 1, numbers, at)
        before = _before(ends, at)
        rows = np.flatnonzero((before >= 0) & (ends >= 0))
        return before[rows] * self.model.width + numbers[rows]

    def score(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, unigram log10 and the model's log10."""
        m = self.model
        distinct, where = np.unique(hashes, return_inverse=True)
        count, number = self.words(distinct)
        numbers = number[where]
        lp = m.word_log(count)[where]
        base = np.add.reduceat(lp, at[:-1]) if len(at) > 1 else np.zeros(0)
        ends = numbers
        for level in range(2, len(m.bounds) + 1):
            before = _before(ends, at)
            rows = np.flatnonzero(before >= 0)
            if not len(rows):
                break
            key, place = np.unique(before[rows] * (m.width + 1) + numbers[rows] + 1, return_inverse=True)
            prob, back, found = (x[place] for x in self.continuation(level, key // (m.width + 1), key % (m.width + 1) - 1))
            lp[rows] = np.where(prob >= 0, -prob / UNIT, lp[rows] - back / UNIT)
            ends = np.full(len(hashes), -1)
            ends[rows] = found
        total = np.add.reduceat(lp, at[:-1]) if len(at) > 1 else np.zeros(0)
        known = np.add.reduceat((count > 0)[where].astype(np.int64), at[:-1]) if len(at) > 1 else np.zeros(0, np.int64)
        return np.diff(at), known, base, total


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and which of them each key is; sorted keys need no sort."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if np.any(keys[1:] < keys[:-1]):
        return np.unique(keys, return_inverse=True)
    return keys[new], np.cumsum(new) - 1


def _children(file: dict, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the children of the contexts at these places start and end."""
    start = np.where(c > 0, file["pointers"].at(np.maximum(c - 1, 0)).astype(np.int64), 0)
    return start, file["pointers"].at(c).astype(np.int64)


def _word_counts(file: dict, place: np.ndarray) -> np.ndarray:
    ends = file["counts"].at(place).astype(np.int64)
    return ends - np.where(place > 0, file["counts"].at(np.maximum(place - 1, 0)).astype(np.int64), 0)


_tries: dict[str, Trie] = {}


def _trie(model: Model) -> Trie:
    """This worker's trie of a model; levels written since are seen."""
    if model.folder not in _tries:
        _tries.clear()
        _tries[model.folder] = Trie(model)
    _tries[model.folder].model = model
    return _tries[model.folder]


def _write_folder(folder: str, name: str, fill) -> None:
    """Fill a folder under another name and move it in place; a task that runs again finds it done."""
    target = os.path.join(folder, name)
    part = f"{target}.{uuid.uuid4().hex}"
    os.makedirs(part)
    fill(part)
    try:
        os.rename(part, target)
    except OSError:
        pass  # another attempt of the same task was first


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    own = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(own) if own else None


def _write_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gather(batches)
        if table is None:
            return
        hashes = table.column("h").to_numpy().view(np.uint64) ^ _FLIP
        name = f"level1-{table.column('part')[0].as_py()}"

        def fill(part: str) -> None:
            EliasFano.build(hashes).save(part, "hashes")
            EliasFano.build(np.cumsum(table.column("c").to_numpy())).save(part, "counts")

        _write_folder(folder, name, fill)
        yield pa.RecordBatch.from_arrays([table.column("part").combine_chunks()[:1], pa.array(hashes[:1].view(np.int64)), pa.array([len(hashes)])], names=["part", "first", "rows"])

    return run


def _write_counts(folder: str, level: int, width: int):
    """Keys and counts of a range; what the discounts take from its first and last context goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (b for b in batches if b.num_rows)
        head = next(own, None)
        if head is None:
            return
        part, first = head.column("part")[0].as_py(), head.column("k")[0].as_py()
        rows, taken = 0, {}  # of the first context and the last one so far

        def fill(target: str) -> None:
            nonlocal rows, taken
            with open(os.path.join(target, "k"), "wb") as keys, open(os.path.join(target, "c"), "wb") as counts:
                for batch in itertools.chain([head], own):
                    k, c = (batch.column(x).to_numpy() for x in ("k", "c"))
                    k.tofile(keys)
                    c.tofile(counts)
                    rows += len(k)
                    p = k // width
                    sums = {e: float((c[p == e] - DISCOUNT).sum()) for e in {first // width, int(p[-1])}}
                    taken = {e: taken.get(e, 0.0) + t for e, t in sums.items()}

        _write_folder(folder, f"counts{level}-{part}", fill)
        columns = [pa.array([part], pa.int32()), pa.array([first]), pa.array([rows]), pa.array([list(taken)], pa.list_(pa.int64())), pa.array([list(taken.values())], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "rows", "edges", "taken"])

    return run


def _stepwise(first: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, first context, behind the last) of pieces of ``n`` n-grams; a piece may end within a context."""
    for a in range(0, n, STEP):
        z = min(n, a + STEP)
        yield a, z, int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, z, "left"))


def _write_children(shared, level: int, edges: dict[int, float], longest: bool):
    """The trie's file of each range of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in batch.column("id").to_pylist():
                trie = _trie(shared.value)
                folder, width = trie.model.folder, trie.model.width
                k, c = (np.asarray(np.memmap(os.path.join(folder, f"counts{level}-{j}", x), np.int64, "r")) for x in "kc")
                first = _runs(k // width)
                contexts = k[first] // width
                taken = np.add.reduceat(c, first) - DISCOUNT * np.diff(first, append=len(k))
                for e in (0, -1):  # these contexts may go on in other files
                    taken[e] = edges[int(contexts[e])]
                children, lp, back = np.empty(len(k), np.uint64), np.empty(len(k)), np.empty(len(contexts), np.uint16)
                for a, z, lo, hi in _stepwise(first, len(k)):
                    nth = np.searchsorted(first[lo:hi], np.arange(a, z), "right") - 1
                    w = k[a:z] % width
                    own = contexts[lo:hi]
                    n, _ = trie.facts(level - 1, own)
                    b = np.maximum((n - taken[lo:hi]) / n, 1e-12)
                    suffix = w if level == 2 else trie.numbers(level - 1, trie.tails(level - 1, own)[nth], w)
                    lp[a:z] = np.log10((c[a:z] - DISCOUNT) / n[nth] + b[nth] * 10.0 ** trie.facts(level - 1, suffix)[1])
                    back[lo:hi] = _quantise(np.log10(b))
                    children[a:z] = (lo + nth).astype(np.uint64) * np.uint64(width) + w.astype(np.uint64)

                def fill(part: str) -> None:
                    EliasFano.build(contexts).save(part, "contexts")
                    EliasFano.build(np.append(first[1:], len(k))).save(part, "pointers")
                    EliasFano.build(children).save(part, "children")
                    np.save(os.path.join(part, "prob.npy"), _quantise(lp))
                    np.save(os.path.join(part, "back.npy"), back)
                    if not longest:
                        np.save(os.path.join(part, "n.npy"), c)
                        np.save(os.path.join(part, "lp.npy"), lp)

                _write_folder(folder, f"level{level}-{j}", fill)
                yield pa.RecordBatch.from_arrays([pa.array([j])], names=["id"])

    return run


def _dealt(partial: DataFrame, key: str) -> DataFrame:
    """Counts by key; tasks have added up their own already, so another table of them before the shuffle would merge next to nothing."""
    return partial.repartition(key)


def _files(rows: DataFrame, parts: int, key: str, write, folder: str, label: str, schema: str = "") -> list:
    """Write one file for each range of keys; files are numbered in order. Returns what was written, in order."""
    ranged = rows.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()).sortWithinPartitions(key)
    made = sorted(ranged.mapInArrow(write, f"part int, first long, rows long{schema}").collect(), key=lambda r: r.part)
    for k, r in enumerate(made):
        if k != r.part:
            os.rename(os.path.join(folder, f"{label}-{r.part}"), os.path.join(folder, f"{label}-{k}"))
    return made


def _add_level(model: Model, made: list) -> None:
    model.bounds.append(np.array([r.first for r in made], np.int64).view(np.uint64))
    model.bases.append(np.cumsum([0, *[r.rows for r in made]]))
    if int(model.bases[-1][-1]) * (model.width + 1) >= 1 << 62:
        raise OverflowError("keys of contexts and words do not fit 62 bits")


def train(docs: DataFrame, learn: Column, text: str = "text", order: int = ORDER) -> Model:
    """Build the trie from the rows of ``docs`` for which ``learn`` holds.

    A NULL text is empty: its only token is the end.  Without training rows
    the model knows no word and is uniform.
    """
    spark = docs.sparkSession
    texts = docs.filter(F.coalesce(learn, F.lit(False))).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    folder = posix_folder(spark, "ngrams")

    def stored(rows: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    partial = texts.mapInArrow(_partial_counts(["h", "c"], _words), "h long, c long")
    counts = stored(_dealt(partial, "h").groupBy("h").agg(F.sum("c").alias("c")), "ngrams-words")
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    model = Model(folder, total, distinct)
    _add_level(model, _files(counts, max(1, -(-distinct // SHARD_WORDS)), "h", _write_words(folder), folder, "level1"))

    for level in range(2, order + 1):
        if not model.bases[-1][-1]:
            break
        shared = spark.sparkContext.broadcast(replace(model, bounds=list(model.bounds), bases=list(model.bases)))

        def grams(hashes: np.ndarray, at: np.ndarray, shared=shared, level=level) -> np.ndarray:
            return _trie(shared.value).grams(level, hashes, at)

        partial = texts.mapInArrow(_partial_counts(["k", "c"], grams), "k long, c long")
        kept = stored(_dealt(partial, "k").groupBy("k").agg(F.sum("c").alias("c")).filter(F.col("c") >= KEPT), f"ngrams-{level}")
        parts = max(1, -(-kept.count() // SHARD_WORDS))
        made = _files(kept, parts, "k", _write_counts(folder, level, model.width), folder, f"counts{level}", ", edges array<long>, taken array<double>")
        edges: dict[int, float] = {}
        for r in made:
            for p, taken in zip(r.edges, r.taken):
                edges[p] = edges.get(p, 0.0) + taken
        if made:
            spark.range(0, len(made), 1, len(made)).mapInArrow(_write_children(shared, level, edges, level == order), "id long").count()
        _add_level(model, made)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    ``base_score`` is the add-one-half unigram log10 probability, ``score``
    the model's; NULL and empty texts are their end token.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in byte_slices(batches, "text", SLICE_BYTES):
            n, known, base, total = _trie(m).score(*tokens(part.column("text")))
            columns = [part.column("doc_id"), pa.array(n), pa.array(known), pa.array(np.full(len(n), m.train_tokens)), pa.array(base), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
