"""Toxicity by a subsequence string-kernel support vector machine.

The kernel compares two words by all their common subsequences of ``ORDER``
symbols, each weighted by ``DECAY`` to the power of the span it covers, so an
insult with inserted or gapped characters stays near to itself.  Landmarks
chosen by pivoted Cholesky make it a finite map (Nyström), on which a linear
support vector machine is trained.

Both borders of a word are symbols of their own, so a clean word that begins or
ends like an insult is told from it.

Labels are of documents, so training is multiple-instance: a toxic sentence
has at least one toxic word.  The first witnesses are words that toxic texts
prefer; then each round takes the highest scored words of every toxic text
and adds the highest scored words of clean texts as negatives.  A word counts
by its texts, and a word of both classes is an example of both.

Scoring folds landmarks and weights into one table over subsequences, which is
the same function; every distinct word of a slice is scored once.  A logistic
curve of the margins of a document's ``WORST`` worst distinct words, fitted
on the training texts at the true shares of the classes, gives its score: one
sure insult is enough, and so are several words that clean texts use now and
then.  Single letters in a row (``i d i o t``) also count as one word.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, byte_slices, bytes_of, labelled_sample, word_hashes

ORDER = 3
DECAY = 0.7
CLASSES = 34
OPEN, CLOSE = 32, 33  #: symbols of the borders of a word
LONGEST = 24  #: symbols with borders; longer words are compared in windows of this size that overlap by half
LANDMARKS = 240  #: of toxic words, and half as many of clean words
ROUNDS = 4  #: at most
FLAGGED = 0.001  #: part of the clean training texts with a word of positive margin at which rounds end
WORST = 3  #: distinct words of a text that its score rests on
LEAST, MOST = -1.0, 1.5  #: margins count between these
NEAR = -0.4  #: margin from which a high scored word of a toxic text is taken for a witness
TRAIN_PER_CLASS = 3000  #: labelled documents of each class that the machine is fitted on
NEGATIVES = 4000  #: words of clean texts that the machine is fitted on
PENALTY = 20_000.0  #: shared by all words, toxic and clean
PREFERRED = 2.5  #: log odds by which toxic texts prefer a first witness
CERTAIN = 2.0  #: nats of evidence beyond the log of the number of words tried
PART = 5  #: bytes of a stem
SLICE_BYTES = 2 << 20
SPELLED = 4  #: so many single letters in a row are one word as well

#: byte -> symbol; letters have their own, bytes of other letters share five, the rest (0) is skipped
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128, 256) % 5


def _bordered(letters: np.ndarray) -> np.ndarray:
    """The symbols between their borders; fewer than ``ORDER`` stay without."""
    return np.concatenate([[OPEN], letters, [CLOSE]]).astype(np.uint8) if len(letters) >= ORDER else letters


_TO_SYMBOL, _SKIPPED = _SYMBOL.tobytes(), bytes(np.flatnonzero(_SYMBOL == 0).astype(np.uint8))


@dataclass
class Packed:
    """The windows of many words, end to end: symbols, where each window starts (and the last ends), the first window of each word."""

    symbols: np.ndarray
    start: np.ndarray
    first: np.ndarray


def pack(words: list[bytes]) -> Packed:
    """``encode`` and ``_windows`` of all words without an array for each."""
    parts, first, half = [], [], LONGEST // 2
    for w in words:
        c = w.translate(_TO_SYMBOL, _SKIPPED)
        if len(c) >= ORDER:
            c = bytes([OPEN]) + c + bytes([CLOSE])
        first.append(len(parts))
        parts += [c] if len(c) <= LONGEST else [c[i : i + LONGEST] for i in range(0, len(c) - half, half)]
    start = np.cumsum([0, *map(len, parts)])
    return Packed(np.frombuffer(b"".join(parts), np.uint8), start, np.array(first, np.int64))


def encode(words: list[bytes]) -> list[np.ndarray]:
    return [_bordered(s[s > 0]) for s in (_SYMBOL[np.frombuffer(w, np.uint8)] for w in words)]


def _windows(codes: np.ndarray) -> list[np.ndarray]:
    n = len(codes)
    if n <= LONGEST:
        return [codes]
    half = LONGEST // 2
    return [codes[i : i + LONGEST] for i in range(0, n - half, half)]


_shapes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _shape(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of ``n`` symbols: positions of subsequences, their weights, decays between positions."""
    if n not in _shapes:
        at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
        weight = (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)
        gap = np.arange(n)[:, None] - np.arange(n)[None, :] - 1
        _shapes[n] = at, weight, np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)
    return _shapes[n]


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices [word, subsequence] of words of one length, and the weights."""
    at, weight, _ = _shape(codes.shape[1])
    u = np.zeros((len(codes), len(at)), np.int64)
    for k in range(ORDER):
        u = u * CLASSES + codes[:, at[:, k]]
    return u, weight


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """K(s, s) of words of one length by dynamic programming over pairs of positions."""
    b, n = codes.shape
    decay = _shape(n)[2].T
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float32) * np.float32(DECAY**2)
    d = same
    for _ in range(ORDER - 1):
        p = (d.reshape(-1, n) @ decay).reshape(b, n, n).transpose(0, 2, 1)
        p = (np.ascontiguousarray(p).reshape(-1, n) @ decay).reshape(b, n, n)
        d = same * p
    return d.sum((1, 2))


def by_length(codes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, array) of the words of each length that has subsequences."""
    sizes = np.array([len(c) for c in codes])
    for n in np.unique(sizes):
        if n >= ORDER:
            rows = np.flatnonzero(sizes == n)
            yield rows, np.stack([codes[r] for r in rows]).astype(np.int64)


def profile(codes: np.ndarray) -> np.ndarray:
    """The normalised map of one word into the space of all subsequences."""
    out = np.zeros(CLASSES**ORDER, np.float32)
    if len(codes) >= ORDER:
        u, weight = subsequences(codes[None, :].astype(np.int64))
        np.add.at(out, u[0], weight)
        out /= np.sqrt((out**2).sum())
    return out


def kernel_to(profiles: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    """Normalised kernel [word, profile]; words without subsequences have 0."""
    out = np.zeros((len(codes), len(profiles)), np.float32)
    # Only subsequences that a profile has, and one place of zeros for all others.
    used = np.flatnonzero(profiles.any(axis=0))
    place = np.full(CLASSES**ORDER, len(used), np.int64)
    place[used] = np.arange(len(used))
    columns = np.zeros((len(used) + 1, len(profiles)), np.float32)
    columns[:-1] = profiles[:, used].T
    for rows, array in by_length(codes):
        block = max(1, (1 << 22) // (len(_shape(array.shape[1])[0]) * len(profiles)))
        for i in range(0, len(rows), block):
            u, weight = subsequences(array[i : i + block])
            norm = np.sqrt(self_kernel(array[i : i + block]))
            out[rows[i : i + block]] = np.einsum("wsp,s->wp", columns[place[u]], weight, optimize=True) / norm[:, None]
    return out


def choose_landmarks(codes: list[np.ndarray], count: int, weight: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """Profiles of the words that pivoted Cholesky picks: always the one explained worst so far, by weight.

    They are put into the first rows of ``out``, of which a view is returned.
    """
    left = np.array([float(len(c) >= ORDER) for c in codes])
    factors, picked = np.zeros((len(codes), 0)), 0
    out = np.zeros((count, CLASSES**ORDER), np.float32) if out is None else out
    known = []  # what of the kernel does not depend on the landmark
    for rows, array in by_length(codes):
        block = max(1, (1 << 22) // len(_shape(array.shape[1])[0]))
        for i in range(0, len(rows), block):
            u, share = subsequences(array[i : i + block])
            known.append((rows[i : i + block], u.astype(np.int32), share, np.sqrt(self_kernel(array[i : i + block]))))
    while picked < count and len(codes) and left.max() > 1e-3:
        p = int((left if weight is None else left * weight).argmax())
        prof = out[picked] = profile(codes[p])
        column = np.zeros(len(codes))
        for rows, u, share, norm in known:
            column[rows] = np.einsum("wsp,s->wp", prof[:, None][u], share, optimize=True)[:, 0] / norm
        new = (column - factors @ factors[p]) / np.sqrt(left[p])
        factors = np.column_stack([factors, new])
        left = np.maximum(left - new**2, 0)
        left[p] = 0
        picked += 1
    return out[:picked]


def train_linear(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge machine by Newton steps; y is -1 or 1."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(30):
        slack = 1 - y * (x @ w)
        on = slack > 0
        short = x[on]
        grad = ridge * w - 2 * short.T @ (cost[on] * y[on] * slack[on])
        hess = np.diag(ridge) + 2 * (short.T * cost[on]) @ short
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def logistic_curve(worst: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """(slopes, base) of the log odds of label 1 by margins; no slope is negative."""
    a = np.zeros(worst.shape[1] + 1)
    x = np.column_stack([worst, np.ones(len(worst))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ a).clip(-30, 30)))
        grad = x.T @ (weight * (p - label)) + 1e-2 * a
        hess = (x.T * (weight * p * (1 - p))) @ x + 1e-2 * np.eye(len(a))
        free = (a > 0) | (grad < 0)
        free[-1] = True
        a[free] -= np.linalg.solve(hess[np.ix_(free, free)], grad[free]).clip(-2, 2)
        a[:-1] = np.maximum(a[:-1], 0)
    return a[:-1], float(a[-1])


@dataclass
class Machine:
    """The trained machine: a table over subsequences, the base of a margin, the logistic curve."""

    table: np.ndarray
    base: float
    slopes: np.ndarray = field(default_factory=lambda: np.ones(WORST))
    offset: float = 0.0

    def margins(self, codes: list[np.ndarray]) -> np.ndarray:
        """Margins of words; without subsequences the base."""
        out = np.full(len(codes), self.base)
        for rows, array in by_length(codes):
            out[rows] = self.margins_of(array)
        return out

    def margins_of(self, array: np.ndarray) -> np.ndarray:
        """Margins of words of one length."""
        out = np.empty(len(array))
        block = max(1, (1 << 19) // len(_shape(array.shape[1])[0]))
        for i in range(0, len(array), block):
            u, weight = subsequences(array[i : i + block])
            out[i : i + block] = (self.table[u] @ weight) / np.sqrt(self_kernel(array[i : i + block]))
        return out + self.base

    def word_margins(self, words: Packed) -> np.ndarray:
        """Margins of words of any length: that of the worst window."""
        if not len(words.first):
            return np.zeros(0)
        size = np.diff(words.start)
        out = np.full(len(size), self.base)
        for n in np.unique(size[size >= ORDER]):
            rows = np.flatnonzero(size == n)
            out[rows] = self.margins_of(words.symbols[words.start[rows][:, None] + np.arange(n)].astype(np.int64))
        return np.maximum.reduceat(out, words.first)

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[text, k]: the ``WORST`` largest margins of the distinct words of each whole text, worst first."""
        out = np.full((len(offsets) - 1, WORST), LEAST)
        hashes, word_at, start, end = word_hashes(data, offsets, lower=True, spans=True)
        if not len(hashes):
            return out
        _, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        margin = self._distinct(data, start[first], end[first])
        rows = np.flatnonzero((margin > LEAST)[where])
        text = np.searchsorted(word_at, rows, "right") - 1
        pair = np.unique(text * len(first) + where[rows])
        text, margin = pair // len(first), margin[pair % len(first)]
        spelled = self._spelled(data, start, end, word_at)
        text = np.concatenate([text, [t for t, _ in spelled]]).astype(np.int64)
        margin = np.concatenate([margin, [m for _, m in spelled]])
        order = np.lexsort((-margin, text))
        text, margin = text[order], margin[order]
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        top = rank < WORST
        out[text[top], rank[top]] = margin[top]
        return out.clip(LEAST, MOST)

    def text_margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The log odds of each whole text."""
        return self.worst(data, offsets) @ self.slopes + self.offset

    def _distinct(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Margins of the words at these places."""
        symbols = _SYMBOL[data]
        count = np.concatenate([[0], np.cumsum(symbols > 0)])
        letters = symbols[symbols > 0]
        at, size = count[start], count[end] - count[start]
        out = np.full(len(start), self.base)
        for n in range(ORDER, LONGEST - 1):
            rows = np.flatnonzero(size == n)
            if len(rows):
                array = np.full((len(rows), n + 2), OPEN, np.int64)
                array[:, 1:-1], array[:, -1] = letters[at[rows][:, None] + np.arange(n)], CLOSE
                out[rows] = self.margins_of(array)
        for r in np.flatnonzero(size > LONGEST - 2):
            out[r] = self.margins(_windows(_bordered(letters[at[r] : at[r] + size[r]]))).max()
        return out

    def _spelled(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, word_at: np.ndarray) -> list[tuple[int, float]]:
        """(text, margin) of the words that texts spell letter by letter."""
        single = (end - start) == 1
        if not single.any():
            return []
        edge = np.zeros(len(single) + 1, bool)
        edge[word_at] = True
        opens = single & (edge[:-1] | np.concatenate([[True], ~single[:-1]]))
        closes = single & (edge[1:] | np.concatenate([~single[1:], [True]]))
        first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        units: dict[tuple[int, bytes], float] = {}
        for a, b in zip(first[last - first >= SPELLED], last[last - first >= SPELLED]):
            letters = _SYMBOL[data[start[a:b]]]
            key = int(np.searchsorted(word_at, a, "right") - 1), letters.tobytes()
            if key not in units:
                units[key] = float(self.margins(_windows(_bordered(letters[letters > 0]))).max())
        return [(t, m) for (t, _), m in units.items()]

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.asarray(margin).clip(-500, 500)))


def _words(text: str) -> set[bytes]:
    return set(text.lower().encode().split())


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray | None = None, seed: int = 11) -> Machine:
    """Train on labelled texts (0 clean, 1 toxic); ``weight`` is how many documents a text stands for."""
    rng = np.random.default_rng(seed)
    every = sorted({w for t in texts for w in _words(t)})
    place = {w: k for k, w in enumerate(every)}
    bags = [np.array(sorted(place[w] for w in _words(t)), np.int32) for t in texts]  # words by their place in ``every``
    del place
    toxic, clean = [b for b, y in zip(bags, labels) if y == 1], [b for b, y in zip(bags, labels) if y == 0]
    if not toxic or not clean:
        share = float(np.mean(labels)) if len(labels) else 0.0
        return Machine(np.zeros(CLASSES**ORDER, np.float32), 0.0, np.zeros(WORST), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    in_toxic, in_clean = (np.bincount(np.concatenate(of), minlength=len(every)) for of in (toxic, clean))
    share = len(toxic) / (len(toxic) + len(clean))
    odds = np.log((in_toxic + 0.5) / (len(toxic) + 1)) - np.log((in_clean + 0.5) / (len(clean) + 1))
    sure = _witnesses(every, toxic, clean, share)
    sure = sure or {int(max(b, key=lambda w: (_evidence(in_toxic[w], in_clean[w], share) * (odds[w] > 0), w))) for b in toxic if len(b)}
    positive = set(sure)
    pool = np.flatnonzero(in_clean)
    negative = {int(w) for w in pool[rng.choice(len(pool), min(NEGATIVES, len(pool)), replace=False)]} | {w for w in positive if in_clean[w]}
    packed = pack(every)
    of_clean = [b for b in clean if len(b)]
    room = np.zeros((LANDMARKS + LANDMARKS // 2, CLASSES**ORDER), np.float32)
    machine, hard = None, sorted(negative)
    for _ in range(ROUNDS):
        if machine is not None:
            margin = machine.word_margins(packed)
            if np.mean([margin[b].max() > 0 for b in of_clean]) <= FLAGGED:
                break
            best = {int(w) for b in toxic for w in b[np.lexsort((b, -margin[b]))[:WORST]]}
            positive = sure | {w for w in best if odds[w] > 1 and margin[w] > NEAR}
            hard = pool[np.lexsort((pool, -margin[pool]))[: NEGATIVES // 4]].tolist()
            negative |= set(hard) | {w for w in positive if in_clean[w]}
        pos, neg = sorted(positive), sorted(negative)
        # A word counts by its texts, toxic and clean.
        says, seen = in_toxic[pos].astype(float), in_clean[neg].astype(float)
        windows = [_windows(c) for c in encode([every[w] for w in neg])]
        sizes = [len(x) for x in windows]
        plain, gapped = ([_windows(c)[0] for c in encode(x)] for x in ([every[w] for w in pos], [_with_gaps(every[w], rng) for w in pos]))
        rows = plain + gapped + [c for x in windows for c in x]
        y = np.concatenate([np.ones(2 * len(pos)), -np.ones(sum(sizes))])
        hardest = [_windows(c)[0] for c in encode([every[w] for w in hard])]
        n = len(choose_landmarks(plain, LANDMARKS, np.sqrt(says / says.sum()), room))
        marks = room[: n + len(choose_landmarks(hardest, LANDMARKS // 2, out=room[n:]))]
        value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
        keep = value > 1e-6
        root = vector[:, keep] / np.sqrt(value[keep])
        mass = np.concatenate([says / 2, says / 2, np.repeat(np.minimum(seen, len(toxic)), sizes)])
        w, base = train_linear(kernel_to(marks, rows).astype(float) @ root, y, PENALTY * mass / mass.sum())
        table = np.concatenate([(root @ w) @ m for m in np.array_split(marks, 16, axis=1)])  # in parts, as they are copied to doubles
        machine = Machine(table.astype(np.float32), base)
    del every, bags, toxic, clean, of_clean, packed
    raw = [t.encode() for t in texts]
    worst = np.concatenate([machine.worst(np.frombuffer(b, np.uint8), np.array([0, len(b)])) for b in raw])
    machine.slopes, machine.offset = logistic_curve(worst, np.asarray(labels, float), np.ones(len(texts)) if weight is None else weight)
    return machine


def _parts(word: bytes) -> set[bytes]:
    """The word itself and its runs of ``PART`` bytes, borders included."""
    whole = b" " + word + b" "
    return {whole} | {whole[i : i + PART] for i in range(len(whole) - PART + 1)}


def _witnesses(every: list[bytes], toxic: list[np.ndarray], clean: list[np.ndarray], share: float) -> set[int]:
    """Places of words of toxic texts that have, or contain a part that has, certain evidence.

    A stem shows in many words, each of them too rare to prove anything.
    """
    number: dict[bytes, int] = {}  # of the parts of words of toxic texts
    of_toxic = np.unique(np.concatenate(toxic))
    start, end = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    flat = array("i")
    for w in of_toxic.tolist():
        start[w] = len(flat)
        flat.extend([number.setdefault(p, len(number)) for p in _parts(every[w])])
        end[w] = len(flat)
    for w in np.setdiff1d(np.unique(np.concatenate(clean)), of_toxic).tolist():
        start[w] = len(flat)
        flat.extend([number[p] for p in _parts(every[w]) if p in number])
        end[w] = len(flat)
    parts = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)

    def texts_with(bags: list[np.ndarray]) -> np.ndarray:
        n = np.zeros(len(number), np.int64)
        for b in bags:
            size = end[b] - start[b]
            n[np.unique(parts[np.repeat(start[b] - np.cumsum(size) + size, size) + np.arange(size.sum())])] += 1
        return n

    in_toxic, in_clean = texts_with(toxic), texts_with(clean)
    least, rare = np.log(max(1, len(number))) + CERTAIN, PREFERRED + np.log(share / (1 - share))
    certain = np.log((in_toxic + 0.5) / (in_clean + 0.5)) > rare
    for p in np.flatnonzero(certain):
        certain[p] = _evidence(in_toxic[p], in_clean[p], share) > least
    return {w for w in of_toxic.tolist() if certain[parts[start[w] : end[w]]].any()}


def _evidence(toxic: int, clean: int, share: float) -> float:
    """How unlikely it is, in nats, that a word of no account is in so many toxic texts."""
    n, p = toxic + clean, toxic / (toxic + clean)
    return n * (p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if clean else 0))


def _with_gaps(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with one or two letters inserted somewhere inside."""
    out = bytearray(word)
    for _ in range(int(rng.integers(1, 3))):
        out.insert(int(rng.integers(1, max(2, len(out)))), int(rng.integers(97, 123)))
    return bytes(out)


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, text: str = "text", key: str = "doc_id") -> Machine:
    """Fit on at most ``TRAIN_PER_CLASS`` labelled documents of each class, each with all its distinct words."""
    sample, counts = labelled_sample(docs, labels, label, learn, TRAIN_PER_CLASS, _bag(F.col(text)), text, key)
    taken = Counter(y for _, y in sample)
    weight = np.array([counts[y] / taken[y] for _, y in sample])
    return fit([s[0] for s in sample], np.array([s[1] for s in sample], float), weight * len(sample) / max(1e-9, weight.sum()))


def _bag(text: Column) -> Column:
    """The distinct words of a text in one line, words that it spells by single letters put together."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spelled = F.regexp_extract_all(lower, F.lit(f"(?<![^ \\t-\\r])[!-~](?:[ \\t-\\r]+[!-~]){{{SPELLED - 1},}}(?![^ \\t-\\r])"), F.lit(0))
    units = F.transform(spelled, lambda u: F.regexp_replace(u, SPACE_CLASS, ""))
    several = F.filter(F.array_distinct(F.split(lower, SPACE_CLASS)), lambda w: F.length(w) > 1)
    return F.array_join(F.array_distinct(F.concat(several, units)), " ")


def score(docs: DataFrame, machine: Machine, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, score, margin`` of every row: the probability that its whole text is toxic.

    ``margin`` is the log odds.  NULL, empty and letterless texts have the lowest.  Rows are not
    shuffled and memory is bounded by a slice of a batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in byte_slices(batches, "text", SLICE_BYTES):
            margin = model.text_margins(*bytes_of(part.column("text")))
            columns = [part.column("doc_id"), pa.array(model.probability(margin), pa.float64()), pa.array(margin, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "margin"])

    return rows.mapInArrow(run, "doc_id long, score double, margin double")


def clean(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, text, SLICE_BYTES):
            scores = shared.value.probability(shared.value.text_margins(*bytes_of(part.column(text))))
            yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
