"""Language identification by cross-parsing.

A language is known by a suffix automaton of a bounded sample of its labelled
text.  A document is parsed against every automaton: a phrase is the longest
run, from where the last one ended, that occurs somewhere in the sample.  The
fewer phrases, the nearer the languages; phrases are weighted by the log of
the sample's length, which makes samples of unequal length comparable
(the cross-parsing entropy in bits).

Symbols are lower-case letters' UTF-8 bytes and one blank for everything
between words.  A whole text is parsed, in segments of ``SEGMENT`` symbols
that advance side by side as lanes of one array, so long texts cost no more
a symbol than short ones.  A segment's start adds one phrase for every
language alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, byte_slices

UNKNOWN = "und"
SAMPLE_SYMBOLS = 40_000  #: of each language
SAMPLE_DOCS = 400  #: expected number of a language's documents that the sample is made of
SEGMENT = 1024
_BLANK = 32

_FOLD = np.full(256, _BLANK, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of many texts with runs of blanks reduced to one, and their offsets."""
    if len(data) == 0:
        return data, np.zeros(len(offsets), np.int64)
    s = _FOLD[data]
    # capital letters of the Latin-1 block: C3 80 to C3 9E
    high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    s[high] += 0x20
    blank = s == _BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    counts = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], counts[offsets]


def automaton(text: np.ndarray, classes: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``text`` as an array [state, symbol]; -1: none."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(go), classes), -1, np.int32)
    for state, arcs in enumerate(go):
        if arcs:
            table[state, list(arcs.keys())] = list(arcs.values())
    return table


@dataclass
class Parser:
    """All languages' automata in one table of (next state * classes) * 2 + (a phrase starts here)."""

    langs: list[str]
    classes_of: np.ndarray  # byte -> class; 0: in no sample
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    @classmethod
    def build(cls, samples: dict[str, bytes]) -> Parser:
        langs = sorted(samples)
        found = np.unique(np.concatenate([np.frombuffer(samples[x], np.uint8) for x in langs]))
        classes_of = np.zeros(256, np.uint8)
        classes_of[found] = np.arange(1, len(found) + 1)
        n = len(found) + 1
        tables, roots, start = [], [], 0
        for x in langs:
            t = automaton(classes_of[np.frombuffer(samples[x], np.uint8)], n).astype(np.int64)
            starts = t < 0  # no arc: a new phrase starts with this symbol
            starts[0] = True
            again = np.where(t[0] < 0, 0, t[0])
            t = np.where(starts, again[None, :], t)
            tables.append((((t + start) * n) << 1) | starts)
            roots.append((start * n) << 1)
            start += len(t)
        bits = np.array([math.log2(len(samples[x]) + 2) for x in langs])
        table = np.concatenate(tables).ravel()
        return cls(langs, classes_of, table.astype(np.int32 if table.max() < 2**31 else np.int64), np.array(roots), bits)

    def phrases(self, s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases [language, text] of texts given as symbols."""
        texts = len(offsets) - 1
        total = np.zeros((len(self.langs), texts), np.int64)
        sizes = np.diff(offsets)
        lanes_of = -(-sizes // SEGMENT)
        if not lanes_of.sum():
            return total
        owner = np.repeat(np.arange(texts), lanes_of)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
        start = offsets[owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, offsets[owner + 1] - start)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        codes = self.classes_of[s]
        value = np.repeat(self.roots[:, None], len(owner), 1).astype(self.table.dtype)
        count = np.zeros((len(self.langs), len(owner)), np.int32)
        active = len(owner)
        for t in range(int(size[0])):
            while active and size[active - 1] <= t:
                active -= 1
            at = (value[:, :active] >> 1) + codes[start[:active] + t]
            v = self.table[at]
            value[:, :active] = v
            count[:, :active] += v & 1
        for k in range(len(self.langs)):
            total[k] = np.bincount(owner, count[k], texts).astype(np.int64)
        return total


def sample(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """Folded text of every language, at most ``SAMPLE_SYMBOLS`` of each, whatever the number of languages.

    Documents are taken by a hash of their id with a chance that makes about
    ``SAMPLE_DOCS`` of each language, all of them if there are fewer.  Each
    gives a piece of the same length from a place in the whole text that the
    hash tells; a shorter text gives itself.
    """
    usable = learn & F.col(lang).isNotNull() & F.col(text).isNotNull()
    rows = docs.filter(usable).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    chance, piece = F.when(F.lit(False), 0.0), F.when(F.lit(False), 0)
    of_text = {x: SAMPLE_SYMBOLS // min(n, SAMPLE_DOCS) for x, n in counts.items()}
    for x, n in counts.items():
        chance = chance.when(F.col("lang") == x, min(1.0, SAMPLE_DOCS / n))
        piece = piece.when(F.col("lang") == x, of_text[x])
    places = F.greatest(F.length("text") - piece, F.lit(0)) + 1
    taken = F.substr("text", (F.pmod(F.xxhash64("h", F.lit(5)), places) + 1).cast("int"), piece)
    picked = rows.filter((F.pmod("h", F.lit(1 << 20)) / (1 << 20)) <= chance).select("lang", "h", taken.alias("text"))
    found: dict[str, list] = {}
    for r in picked.orderBy("h").limit(4 * SAMPLE_DOCS * len(counts)).toLocalIterator():
        raw = r.text.encode()
        s, _ = symbols(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        found.setdefault(r.lang, []).append(s[: of_text[r.lang]].tobytes())
    out = {}
    for x, texts in found.items():
        joined = bytes([_BLANK]).join(t for t in texts if t)
        s, _ = symbols(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
        if len(s):
            out[x] = s[:SAMPLE_SYMBOLS].tobytes()
    return out


_parsers: dict[int, Parser] = {}


def identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs``; ``learn`` tells the rows to learn from.

    ``score`` is one less the winner's bits as a part of the next language's
    bits: 0 is a tie, which goes to the first name.  A text that is NULL or
    has no letter, and every text when nothing could be learned, is ``und``
    with score 0.  An empty table gives an empty result.
    """
    samples = sample(docs, learn, text, lang, key)
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.when(F.col(text).rlike("\\p{L}"), F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        mark = hash(tuple(sorted(model.items())))
        if model and mark not in _parsers:
            _parsers.clear()
            _parsers[mark] = Parser.build(model)
        for part in byte_slices(batches, "text"):
            data, offsets = bytes_of(part.column("text"))
            names, scores = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
            if model:
                parser = _parsers[mark]
                bits = parser.phrases(*symbols(data, offsets)) * parser.bits[:, None]
                known = part.column("text").is_valid().to_numpy(zero_copy_only=False)
                best = bits.argmin(0)
                low = bits.min(0)
                rest = np.sort(bits, 0)[1] if len(bits) > 1 else np.full(part.num_rows, np.inf)
                names = np.where(known, np.array(parser.langs, object)[best], UNKNOWN)
                scores = np.where(known, 1 - low / np.maximum(rest, 1e-9), 0.0).clip(0, 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
