"""Document quality by a byte-level convolutional network, in numpy.

A text's bytes are cut into overlapping chunks that cover it whole.  Each
byte becomes a learned vector, learned filters slide over a chunk and the
largest response of each filter is kept.  A document is the mean, the
largest and the smallest of its chunks' responses; one logistic unit makes
them a probability.  Filters, byte vectors and the unit are trained together
by gradient descent on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, byte_slices, labelled_sample

CHUNK = 512
STEP = 448  #: chunks overlap by CHUNK - STEP bytes
STRIDE = 4
WIDTH = 3 * STRIDE  #: bytes under a filter
PAD = 256  #: stands for "no byte" behind the end of a text
DIMS = 6
FILTERS = 32
TRAIN_PER_CLASS = 2500  #: labelled documents of each class that the network is fitted on
TRAIN_CHUNKS = 6  #: chunks of one document in a training step, drawn anew in each epoch
TRAIN_CHARS = 16_384  #: of one document that the fitting may draw from, in pieces from all over it
TRAIN_PIECES = 8
STEPS = 450
BATCH = 64


def chunk_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first byte) of the chunks that cover every text; an empty text has one."""
    sizes = np.diff(offsets)
    n = 1 + np.maximum(0, -(-(sizes - CHUNK) // STEP))
    owner = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return owner, offsets[owner] + nth * STEP


def chunks(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Byte codes [chunk, CHUNK], padded behind the end of a text."""
    at = start[:, None] + np.arange(CHUNK)[None, :]
    inside = at < offsets[owner + 1][:, None]
    codes = np.full(at.shape, PAD, np.int64)
    codes[inside] = data[at[inside]]
    return codes


class Network:
    """Byte vectors, filters and one logistic unit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.p = {
            "bytes": f(257, DIMS, scale=0.5),
            "filters": f(WIDTH * DIMS, FILTERS, scale=(WIDTH * DIMS) ** -0.5),
            "shift": np.zeros(FILTERS, np.float32),
            "unit": f(3 * FILTERS, scale=0.1),
            "base": np.zeros(1, np.float32),
        }

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """[chunk, position, WIDTH * DIMS] of byte vectors under the filters."""
        e = self.p["bytes"][codes].reshape(len(codes), CHUNK // STRIDE, STRIDE * DIMS)
        k = WIDTH // STRIDE
        return np.concatenate([e[:, i : e.shape[1] - k + 1 + i] for i in range(k)], 2)

    def pooled(self, codes: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each chunk."""
        w = self.windows(codes)
        r = (w.reshape(-1, w.shape[2]) @ self.p["filters"]).reshape(len(codes), w.shape[1], FILTERS)
        return np.maximum(r.max(1) + self.p["shift"], 0)

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Features of documents whose chunks lie together; ``first``: where each begins."""
        n = np.diff(np.append(first, len(pooled)))[:, None]
        return np.concatenate([np.add.reduceat(pooled, first) / n, np.maximum.reduceat(pooled, first), np.minimum.reduceat(pooled, first)], 1)

    def score(self, data: np.ndarray, offsets: np.ndarray, block: int = 256) -> np.ndarray:
        """Probabilities of whole texts."""
        owner, start = chunk_starts(offsets)
        parts = [self.pooled(chunks(data, offsets, owner[i : i + block], start[i : i + block])) for i in range(0, len(owner), block)]
        first = np.searchsorted(owner, np.arange(len(offsets) - 1))
        z = self.combine(np.concatenate(parts), first).astype(np.float64) @ self.p["unit"] + self.p["base"]
        return 1 / (1 + np.exp(-z.clip(-500, 500)))

    def gradients(self, codes: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.windows(codes)
        n, positions, width = w.shape
        r = (w.reshape(-1, width) @ self.p["filters"]).reshape(n, positions, FILTERS)
        top = r.argmax(1)
        raw = np.take_along_axis(r, top[:, None, :], 1)[:, 0] + self.p["shift"]
        pooled = np.maximum(raw, 0)
        x = self.combine(pooled, first)
        z = x @ self.p["unit"] + self.p["base"]
        dz = ((1 / (1 + np.exp(-z)) - label) * weight / len(label)).astype(np.float32)
        dx = dz[:, None] * self.p["unit"][None, :]
        count = np.diff(np.append(first, n))
        doc = np.repeat(np.arange(len(first)), count)
        mean, high, low = (dx[:, k * FILTERS : (k + 1) * FILTERS][doc] for k in range(3))
        is_high, is_low = ((pooled == x[:, k * FILTERS : (k + 1) * FILTERS][doc]).astype(np.float32) for k in (1, 2))
        high, low = (d * is_it / np.add.reduceat(is_it, first)[doc] for d, is_it in ((high, is_high), (low, is_low)))  # ties share
        dp = (mean / count[doc][:, None] + high + low) * (raw > 0)
        rows = w[np.arange(n)[:, None], top]  # [chunk, filter, width]
        d_filters = np.einsum("nfw,nf->wf", rows, dp, optimize=True)
        back = dp[:, :, None] * self.p["filters"].T[None]  # [chunk, filter, width]
        under = (top * STRIDE)[:, :, None] + np.arange(WIDTH)[None, None, :]
        byte = codes[np.arange(n)[:, None, None], under].ravel()
        back = back.reshape(-1, DIMS)
        d_bytes = np.stack([np.bincount(byte, back[:, d], 257) for d in range(DIMS)], 1)
        return {"bytes": d_bytes, "filters": d_filters, "shift": dp.sum(0), "unit": x.T @ dz, "base": dz.sum(keepdims=True)}


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray | None = None, steps: int = STEPS, seed: int = 7) -> Network:
    """Train on whole labelled texts with Adam."""
    net, rng = Network(seed), np.random.default_rng(seed)
    weights = np.ones(len(texts)) if weights is None else weights
    share = np.average(labels, weights=weights).clip(0.01, 0.99) if len(texts) else 0.5
    net.p["base"][:] = np.log(share / (1 - share))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    while step < steps and texts:
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            rate = 0.01 * 0.1 ** (step / steps)
            data = np.frombuffer(b"".join(texts[k] for k in own), np.uint8)
            offsets = np.cumsum([0, *(len(texts[k]) for k in own)])
            owner, start = chunk_starts(offsets)
            draw = rng.random(len(owner))
            by_doc = np.lexsort((draw, owner))
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            pick = np.sort(by_doc[rank < TRAIN_CHUNKS])
            owner, start = owner[pick], start[pick]
            first = np.searchsorted(owner, np.arange(len(own)))
            g = net.gradients(chunks(data, offsets, owner, start), first, labels[own], weights[own])
            step += 1
            for k in net.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _pieces(text: Column) -> Column:
    """A text, or of a long one a piece from each of ``TRAIN_PIECES`` equal parts, at a place that a hash tells."""
    size, length = TRAIN_CHARS // TRAIN_PIECES, F.length(text).cast("long")
    cuts = [F.floor(length * k / TRAIN_PIECES) for k in range(TRAIN_PIECES + 1)]
    starts = [a + F.pmod(F.xxhash64(text, F.lit(k)), b - a - size + 1) + 1 for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return F.when(length <= TRAIN_CHARS, text).otherwise(F.concat(*[F.substr(text, a.cast("int"), F.lit(size)) for a in starts]))


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, text: str = "text", key: str = "doc_id") -> Network:
    """Fit on at most ``TRAIN_PER_CLASS`` labelled documents of each class; others count by weight."""
    sample, counts = labelled_sample(docs, labels, label, learn, TRAIN_PER_CLASS, _pieces(F.col(text)), text, key)
    y = np.array([s[1] for s in sample], float)
    drawn = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    total = max(1, sum(counts.values()))
    weights = np.array([counts.get(int(k), 0) / drawn[int(k)] * len(y) / total for k in y])
    return fit([s[0].encode() for s in sample], y, weights)


def score(docs: DataFrame, net: Network, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, score`` of every row: the probability of label 1 for its whole text.

    NULL and empty texts are one chunk of padding and get the network's score
    for it.  An untrained class gives the share of the other.  Memory is
    bounded by the slice of a batch, or by one text if that is longer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", 1 << 20):
            scores = shared.value.score(*bytes_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
