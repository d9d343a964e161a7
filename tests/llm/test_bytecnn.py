import zlib

import numpy as np
from pyspark.sql import functions as F

from tablescope.llm import bytecnn as bc

from tests.conftest import SF01

from .conftest import SCHEMA, run


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_chunks_cover_every_byte():
    sizes = [0, 1, 511, 512, 513, 960, 961, 5000]
    offsets = np.cumsum([0, *sizes])
    owner, start = bc.chunk_starts(offsets)
    for k, n in enumerate(sizes):
        at = start[owner == k] - offsets[k]
        assert at[0] == 0 and (np.diff(at) == bc.STEP).all() and at[-1] + bc.CHUNK >= n
        assert len(at) == 1 or at[-2] + bc.CHUNK < n


def test_score_against_plain_loops():
    net = bc.Network(3)
    texts = ["", "é short", "abc " * 400]
    got = net.score(*flat(texts))
    e, k = net.p["bytes"], bc.WIDTH
    for t, want in zip(texts, got):
        b = list(t.encode())
        rows, at = [], 0
        while True:
            c = (b[at : at + bc.CHUNK] + [bc.PAD] * bc.CHUNK)[: bc.CHUNK]
            responses = [e[c[i : i + k]].ravel() @ net.p["filters"] for i in range(0, bc.CHUNK - k + 1, bc.STRIDE)]
            rows.append(np.maximum(np.max(responses, 0) + net.p["shift"], 0))
            if at + bc.CHUNK >= len(b):
                break
            at += bc.STEP
        x = np.concatenate([np.mean(rows, 0), np.max(rows, 0), np.min(rows, 0)])
        assert abs(1 / (1 + np.exp(-(x @ net.p["unit"] + net.p["base"][0]))) - want) < 1e-4


def test_gradients_against_differences():
    net = bc.Network(1)
    data, offsets = flat(["".join(np.random.default_rng(2).choice(list("some words here"), 1200)), "x", "other text 123"])
    owner, start = bc.chunk_starts(offsets)
    codes, first, y, w = bc.chunks(data, offsets, owner, start), np.searchsorted(owner, np.arange(3)), np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])

    def loss():
        z = net.combine(net.pooled(codes), first).astype(float) @ net.p["unit"].astype(float) + net.p["base"][0]
        return np.mean(w * (np.logaddexp(0, z) - y * z))

    g = net.gradients(codes, first, y, w)
    for name, at in (("unit", (5,)), ("unit", (40,)), ("base", (0,)), ("shift", (3,)), ("filters", (7, 2)), ("bytes", (ord("e"), 1)), ("bytes", (bc.PAD, 2))):
        old, d = net.p[name][at], 1e-3
        net.p[name][at] = old + d
        up = loss()
        net.p[name][at] = old - d
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * d) - g[name][at]) < 2e-3


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    out = run(spark, "op5_quality", SF01).collect()
    assert len(out) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert len(held) > 30 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9


def test_nulls_no_labels_clashes_and_empty(spark):
    rows = [(1, "good words", None, None, None), (2, None, None, None, None), (2, "", None, None, None), (None, "z" * 300_000, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "2 AS y", "3 AS quality")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (5, 0)], "doc_id long, quality int")
    net = bc.train(docs, labels, "quality", F.lit(True))
    out = bc.score(docs, net).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 2}) == 1
    nothing = bc.train(docs, labels.limit(0), "quality", F.lit(True))
    assert all(abs(r.score - 0.5) < 0.5 for r in bc.score(docs, nothing).collect())
    assert bc.score(docs.limit(0), net).collect() == []


def test_pieces_cover_a_long_text(spark):
    part = (bc.TRAIN_CHARS + 8000) // bc.TRAIN_PIECES
    long = "".join(chr(97 + k) * part for k in range(bc.TRAIN_PIECES))
    texts = {1: "short", 2: "", 3: "é" * bc.TRAIN_CHARS, 4: long, 5: "é" * (bc.TRAIN_CHARS + 1)}
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r.t for r in docs.select("doc_id", bc._pieces(F.col("text")).alias("t")).collect()}
    assert all(got[i] == texts[i] for i in (1, 2, 3)) and len(got[5]) == bc.TRAIN_CHARS
    assert got[4] == "".join(chr(97 + k) * (bc.TRAIN_CHARS // bc.TRAIN_PIECES) for k in range(bc.TRAIN_PIECES))
