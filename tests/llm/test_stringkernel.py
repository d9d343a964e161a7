import tracemalloc
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tablescope.llm import stringkernel as sk

from tests.conftest import SF01

from .conftest import SCHEMA, run

WORDS = [b"idiot", b"i-d-iot", b"idxiot", b"banana", b"ba", b"", "chöß".encode(), b"aaaaaaa", b"abcabcabcabc"]


def naive(s, t):
    def spread(x):
        out = defaultdict(float)
        for at in combinations(range(len(x)), sk.ORDER):
            out[tuple(x[k] for k in at)] += sk.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = spread(list(s)), spread(list(t))
    return sum(v * b[k] for k, v in a.items())


def test_kernel_against_plain_enumeration():
    codes = sk.encode(WORDS)
    profiles = np.stack([sk.profile(c) for c in codes])
    got = sk.kernel_to(profiles, codes)
    for i, s in enumerate(codes):
        for j, t in enumerate(codes):
            norm = np.sqrt(naive(s, s) * naive(t, t))
            assert abs(got[i, j] - (naive(s, t) / norm if norm else 0)) < 1e-4
        if len(s) >= sk.ORDER:
            assert abs(sk.self_kernel(s[None, :].astype(np.int64))[0] - naive(s, s)) < 1e-4
    assert got[0, 1] > 0.999 and 0.3 < got[0, 2] < 0.95 and got[0, 3] == 0


def test_score_of_a_text_rests_on_its_worst_words():
    rng = np.random.default_rng(1)
    m = sk.Machine(rng.normal(size=sk.CLASSES**sk.ORDER).astype(np.float32), -0.3, np.array([2.0, 1.0, 0.5]), -0.7)
    texts = ["", "ab 12 --", "Some wörds are here, some wörds", "x" * 10 + " " + "abcdefghij" * 9, "so i d i o t ok", "a b c", "\n\t ", "i d i o t x i d i o t"]
    texts += [" ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(k)) for k in (1, 2, 3, 40, 400)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for t, worst, odds in zip(texts, m.worst(data, offsets), m.text_margins(data, offsets)):
        words = t.lower().encode().split()
        run_, spelled = [], set()
        for w in [*words, b"end"]:
            if len(w) == 1:
                run_.append(w)
            else:
                if len(run_) >= sk.SPELLED:
                    spelled.add(b"".join(run_))
                run_ = []
        margins = [max(m.margins(sk._windows(c))) for c in sk.encode([*set(words), *spelled])]
        want = np.clip(sorted([*margins, sk.LEAST, sk.LEAST, sk.LEAST], reverse=True)[:3], sk.LEAST, sk.MOST)
        assert np.allclose(worst, want, atol=1e-5) and abs(odds - (2 * want[0] + want[1] + 0.5 * want[2] - 0.7)) < 1e-4


def test_folded_table_is_the_sum_over_landmarks():
    rng = np.random.default_rng(2)
    marks = [c for c in sk.encode([b"idiot", b"stupid", "chöß".encode(), b"abcabc"])]
    weights = rng.normal(size=len(marks))
    table = (weights @ np.stack([sk.profile(c) for c in marks])).astype(np.float32)
    m = sk.Machine(table, 0.25)
    for c in sk.encode(WORDS):
        plain = sum(w * naive(c, k) / np.sqrt(naive(c, c) * naive(k, k)) for w, k in zip(weights, marks)) if len(c) >= sk.ORDER else 0
        assert abs(m.margins([c])[0] - plain - 0.25) < 1e-4


def test_borders_tell_a_word_from_its_stem():
    a, b, c = sk.encode([b"idiot", b"idiotic", b"xidiot"])
    assert a[0] == sk.OPEN and a[-1] == sk.CLOSE
    one = sk.profile(a)[None, :]
    assert sk.kernel_to(one, [b])[0, 0] < 0.9 and sk.kernel_to(one, [c])[0, 0] < 0.9


def test_gapped_words_are_found():
    rng = np.random.default_rng(4)
    syllables = ["ton", "her", "ing", "sal", "mer", "pod", "kan", "vul"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, labels = [], []
    for k in range(300):
        words = [word() for _ in range(30)]
        if k % 3 == 0:
            words[7] = ["zwiggle", "bafquox"][k % 2]
        texts.append(" ".join(words))
        labels.append(float(k % 3 == 0))
    m = sk.fit(texts, np.array(labels))
    tests = ["her zwiggle ton", "zwig-gle", "her zwixggle", "b a f q u o x", "her ton", "", "pod"]
    raw = [t.encode() for t in tests]
    p = m.probability(m.text_margins(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    assert (p >= 0.5).tolist() == [True] * 4 + [False] * 3


def test_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    out = run(spark, "op1_toxicity", SF01).collect()
    assert len(out) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_precision_and_recall_on_all_held_out_rows(spark):
    sf = SF01.replace("sf0.01", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in run(spark, "op1_toxicity", sf).collect() if r.held_out and labels.get(r.doc_id) in (0, 1)]
    both = sum(r.predicted and labels[r.doc_id] for r in held)
    assert len(held) > 800
    assert both >= 0.9 * sum(r.predicted for r in held) and both >= 0.9 * sum(labels[r.doc_id] for r in held)


def test_words_behind_a_long_opening_are_learned(spark):
    rows = [(k, "fine day out " * 8000 + ("zwiggle" if k % 2 else "lovely"), None, None, None) for k in range(30)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    m = sk.train(docs, labels, "toxic", F.lit(True))
    assert {r.doc_id for r in sk.score(docs, m).collect() if r.score >= 0.5} == {k for k in range(30) if k % 2}


def test_bag_of_a_text(spark):
    df = spark.createDataFrame([("So  so I d\ti o t, x y z i d i o t ok\n!",)], "t string")
    assert df.select(sk._bag(F.col("t")).alias("b")).first().b.split() == ["so", "t,", "ok", "idio", "xyzidiot"]


def test_nulls_no_labels_clashes_and_empty(spark):
    rows = [(1, "you zwiggle", None, None, None), (2, None, None, None, None), (2, "", None, None, None), (None, "fine " * 100_000, None, None, None), (4, "a fine day", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "2 AS y", "3 AS toxic", "4 AS margin")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (4, 0), (9, 1)], "doc_id long, toxic int")
    m = sk.train(docs, labels, "toxic", F.lit(True))
    out = sk.score(docs, m).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    kept = sk.clean(docs, m)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in out if r.score < 0.5)
    nothing = sk.train(docs, labels.limit(0), "toxic", F.lit(True))
    assert all(r.score < 0.5 for r in sk.score(docs, nothing).collect())
    assert sk.score(docs.limit(0), m).collect() == []


def test_kernel_to_holds_only_subsequences_that_landmarks_have():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, 6).astype(np.uint8)) for _ in range(200)]
    codes = sk.encode(words)
    room = np.zeros((200, sk.CLASSES**sk.ORDER), np.float32)
    marks = sk.choose_landmarks(codes, 200, out=room)
    assert np.shares_memory(marks, room) and len(marks) > 150
    tracemalloc.start()
    got = sk.kernel_to(marks, codes[:20])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.8 * marks.nbytes
    assert np.allclose(got, np.stack([sk.profile(c) for c in codes[:20]]) @ marks.T, atol=1e-5)


def test_packed_words_are_the_windows_of_each():
    words = [b"idiot", b"Ab", b"...", b"x" * 60, "ch\u00f6\u00df".encode(), b""]
    packed = sk.pack(words)
    ends = [*packed.first[1:], len(packed.start) - 1]
    got = [[packed.symbols[packed.start[i] : packed.start[i + 1]].tolist() for i in range(a, b)] for a, b in zip(packed.first, ends)]
    assert got == [[w.tolist() for w in sk._windows(c)] for c in sk.encode(words)]
