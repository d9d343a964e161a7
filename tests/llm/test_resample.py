import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tablescope.llm import resample as rs

from .conftest import run

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def plain_result(rows, target, percent=5):
    """(doc_id, n_features, weight, score, rank) with dictionaries and a sort."""
    docs = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in docs:
        s.update(f)
    for x in target:
        t.update(plain_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for place, (i, words, f) in enumerate(docs):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words, place])
    usable = sorted([r for r in out if r[4] >= 20], key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    rank = {r[5]: k + 1 for k, r in enumerate(usable[: percent * len(usable) // 100])}
    return [(*r[:4], rank.get(r[5])) for r in out]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check(out, want):
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted([tuple(r) for r in out.collect()], key=key) == sorted(want, key=key)


def test_query_against_dictionaries(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    rows = [(r.doc_id, r.text) for r in read("documents").collect()]
    check(run(spark, "op13_resampling"), plain_result(rows, [r.text for r in read("benchmark").collect()]))


def word_rows(n):
    return [(i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(18 + i % 5))) for i in range(n)]


@pytest.mark.parametrize("percent", [0, 5, 60, 100])
def test_ties_nulls_empty_and_long_texts(spark, corpus, percent):
    text = " ".join(f"w{k}" for k in range(30))
    rows = word_rows(80) + [(None, text), (None, text), (200, text), (200, text), (200, text), (201, None), (202, ""), (203, "-- !"), (204, "W1 w2 " * 50_000)]
    docs = spark.read.parquet(f"{corpus(rows)}/documents.parquet")
    target = spark.createDataFrame([("w1 w2 w3",), (None,), ("w5 w5",)], "text string")
    want = plain_result(rows, ["w1 w2 w3", None, "w5 w5"], percent)
    check(rs.resample(docs, target, percent), want)
    check(rs.resample(docs.selectExpr("*", "1 AS score", "2 AS rank", "3 AS down", "4 AS part", "5 AS uid", "6 AS weight"), target, percent), want)


def test_rows_that_tie_in_everything(spark, corpus):
    text = " ".join(f"w{k}" for k in range(25))
    rows = [(7, text)] * 50
    docs = spark.read.parquet(f"{corpus(rows)}/documents.parquet")
    out = rs.resample(docs, docs.select("text").limit(0), 10).collect()
    assert sorted(r.rank for r in out if r["rank"] is not None) == [1, 2, 3, 4, 5] and len(out) == 50


def test_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus([])}/documents.parquet")
    assert rs.resample(docs, docs).collect() == []


def test_bisection_finds_every_order_statistic(spark, tmp_path, monkeypatch):
    values = [-(2**62), -5, -5, -5, 0, 3, 3, 2**62]
    spark.createDataFrame([(v,) for v in values], "v long").write.parquet(f"{tmp_path}/v")
    rows = spark.read.parquet(f"{tmp_path}/v")
    for want in range(1, len(values) + 1):
        v = sorted(values)[want - 1]
        assert rs.least_reaching(rows, "v", want) == (v, sum(x < v for x in values), values.count(v))


def test_checksums_of_runs():
    texts = ["a bc d", None, "x" * 200 + " y " + "z" * 66 + " é", "q"]
    at, runs = rs._features(pa.array(texts))
    got = [[] for _ in texts]
    for bucket, first in runs:
        for b, f in zip(bucket.tolist(), first.tolist()):
            got[next(i for i in range(len(texts)) if at[i] <= f < at[i + 1])].append(b)
    assert [sorted(g) for g in got] == [sorted(plain_features(t)[1]) for t in texts]
