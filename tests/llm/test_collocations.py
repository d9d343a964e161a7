import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescope.llm import collocations as co

from .conftest import SCHEMA, same_as_sql

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    """Phrases of one to four words of each language, and all words of it."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII_LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, n


def plain_result(rows, top=co.TOP, least=co.LEAST):
    f, n = plain_counts(rows)
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    found = {}
    for (lang, w), a in candidates.items():
        around = [b for (l2, w2), b in candidates.items() if l2 == lang and len(w2) > len(w) and any(w2[i : i + len(w)] == w for i in range(len(w2)))]
        if any(100 * b >= 80 * a for b in around):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((score, a, " ".join(w), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, rows in found.items():
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], score) for i, (score, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


def table(spark, tmp_path, rows, files=3):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, g, None, None) for i, t, g in rows], SCHEMA).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def words_rows(n=60):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        words = [f"W{x}" if x % 3 else f"é{x}" for x in rng.zipf(1.6, 60) % 12]
        words = [w + rng.choice(["", "", "", "", ".", ",\t", "\n", " ;"]) for w in words]
        rows.append((i, " ".join(words), [None, "en", "und", "de"][i % 4]))
    return rows


def test_same_as_sql(spark):
    same_as_sql(spark, "op11_collocations")


@pytest.mark.parametrize("top", [5, 2000])
def test_against_counters(spark, tmp_path, top):
    rows = words_rows() + [(90, None, "en"), (91, "", None), (92, ". , ;", "xx"), (None, "w1 w2 w1 w2", "en"), (None, None, None), (93, "w1 w2 " * 40_000, "en"), (94, "Q", "zz")]
    docs = table(spark, tmp_path, rows)
    out = co.mine(docs, top=top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == plain_result(rows, top)
    clash = docs.selectExpr("*", "1 AS k", "2 AS w1", "3 AS c", "4 AS rank", "5 AS phrase", "6 AS h")
    assert sorted(map(tuple, co.mine(clash, top=top).collect())) == plain_result(rows, top)


@pytest.mark.parametrize("share,lowered", [(0, 1), (2, 1), (3, 9), (1, 10**6)])
def test_a_bad_sample_costs_passes_and_no_phrase(spark, tmp_path, share, lowered):
    rows = words_rows()
    docs = table(spark, tmp_path, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", "doc_id")
    sample = docs.filter(F.col("doc_id") % share == 0) if share else docs.limit(0)
    found = co.frequent(docs.select("lang", "text"), sample.select("lang", "text"), lowered_least=lowered)
    got = sorted((r.k, r.lang, r.c) for r in found.collect())
    f, n = plain_counts(rows)
    assert got == sorted([(len(w), g, a) for (g, w), a in f.items() if a >= co.LEAST] + [(0, g, a) for g, a in n.items()])


def test_empty_table(spark, tmp_path):
    assert co.mine(table(spark, tmp_path, [])).collect() == []


def test_no_frequent_phrase(spark, tmp_path):
    assert co.mine(table(spark, tmp_path, [(1, "a b c", "en"), (2, None, None)])).collect() == []


@pytest.mark.parametrize("border", [False, True])
def test_blocks_of_words_overlap(monkeypatch, border):
    texts = ["a b a b a b c a b", "", None, "a b, a b c", "a"]
    full = np.full(4096, 255, np.uint8)
    task = co.Task((0, 1, 2, 3, 4), 0, co.Filters(15, {1: full, 2: full} | ({} if border else {3: full})), border, None, 3)
    results = []
    for block in (1, 3, 1 << 18):
        monkeypatch.setattr(co, "BLOCK", block)
        held, totals = {}, {}
        for k, found in co._count_slice(pa.array(texts), np.zeros(len(texts), np.int64), ["en"], task, totals):
            held.setdefault(k, co._Held()).add(*found)
        results.append((totals, {k: sorted(zip(h.merged()[0].tolist(), h.merged()[2].tolist())) for k, h in held.items()}))
    assert results[0] == results[1] == results[2]
    f, n = plain_counts([(0, t, "en") for t in texts])
    assert results[0][0] == {0: n["en"]}
    assert set(results[0][1]) == ({1, 2, 13} if border else {1, 2, 3, 4})
    for k, rows in results[0][1].items():
        assert sorted(r[-1] for r in rows) == sorted(a for (_, w), a in f.items() if len(w) == k % 10)


def test_phrases_that_share_a_hash_stay_apart():
    p = np.array([7, 7, 7, 9], np.uint64)
    words = [np.array([1, 2, 1, 1], np.uint64)]
    _, columns, counts = co._add_up(p, words, np.array([1, 1, 1, 5]))
    assert sorted(zip(columns[0].tolist(), counts.tolist())) in ([(1, 2), (1, 5), (2, 1)], [(1, 7), (2, 1)])
    assert counts.sum() == 8


def test_parcels_come_back_and_two_words_with_one_hash_are_noticed(monkeypatch):
    rng = np.random.default_rng(2)
    task = co.Task((1, 2), 0, bucket_bits=2)
    words = np.array([3, 5, 9, 11], np.uint64)
    texts = pa.array(["a", "bc", "é", "def"])
    data, offsets = co.bytes_of(texts)
    held = co._Held()
    for _ in range(50):
        pick = rng.integers(0, 4, 30)
        code = rng.integers(0, 2, 30).astype(np.int32)
        held.add(*co._add_up(words[pick] * np.uint64(7) + code.astype(np.uint64), [code, words[pick], texts.take(pa.array(pick))], np.ones(30, np.int64)))
    for k in (1, co._BORDER + 2):
        p, columns, counts = held.merged()
        p = np.sort(rng.integers(0, 1 << 63, len(p), dtype=np.uint64)) if k == 1 else np.sort(task.border_hash(p << np.uint64(50)))
        rows = list(co._parcels(task, ["en", "de"], k, p, columns, counts))
        found = []
        for bucket in {r[0] for r in rows}:
            own = co._Bucket(bucket, k, 0)
            for row in rows:
                if row[0] == bucket:
                    own.add(*row[2:])
            found += own.summed(1).to_pylist()
        if k == 1:
            want = sorted(zip(["en" if c == 0 else "de" for c in columns[0]], columns[-1].to_pylist(), counts.tolist()))
            assert sorted((r["lang"], r["text"], r["c"]) for r in found) == want
        else:
            assert sum(r["c"] for r in found) == counts.sum() and {r["w1"] for r in found} == set(p.view(np.int64).tolist())
    monkeypatch.setattr(co, "span_hashes", lambda data, start, end, seed: (end - start).astype(np.uint64))
    own = co._Bucket(0, 1, 0)
    own.add(["en"], 3, co._packed([np.zeros(3, np.int64), np.ones(3, np.int64)]), pa.compress(b"ab\ncd\nab", codec="zstd", asbytes=True), 8)
    assert [r["k"] for r in own.summed(1).to_pylist()] == [co._CLASH]


def test_threshold_of_the_sample():
    assert [co.lowered(30, share, 0.02) for share in (1.0, 0.2, 0.001)] == [30, 2, 1] and co.lowered(30, 0.1, 0.2) == 2
