import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tablescope.llm import simhash as sh

from .conftest import run

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER)) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << p for p in range(64) if 2 * sum(h >> p & 1 for h in hashes) > len(hashes))


def plain_result(rows):
    """(doc_id, fingerprint, component_id) by comparing every pair of distinct fingerprints."""
    fp = [plain_fingerprint(t) for _, t in rows]
    distinct = np.array(sorted(set(fp)), np.uint64)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1 :] ^ distinct[i]) <= 3) + i + 1:
            root[find(int(j))] = find(i)
    place = {int(f): k for k, f in enumerate(distinct)}
    least = {}
    for (i, _), f in zip(rows, fp):
        if i is not None:
            k = find(place[f])
            least[k] = min(least.get(k, i), i)
    return [(i, f"{f:016x}", least.get(find(place[f]))) for (i, _), f in zip(rows, fp)]


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2] or 0)


def check(out, rows):
    assert sorted([tuple(r) for r in out.collect()], key=key) == sorted(plain_result(rows), key=key)


def test_query_against_every_pair(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    out = run(spark, "op12_simhash")
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    check(out, rows)


def variants(n, seed=3):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijkl") * 2 + str(rng.randrange(60)) for _ in range(80)] for _ in range(4)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [5, sh.BLOCK])
def test_blocks_of_large_buckets_lose_no_link(spark, corpus, monkeypatch, block):
    rows = variants(300)
    docs = spark.read.parquet(f"{corpus(rows)}/documents.parquet")
    check(sh.near_duplicates(docs, block=block), rows)


def test_nulls_empty_short_long_and_repeated_rows(spark, corpus):
    rows = [(5, None), (4, ""), (3, " \n"), (None, "one two"), (7, "One\ttwo"), (7, "One\ttwo"), (None, "nothing like it at all here"), (8, "word " * 200_000), (9, "É A"), (10, "é a")]
    docs = spark.read.parquet(f"{corpus(rows)}/documents.parquet")
    check(sh.near_duplicates(docs), rows)
    clash = docs.selectExpr("*", "1 AS fp", "2 AS label", "3 AS n", "4 AS least", "5 AS component_id")
    check(sh.near_duplicates(clash), rows)
    empty = spark.read.parquet(f"{corpus([], 'empty')}/documents.parquet")
    assert sh.near_duplicates(empty).collect() == []


def test_bit_slices_against_pairs():
    rng = np.random.default_rng(4)
    for radius in (2, 3, 5):
        base = rng.integers(0, 1 << 63, size=9, dtype=np.uint64)
        fp = base[rng.integers(0, 9, 150)]
        for k in range(len(fp)):
            for _ in range(rng.integers(0, 5)):
                fp[k] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
        bounds, other = np.array([0, 1, 70, 150]), np.array([0, 1, 90])
        label = sh.forests(fp, bounds, other, radius=radius)
        root = np.arange(150)
        for low, high, mid in ((1, 70, 1), (70, 150, 90)):
            for i in range(low, high if mid == low else mid):
                for j in range(mid, high):
                    if np.bitwise_count(fp[i] ^ fp[j]) <= radius:
                        a, b = root[i], root[j]
                        root[root == max(a, b)] = min(a, b)
        assert label.tolist() == root.tolist()


def test_short_texts_have_one_shingle():
    texts = ["a", "a b", "a b c", "A  b\nc"]
    assert sh.fingerprints(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]
