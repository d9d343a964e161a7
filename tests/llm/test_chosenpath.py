import random

import numpy as np
import pytest

from tablescope.llm import chosenpath as cp
from tablescope.llm.components import components

from tests.conftest import SF01

from .conftest import same_as_sql


def test_same_as_sql(spark):
    same_as_sql(spark, "op6_jaccard_join", SF01)


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    near = {i: [j for j in ids if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in ids}
    top = {}
    for i in ids:
        if i not in top:
            stack, own = [i], {i}
            while stack:
                for j in near[stack.pop()]:
                    if j not in own:
                        own.add(j)
                        stack.append(j)
            top |= dict.fromkeys(own, min(own))
    return {i: (top[i], min(j for j in ids if sets[j] == sets[i]) if sets[i] else i, len(near[i])) for i in ids}


def made(seed=2):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(800)]
    rows = []
    passage = [rng.choice(words) for _ in range(60)]
    while len(rows) < 260:
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 12, 60, 200]))]
        if rng.random() < 0.3:
            base = base + passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    return rows


def check(spark, rows, path):
    out = cp.join(spark.read.parquet(f"{path}/documents.parquet")).collect()
    want = brute(rows)
    assert {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in out} == want and len(out) == len(rows)


def test_against_brute_force(spark, corpus):
    rows = made()
    check(spark, rows, corpus(rows))


def test_split_nodes_dense_leaves_and_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(cp, "LEAF", 8)
    monkeypatch.setattr(cp, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    rows = made(5)[:150]
    for _ in range(90):
        w = list(base)
        w[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((len(rows) + 1000, " ".join(w)))
    check(spark, rows, corpus(rows))


def test_runs_and_min_hashes():
    r = cp.runs_for()
    assert 1 - (1 - cp.SIMILAR ** (cp.DEPTH + 1)) ** r >= cp.RECALL > 1 - (1 - cp.SIMILAR ** (cp.DEPTH + 1)) ** (r - 1)
    assert r <= cp.COORDINATES
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 9000).astype(np.uint64)
    b = np.concatenate([a[:8000], rng.integers(0, 2**63, 1000).astype(np.uint64)])
    same = (cp.min_hashes(np.unique(a)) == cp.min_hashes(np.unique(b))).mean()
    assert abs(same - 0.8) < 0.2


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 5, 4000, 6000, 3)]
    got = cp.shared_counts(sets[:3], sets[2:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(300 + k, 301 + k) for k in range(40)] + [(7, 7), (500, 500)]
    top = {}
    for a, b in edges:
        top.setdefault(a, a), top.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == top


def test_nulls_ties_empty_and_clashes(spark, corpus):
    long = " ".join(f"v{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a  b\n"), (5, "a b c"), (None, "a b"), (None, ""), (6, long), (7, long + " more"), (7, "a b"), (8, " \t")]
    path = corpus(rows)
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 AS uid", "2 AS label", "3 AS n", "4 AS sig", "5 AS rep")
    out = [r for r in cp.groups(docs).collect()]
    assert len(out) == len(rows) and sum(r.first for r in out) == 7
    by = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in out)
    assert by == sorted([("1", "1", 0), ("2", "2", 0), ("3", "3", 3), ("4", "3", 3), ("5", "5", 0), ("None", "3", 3), ("None", "None", 0), ("6", "6", 1), ("7", "6", 1), ("7", "3", 3), ("8", "8", 0)])
    kept = cp.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert cp.join(spark.read.parquet(f"{corpus([], 'none')}/documents.parquet")).collect() == []


def test_a_column_called_like_the_row_number_stays(spark, corpus):
    docs = spark.read.parquet(f"{corpus([(1, 'a b'), (2, 'a b'), (3, 'b')], 'uid')}/documents.parquet").selectExpr("*", "doc_id * 10 AS __uid", "1 AS __at")
    kept = cp.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r["__uid"]) for r in kept.collect()) == [(1, 10), (3, 30)]
