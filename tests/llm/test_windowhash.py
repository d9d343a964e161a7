import random
import re

import pytest
from pyspark.sql import functions as F

from tablescope.llm import decontaminate, licenses, windowhash as wh

from tests.conftest import SF01

from .conftest import same_as_sql


def test_licenses_same_as_sql(spark):
    same_as_sql(spark, "op7_license_scan", SF01)


def test_leaks_same_as_sql(spark):
    same_as_sql(spark, "op9_decontamination", SF01, ("documents", "benchmark"))


def shingles(text):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, u in items:
            s = shingles(u)
            if s and len(s & shingles(t)) / len(s) >= 0.8:
                out.add((d, i))
    return out


def made(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(draw(rng.choice([5, 6, 9, 12, 14, 25, 40, 70, 130])))) for k in range(120)]
    docs = []
    for d in range(150):
        body = draw(rng.choice([0, 3, 30, 400, 2500]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = items[rng.randrange(120)][1].split()
            for _ in range(rng.choice([0, 0, 1])):
                w[rng.randrange(len(w))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = w
        docs.append((d, ", ".join(body[: len(body) // 2]) + "\n" + " ".join(body[len(body) // 2 :]).upper()))
    return docs, items


def test_against_brute_force(spark):
    docs, items = made()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, i).collect()}
    assert got == brute(docs, items) and len(got) > 80


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, items = made(9)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(wh, "BROADCAST_ROWS", 0)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, i).collect()} == brute(docs, items)


@pytest.mark.parametrize("bound", [8, 16, 32, 64, 128, 256])
def test_bins_keep_the_promise(bound):
    rng = random.Random(bound)
    bins = wh.bins_for(bound)
    size = 1 if bound == 8 else bound // 2 + 1
    common = -(-size * 4 // 5)
    missed = 0
    for _ in range(1500):
        both = [rng.getrandbits(64) for _ in range(common)]
        low = lambda xs: {min(g) for g in _by_bin(xs, bins)}
        a = low(both + [rng.getrandbits(64) for _ in range(size - common)])
        missed += not (a & low(both + [rng.getrandbits(64) for _ in range(wh.SPAN * bound - common)]))
    assert missed <= 8


def _by_bin(xs, bins):
    out = {}
    for x in xs:
        out.setdefault(x * bins >> 64, []).append(x)
    return out.values()


def test_nulls_ties_long_texts_and_clashes(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, item), (3, item), (None, "x " + item.upper() + "!"), (4, "pad " * 150_000 + item), (3, "other"), (5, "one two")], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS item_id", "2 AS w", "3 AS s", "4 AS v", "5 AS __id", "6 AS id")
    items = spark.createDataFrame([(7, item), (8, None), (9, "nine ten"), (10, "")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.containment) for r in decontaminate.leaks(docs, items).collect())
    assert got == [("3", 7, 1.0), ("3", 7, 1.0), ("4", 7, 1.0), ("None", 7, 1.0)]
    kept = decontaminate.drop_leaks(docs.drop("__id"), items)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5"] and kept.columns == docs.drop("__id").columns
    assert decontaminate.leaks(docs.limit(0), items).collect() == []
    assert decontaminate.leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.drop_leaks(docs.drop("__id"), items.limit(0)).count() == 8


SHORT = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa and more words after it"),
    (2, "say Alpha, beta gamma!"),
    (3, "gamma beta alpha"),
    (4, "x"),
    (None, "quick quick brown fox jumps"),
    (5, "alpha beta"),
    (6, "pad " * 50_000 + "alpha beta gamma"),
    (7, None),
    (8, ""),
]
SHORT_ITEMS = [(None, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "alpha beta gamma"), (20, "Quick"), (21, "x"), (22, "brown fox jumps over"), (23, "alpha beta"), (23, "brown fox"), (24, "x"), (24, "x"), (25, "!")]


def plain_leaks(docs, items):
    split = lambda t: [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
    out = []
    for d, t in docs:
        w = split(t)
        for i, u in items:
            v = split(u)
            n = min(5, len(v))
            runs = lambda x: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            if n and len(runs(v) & runs(w)) >= 0.8 * len(runs(v)):
                out.append((str(d), str(i)))
    return sorted(out)


@pytest.mark.parametrize("bounds", [(200_000, 16 << 20), (0, 16 << 20), (200_000, 0)])
def test_short_null_and_repeated_items(spark, monkeypatch, bounds):
    monkeypatch.setattr(wh, "BROADCAST_ROWS", bounds[0])
    monkeypatch.setattr(wh, "BROADCAST_BYTES", bounds[1])
    docs, items = spark.createDataFrame(SHORT, "doc_id long, text string"), spark.createDataFrame(SHORT_ITEMS, "item_id long, text string")
    want = plain_leaks(SHORT, SHORT_ITEMS)
    assert sorted((str(r.doc_id), str(r.item_id)) for r in decontaminate.leaks(docs, items).collect()) == want and ("1", "None") in want
    kept = decontaminate.drop_leaks(docs, items).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({str(d) for d, _ in SHORT} - {d for d, _ in want})


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in SHORT], "doc_id string, text string")
    items = spark.createDataFrame([(f"i{k}", t) for k, t in SHORT_ITEMS], "item_id string, text string")
    want = plain_leaks([(f"d{k}", t) for k, t in SHORT], [(f"i{k}", t) for k, t in SHORT_ITEMS])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == want


def test_sql_finds_short_and_null_items(spark, tmp_path):
    rows = [r for r in SHORT if len(r[1] or "") < 1000]  # the SQL copies a text's words for each of its shingles
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(SHORT_ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    same_as_sql(spark, "op9_decontamination", str(tmp_path), ("documents", "benchmark"))


def test_no_python_in_plans(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    for df in (licenses.scan(docs, licenses.templates(spark)), decontaminate.drop_leaks(docs, spark.read.parquet(f"{SF01}/benchmark.parquet"))):
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", df._jdf.queryExecution().executedPlan().toString())
    w = F.size(wh.words(F.lit(" a-b, c ")))
    assert spark.range(1).select(w.alias("n")).first().n == 3
