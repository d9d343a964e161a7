from collections import Counter, defaultdict

from tablescope.llm import grace_dedup as gd

from .conftest import same_as_sql


def test_same_as_sql(spark):
    same_as_sql(spark, "op10_exact_dedup")


def brute(rows):
    import re

    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[ \t-\r]+", " ", t or "")].append(i)
    return groups


def check(spark, rows, path, **kw):
    out = gd.deduplicate(spark.read.parquet(f"{path}/documents.parquet"), **kw).collect()
    groups = brute(rows)
    assert len(out) == len(rows)
    size = {i: len(g) for g in groups.values() for i in g if i is not None}
    keep = {i: min(x for x in g if x is not None) for g in groups.values() for i in g if i is not None}
    for r in out:
        if r.doc_id is not None:
            assert (r.group_size, r.keep_id) == (size[r.doc_id], keep[r.doc_id])
    assert sum(r.kept for r in out) == len(groups)
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept.values()) <= {1}


def test_nulls_spaces_ties_and_long_texts(spark, corpus):
    long = "word " * 200_000
    rows = [(1, "a  b"), (2, "a b"), (3, "a\tb"), (4, None), (5, ""), (6, " "), (None, "x"), (None, "x"), (7, long), (8, long), (9, "a b"), (9, "c"), (10, "é")]
    check(spark, [r for r in rows if r[0] != 9] + [(11, "a b")], corpus([r for r in rows if r[0] != 9] + [(11, "a b")]))
    out = gd.deduplicate(spark.read.parquet(f"{corpus(rows, 'ties')}/documents.parquet")).collect()
    x = [r for r in out if r.doc_id is None]
    assert [r.keep_id for r in x] == [None, None] and sum(r.kept for r in x) == 1 and x[0].group_size == 2


def test_small_tables_deal_again_and_fold_hot_texts(spark, corpus):
    rows = [(i, f"text {i % 37} " + "y" * (i % 5)) for i in range(400)] + [(1000 + i, "hot " * 50) for i in range(400)]
    path = corpus(rows, files=6)
    check(spark, rows, path, table_bytes=600)
    check(spark, rows, path)


def test_equal_hashes_are_not_equal_texts():
    t = gd.OpenTable(4)
    assert [t.add(5, x) for x in ("a", "b", "a", "c", "b", "d", "e")] == [(0, True), (1, True), (0, False), (2, True), (1, False), (3, True), (4, True)]


def test_empty_table_and_clashing_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus([])}/documents.parquet")
    assert gd.deduplicate(docs).collect() == []
    path = corpus([(1, "a"), (2, "a"), (3, "b")], "clash")
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 AS uid", "2 AS head", "3 AS h", "4 AS kept", "5 AS first")
    kept = gd.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert len(gd.deduplicate(docs).collect()) == 3


def test_a_column_called_like_the_row_number_stays(spark, corpus):
    docs = spark.read.parquet(f"{corpus([(1, 'a'), (2, 'a'), (3, 'b')], 'uid')}/documents.parquet").selectExpr("*", "doc_id * 10 AS __UID")
    kept = gd.keep_first(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r["__UID"]) for r in kept.collect()) == [(1, 10), (3, 30)]
