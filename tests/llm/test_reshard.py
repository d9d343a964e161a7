import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from tablescope.llm import reshard
from tablescope.session import scratch_path

from tests.conftest import SF001

from .conftest import run


def cheapest(supply, room, cost):
    """The least cost, by trying every way to place unit after unit."""
    units = [i for i, s in enumerate(supply) for _ in range(s)]
    best = None
    for way in itertools.product(range(len(room)), repeat=len(units)):
        if all(way.count(j) <= room[j] for j in range(len(room))):
            c = sum(cost(i, j) for i, j in zip(units, way))
            best = c if best is None else min(best, c)
    return best


@pytest.mark.parametrize("supply,room", [([5, 0, 1], [2, 2, 2]), ([3, 3], [1, 2, 3]), ([0, 4, 2], [6, 0, 0]), ([2, 2, 2], [3, 4]), ([0, 0], [1, 1])])
@pytest.mark.parametrize("cost", [lambda i, j: int(i != j), lambda i, j: (3 * i + 5 * j) % 7, lambda i, j: (i - j) ** 2])
def test_flow_is_cheapest(supply, room, cost):
    flow = reshard.cheapest_flow(supply, room, cost)
    for i, s in enumerate(supply):
        assert sum(x for (a, _), x in flow.items() if a == i) == s
    for j, r in enumerate(room):
        assert sum(x for (_, b), x in flow.items() if b == j) <= r
    assert sum(x * cost(*a) for a, x in flow.items()) == cheapest(supply, room, cost)


def test_too_little_room():
    with pytest.raises(ValueError):
        reshard.cheapest_flow([3], [2])


def test_query_law(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = run(spark, "op2_resharding", SF001).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    held, slots = [0] * 40, [[] for _ in range(40)]
    for r in out:
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "bytes", None)
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(held) - min(held) < max(r.size for r in out)


def in_memory(rows, shards):
    """Where each (old shard, size, id, checksum) goes, with plain lists."""
    room = reshard.near_equal(sum(r[1] for r in rows), shards)
    at = {r[2]: r[0] for r in rows}
    mixed = lambda r: (zlib.crc32(str(r[2]).encode()), -r[1], r[2], r[3])
    by_size = lambda r: (-r[1], r[2], r[3])
    for order in (mixed, by_size, by_size):
        by = {}
        for r in sorted(rows, key=order):
            by.setdefault(at[r[2]], []).append(r)
        flow = reshard.cheapest_flow([sum(r[1] for r in by.get(i, [])) for i in range(shards)], room)
        for i, own in by.items():
            bounds, end = [], 0
            for j in sorted((b for a, b in flow if a == i), key=lambda j: (j != i, j)):
                bounds.append((end, j))
                end += flow[i, j]
            start = 0
            for r in own:
                at[r[2]] = [j for b, j in bounds if b <= start][-1]
                start += r[1]
    return at


def test_every_row_goes_where_plain_lists_put_it(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    rows = [(zlib.crc32((d.source or "").encode()) % 40, len((d.text or "").encode()) + 16, d.doc_id, zlib.crc32((d.text or "").encode())) for d in docs]
    assert {r.doc_id: r.shard for r in run(spark, "op2_resharding", SF001).collect()} == in_memory(rows, 40)


def docs_of(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, shard int, size string, row int").write.parquet(f"{tmp_path}/d")
    return spark.read.parquet(f"{tmp_path}/d")


def test_only_changed_shards_are_rewritten_and_moves_are_few(spark, tmp_path):
    rows = [(i, "x" * (20 + i % 7), i % 4 if i < 400 else 0, "s", 1) for i in range(600)] + [(None, None, None, None, None), (3, "", 1, "", 0), (3, "", 1, "", 0)]
    docs = docs_of(spark, rows, tmp_path)
    out = scratch_path(spark, "t")
    room = [10_000, 3_900, 4_000, 5_000, 9_000]
    placed = reshard.reshard(docs, F.col("shard"), 5, out, room=room)
    got = placed.collect()
    assert len(got) == len(rows) and placed.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "moved"]
    held = [sum(r.size for r in got if r.shard == k) for k in range(5)]
    total = sum(r.size for r in got)
    assert total == sum(len((t or "").encode()) + 16 for _, t, *_ in rows)
    assert all(h <= r + 50 for h, r in zip(held, room))
    supply = [0] * 5
    for _, t, s, *_ in rows:
        supply[s or 0] += len((t or "").encode()) + 16
    least = sum(x for (i, j), x in reshard.cheapest_flow(supply, room).items() if i != j)
    assert sum(r.size for r in got if r.moved) <= least + 5 * 100
    for k in range(5):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    same = {k for k in range(5) if not any(r.moved and r.shard == k for r in got) and supply[k] <= room[k] and held[k] == supply[k]}
    written = {int(r.shard) for r in spark.read.parquet(out).select("shard").distinct().collect()}
    assert written.isdisjoint(same) and written


def test_empty(spark, tmp_path):
    assert reshard.reshard(docs_of(spark, [], tmp_path), F.col("shard"), 4, scratch_path(spark, "t")).collect() == []


def test_copies_without_ids_are_dealt_out(spark, tmp_path):
    """A third of all rows agree in all columns."""
    rows = [(i, "x" * (20 + i % 7), 0, "s", 1) for i in range(2000)] + [(None, "copy of a text", 0, "s", 1)] * 1000
    placed = reshard.reshard(docs_of(spark, rows, tmp_path), F.col("shard"), 10, scratch_path(spark, "t")).collect()
    held = [sum(r.size for r in placed if r.shard == k) for k in range(10)]
    assert len(placed) == len(rows) and sum(r.doc_id is None for r in placed) == 1000
    assert max(held) - min(held) <= 2 * max(r.size for r in placed)
    for k in range(10):
        assert sorted(r.slot for r in placed if r.shard == k) == list(range(sum(r.shard == k for r in placed)))
