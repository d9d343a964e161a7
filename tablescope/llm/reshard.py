"""Resharding by minimum-cost flow.

From the bytes that old shards hold and the bytes that new shards may hold,
``cheapest_flow`` solves which bytes go where at least cost: a byte that
stays costs nothing, a byte that moves costs one (or what a given cost matrix
says).  The graph has one node a shard, so it is small whatever the data.

A shard's rows are put in an order.  Its first bytes stay and blocks of
consecutive rows of its tail go to the shards that the flow names.  Offsets
are exact prefix sums over range partitions, so no shard is ever sorted in one
task.  In the first round the order is a hash of the id, so every block has
rows of all sizes.  A block can only be cut between rows; the next rounds move
what that leaves over, with the largest rows first in order, so the smallest
rows move.

Only shards that gain or lose rows are rewritten.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

ROW_BYTES = 16  #: what a row takes besides its text
PART_BYTES = 64 << 20
PART_ROWS = 1 << 20
NO_ID = -(1 << 63)  #: stands for a NULL id in the order of rows
_MIXED = ["id_crc32", "neg_size", "doc_id", "text_crc32", "uid"]
_BY_SIZE = ["neg_size", "doc_id", "text_crc32", "id_crc32", "uid"]
ROUNDS = (_MIXED, _BY_SIZE, _BY_SIZE)  #: the order of rows in each round


def cheapest_flow(supply: list[int], room: list[int], cost: Callable[[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Amounts ``{(i, j): x}`` that bring all supply into the rooms at least cost.

    Successive shortest paths: Dijkstra with potentials finds the distances,
    a breadth-first search over tight arcs takes the path with the fewest
    arcs, lowest indices first, which makes the result unique.
    """
    if sum(supply) > sum(room):
        raise ValueError("the new shards cannot hold the data")
    cost = cost or (lambda i, j: int(i != j))
    n, m = len(supply), len(room)
    source, sink = n + m, n + m + 1
    price = {(i, n + j): cost(i, j) for i in range(n) for j in range(m)}
    flow = dict.fromkeys(price, 0)
    supply, room = list(supply), list(room)
    potential = [0] * (n + m + 2)

    def arcs(u: int):
        """Arcs with room left: (end, cost)."""
        if u == source:
            for i in range(n):
                if supply[i]:
                    yield i, 0
        elif u < n:
            for j in range(m):
                yield n + j, price[u, n + j]
        elif u < n + m:
            if room[u - n]:
                yield sink, 0
            for i in range(n):
                if flow[i, u]:
                    yield i, -price[i, u]

    while any(supply):
        far = [float("inf")] * (n + m + 2)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for v, c in arcs(u):
                if (e := d + c + potential[u] - potential[v]) < far[v]:
                    far[v] = e
                    heapq.heappush(heap, (e, v))
        potential = [p + min(f, far[sink]) for p, f in zip(potential, far)]
        while True:  # all shortest paths of this length
            came, queue = {source: source}, deque([source])
            while queue and sink not in came:
                u = queue.popleft()
                for v, c in arcs(u):
                    if v not in came and c + potential[u] == potential[v]:
                        came[v] = u
                        queue.append(v)
            if sink not in came:
                break
            path = [sink]
            while path[-1] != source:
                path.append(came[path[-1]])
            path.reverse()
            first, last = path[1], path[-2] - n
            x = min(supply[first], room[last], *(flow[v, u] for u, v in zip(path[1:-2], path[2:-1]) if u >= n))
            for u, v in zip(path[1:-2], path[2:-1]):
                if u < n:
                    flow[u, v] += x
                else:
                    flow[v, u] -= x
            supply[first] -= x
            room[last] -= x
    return {(i, j - n): x for (i, j), x in flow.items() if x}


def near_equal(total: int, shards: int) -> list[int]:
    """``total`` in ``shards`` parts that differ by one at most."""
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def _with_start(spark: SparkSession, rows: DataFrame, parts: int, order: list[str]) -> DataFrame:
    """``rows`` with ``start``: bytes before a row in its shard.

    Range partitions are written with their number, so a lost executor
    cannot shift them; sums by (partition, shard) then give the offsets.
    """
    path = scratch_path(spark, "reshard")
    rows.repartitionByRange(parts, "shard", *order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    pieces = placed.groupBy("part", "shard").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("part", "shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["part", "shard"]).withColumn(
        "start", F.col("offset") + F.col("inner")
    )


def _cuts(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """Blocks (old shard, first byte, end, new shard): what stays is first, then by new shard."""
    cuts, at = [], {}
    for i, j in sorted(flow, key=lambda a: (a[0], a[1] != a[0], a[1])):
        start = at.get(i, 0)
        at[i] = start + flow[i, j]
        cuts.append((i, start, at[i], j))
    return cuts


def measures(text: str, key: str) -> list[Column]:
    """Size, checksum and order of a row; a NULL text is empty, a NULL id comes before all others."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = (F.octet_length(content) + F.lit(ROW_BYTES)).cast("long")
    return [
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        size.alias("size"),
        (-size).alias("neg_size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("id_crc32"),
    ]


def _move(rows: DataFrame, blocks: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with the shard they go to: of its shard's blocks, the last that starts at or before a row.

    ``blocks`` has a row for each old shard with at most as many blocks as
    there are new shards, whatever the data, so it is broadcast.
    """
    here = F.struct(*[F.col(c) for c in order])
    last = F.try_element_at(F.filter("blocks", lambda b: b["first"] <= here), F.lit(-1))["to"]
    joined = rows.join(F.broadcast(blocks), "shard", "left")
    return joined.withColumn("shard", F.coalesce(last, F.col("shard"))).drop("blocks")


def plan(rows: DataFrame, room: list[int]) -> tuple[list[DataFrame], list[dict[tuple[int, int], int]]]:
    """For each round, the blocks that move (old shard, first row and new shard of each) and the flow.

    A round brings the size of each shard to the driver.
    """
    spark = rows.sparkSession
    parts = max(8, rows.count() // PART_ROWS)
    found, flows = [], []
    for order in ROUNDS:
        held = {r.shard: r.held for r in rows.groupBy("shard").agg(F.sum("size").alias("held")).collect()}
        flow = cheapest_flow([held.get(i, 0) for i in range(max([len(room) - 1, *held]) + 1)], room)
        started = _with_start(spark, rows, parts, order)
        target = F.when(F.lit(False), -1)
        for i, start, _, j in reversed(_cuts(flow)):
            target = target.when((F.col("shard") == i) & (F.col("start") >= start), j)
        first = started.groupBy("shard", target.alias("to")).agg(F.min(F.struct(*order)).alias("first"))
        path = scratch_path(spark, "reshard-blocks")
        first.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("first", "to"))).alias("blocks")).write.parquet(path)
        found.append(spark.read.parquet(path))
        flows.append(flow)
        rows = _move(started.select("shard", *order, "size"), found[-1], order)
    return found, flows


def reshard(docs: DataFrame, old: Column, shards: int, out: str, text: str = "text", key: str = "doc_id", room: list[int] | None = None) -> DataFrame:
    """Rewrite the shards that change under ``out`` and return where every row of ``docs`` is.

    ``old`` gives the shard (from 0) in which a row lies; NULL counts as 0.
    ``room`` gives the bytes of each new shard (default: equal parts).  The
    files ``out/shard=K`` hold the whole rows of shard K in the order of its
    slots, for every shard K that gains or loses rows.  Returns ``doc_id,
    size, text_crc32, shard, slot, moved``, taken from those files and, for
    the other shards, from ``docs``.

    Rows that agree in id, size and checksum are told apart by their place in
    ``docs``, so copies are dealt out like other rows; ``docs`` is read more
    than once and must be read from files or otherwise give its rows in the
    same partitions each time.  The files keep a row's own columns, whatever their names, in the struct ``row``.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    shard = F.coalesce(old.cast("int"), F.lit(0))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), shard.alias("shard"), *measures(text, key), F.monotonically_increasing_id().alias("uid"))
    narrow = tagged.drop("row")
    count, total = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    found, flows = plan(narrow, room or near_equal(total, shards))
    changed = sorted({k for flow in flows for pair in flow if pair[0] != pair[1] for k in pair})
    placed = tagged.withColumn("was", F.col("shard"))
    for blocks, order in zip(found, ROUNDS):
        placed = _move(placed, blocks, order)
    parts = max(8, count // PART_ROWS, total // PART_BYTES)
    in_changed = F.col("shard").isin(changed) if changed else F.lit(False)
    ranged = placed.filter(in_changed).drop("size").repartitionByRange(parts, "shard", *_BY_SIZE).sortWithinPartitions("shard", *_BY_SIZE)
    ranged = ranged.withColumn("part", F.spark_partition_id())
    ranged.write.partitionBy("shard").parquet(out)
    schema = ranged.drop("shard").schema.add("shard", T.IntegerType())
    inner = spark.read.schema(schema).parquet(out)
    files = inner.select("part", "shard", "was", "uid", *measures(f"row.{text}", f"row.{key}"))
    path = scratch_path(spark, "reshard-still")
    still = placed.filter(~in_changed).drop("row").repartitionByRange(max(8, count // PART_ROWS), "shard", *_BY_SIZE)
    still.withColumn("part", F.spark_partition_id()).write.parquet(path)
    return _slots(files.unionByName(spark.read.parquet(path)))


def _slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 in order; only counts by (part, shard) meet."""
    pieces = rows.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part", "shard").orderBy(*_BY_SIZE)
    return rows.withColumn("nth", F.row_number().over(inside)).join(offsets, ["part", "shard"]).select(
        F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"),
        "size",
        "text_crc32",
        "shard",
        (F.col("offset") + F.col("nth") - 1).alias("slot"),
        (F.col("was") != F.col("shard")).alias("moved"),
    )
