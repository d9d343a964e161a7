"""N-gram Jaccard join along chosen paths.

Two texts are linked when the Jaccard similarity of their sets of five-word
shingles is at least ``SIMILAR``.

1. A text's set becomes ``COORDINATES`` min-hashes; equal sets are one class
   from here on, with the number of its documents as weight.
2. In each run a class follows one path: at a node the hash of run and path
   chooses a coordinate and the classes are split by their min-hash there, a
   token that the classes of the new node share.  A node of at most ``LEAF`` classes is a leaf;
   after ``DEPTH`` splits a node is a leaf anyway.  Similar classes stay
   together at a split with the chance of their similarity, so ``runs_for``
   gives the number of runs that finds a pair at the threshold with the
   target recall even along the longest path.
3. Small leaves are compared by brute force on the min-hashes, with a lower
   threshold than asked for; in a leaf that could not be split all classes
   share many tokens and are taken together.  The result is a forest, whose
   components hold all links.
4. Every component is verified by the exact sets.  A large one is dealt into
   blocks, and each pair of blocks is a group of its own.  What comes back
   is a number of links for each class and a forest, not the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import byte_slices, bytes_of, mix, shingles, unused_name, word_hashes
from .components import components
from .hotjoin import join_hot, only_members
from .scratch import Scratch

SIMILAR = 0.8
RECALL = 0.999  #: of a pair at the threshold along the longest path
DEPTH = 3  #: splits after the first
LEAF = 256
COORDINATES = 64
ALIKE = 0.6  #: of the coordinates: four deviations below the threshold
BLOCK = 256  #: classes of a block in the exact check
WIDTH = 5

_SETS = "uid long, doc_id long, k1 long, k2 long, n int, sig array<int>, text string"
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def runs_for(recall: float = RECALL, depth: int = DEPTH, similar: float = SIMILAR) -> int:
    """Runs after which a pair at the threshold was in a common leaf with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similar ** (depth + 1)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uid, doc_id, text) with the set's identity (128 bits), size and min-hashes."""
    for part in byte_slices(batches, "text"):
        hashes, at = word_hashes(*bytes_of(part.column("text")))
        k1, k2, size, sig = [], [], [], []
        for i in range(part.num_rows):
            s = shingles(hashes[at[i] : at[i + 1]], WIDTH)
            size.append(len(s))
            k1.append(int(s.sum().astype(np.int64)) if len(s) else 0)
            k2.append(int(mix(s).sum().astype(np.int64)) if len(s) else 0)
            sig.append(min_hashes(s) if len(s) else None)
        columns = [part.column("uid"), part.column("doc_id"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(size, pa.int32()), pa.array(sig, pa.list_(pa.int32())), part.column("text")]
        yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "k1", "k2", "n", "sig", "text"])


def min_hashes(s: np.ndarray) -> np.ndarray:
    """For every coordinate the least of the set's hashes, as 32 bits."""
    out = np.empty(COORDINATES, np.uint64)
    for i in range(0, len(s), 4096):
        block = ((s[None, i : i + 4096] * _SEEDS[:, None]) >> np.uint64(32)).min(1)
        out = np.minimum(out, block) if i else block
    return out.astype(np.uint32).view(np.int32)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that are sorted by ``keys``, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in columns) != last
        start = 0
        for cut in np.flatnonzero(change):
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each member's tree when these pairs are joined."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(k) for k in range(n)])


def _alike(sig: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a leaf whose min-hashes agree in enough coordinates and whose sizes allow a link."""
    least = math.ceil(ALIKE * sig.shape[1])
    for i in range(len(sig) - 1):
        same = (sig[i + 1 :] == sig[i]).sum(1)
        fits = np.minimum(size[i + 1 :], size[i]) >= SIMILAR * np.maximum(size[i + 1 :], size[i]) - 1e-9
        right = np.flatnonzero((same >= least) & fits) + i + 1
        if len(right):
            yield np.full(len(right), i), right


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (run, path, uid, n, sig) -> edges between alike classes of a leaf."""
    out_u: list[np.ndarray] = []
    out_v: list[np.ndarray] = []
    for group in _groups(batches, ["run", "path"]):
        uid = group.column("uid").to_numpy()
        sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(len(uid), -1)
        root = forest(len(uid), _alike(sig, group.column("n").to_numpy()))
        linked = root != np.arange(len(uid))
        out_u.append(uid[linked])
        out_v.append(uid[root[linked]])
        if len(out_u) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], names=["u", "v"])
            out_u, out_v = [], []
    if out_u:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], names=["u", "v"])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections [left, right] of sorted sets."""
    sets = left + right
    every = np.concatenate(sets)
    values, code, seen = np.unique(every, return_inverse=True, return_counts=True)
    code = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[code]  # what one set has alone is not shared
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[code >= 0]
    code = code[code >= 0]
    out = np.zeros((len(left), len(right)), np.float32)
    columns = 4096
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        a, b = np.searchsorted(code, [start, start + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[a:b], code[a:b] - start] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (label, bi, bj, b, uid, weight, text) -> links of every class in its group, and a forest."""
    for group in _groups(batches, ["label", "bi", "bj"]):
        hashes, at = word_hashes(*bytes_of(group.column("text")))
        sets = [shingles(hashes[at[i] : at[i + 1]], WIDTH) for i in range(group.num_rows)]
        uid, weight, b = (group.column(c).to_numpy() for c in ("uid", "weight", "b"))
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        rows, cols = np.flatnonzero(b == bi), np.flatnonzero(b == bj)
        links, root = np.zeros(len(uid), np.int64), np.arange(len(uid))
        if len(rows) and len(cols):
            size = np.array([len(s) for s in sets], np.float64)
            both = shared_counts([sets[k] for k in rows], [sets[k] for k in cols]).astype(np.float64)
            linked = both >= SIMILAR * (size[rows][:, None] + size[cols][None, :] - both) - 1e-9
            if bi == bj:
                np.fill_diagonal(linked, False)
            links[rows] += linked @ weight[cols]
            if bi != bj:
                links[cols] += linked.T @ weight[rows]
            i, j = np.nonzero(np.triu(linked) if bi == bj else linked)
            root = forest(len(uid), [(rows[i], cols[j])])
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(uid[root]), pa.array(links)], names=["u", "v", "links"])


def _split(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The leaves of all runs: rows (run, path, uid) of small ones, edges of those that stayed large."""
    runs = runs_for()
    first = classes.select("uid", F.posexplode(F.slice("sig", 1, runs)).alias("run", "value"))
    nodes = first.select("uid", "run", F.xxhash64("run", "value").alias("path"))
    small, dense = None, None
    for depth in range(DEPTH + 1):
        sized = nodes.groupBy("run", "path").agg(F.count("*").alias("held"), F.min("uid").alias("low")).filter("held > 1")
        sized = scratch.keep(sized, "paths-sizes")
        # A node that cannot be split holds all its classes again and again: it must not meet in one task.
        known = join_hot(nodes, sized, ["run", "path"], counts=sized.select("run", "path", F.col("held").alias("n")))
        known = scratch.keep(known, "paths")
        leaves = known.filter(F.col("held") <= LEAF).select("run", "path", "uid")
        small = leaves if small is None else small.union(leaves)
        large = known.filter(F.col("held") > LEAF)
        if depth == DEPTH:
            dense = large.select(F.col("uid").alias("u"), F.col("low").alias("v"))
        else:
            chosen = F.pmod(F.xxhash64("path", F.lit(depth)), F.lit(COORDINATES)).cast("int")
            split = large.join(classes.select("uid", "sig").hint("merge"), "uid")
            nodes = scratch.keep(split.select("uid", "run", F.xxhash64("path", chosen, F.get("sig", chosen)).alias("path")), "paths-split")
    return small, dense


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``uid, doc_id, class_id, copy_id, n_links, first`` of every row of ``docs``.

    ``class_id`` is the smallest id of the documents that links connect,
    ``copy_id`` that of the documents with the same set of shingles, and
    ``n_links`` the number of other documents that are linked to this one
    directly, copies included.  ``first`` marks one row of each class, of
    those with its smallest id the first.  ``uid`` is
    ``monotonically_increasing_id()`` of ``docs``, stable for files.

    Words are parted by ASCII white space.  A text of one to four words has
    one shingle, all of it; NULL texts and texts without words have none,
    link to nothing and are classes of their own.  A NULL id counts as
    larger than any other.  Classes of links may be of any size.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    path = scratch_path(spark, "jaccard-sets")
    rows.mapInArrow(_sets, _SETS).write.option("compression", "zstd").parquet(path)
    sets = spark.read.schema(_SETS).parquet(path)
    scratch = Scratch(spark)
    narrow = sets.select("uid", "doc_id", F.when(F.col("n") > 0, F.lit(0)).otherwise(F.col("uid")).alias("alone"), "k1", "k2", "n")
    same = ["k1", "k2", "n", "alone"]
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    copies = scratch.keep(narrow.groupBy(*same).agg(F.min("uid").alias("rep"), F.count("*").alias("weight"), head.alias("head")), "jaccard-copies")
    reps = copies.filter("n > 0").select(F.col("rep").alias("uid"), "weight")
    classes = scratch.keep(sets.select("uid", "n", "sig").join(reps.hint("merge"), "uid"), "jaccard-classes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    small, dense = _split(classes, scratch)
    compared = small.join(classes.select("uid", "n", "sig").hint("merge"), "uid").repartition(parts, "run", "path").sortWithinPartitions("run", "path")
    alike = compared.select("run", "path", "uid", "n", "sig").mapInArrow(_leaves, "u long, v long")
    labels = components(alike.union(dense))

    held = labels.groupBy("label").agg(F.count("*").alias("n"))
    of_label = held.select("label", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = join_hot(labels, of_label, ["label"], counts=held).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = dealt.select("label", F.col("node").alias("uid"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("label", F.least("b", "other").alias("bi"), F.greatest("b", "other").alias("bj"), "b", "uid")
    # Few texts are members of any component: the others are left where they lie, and the plan is one at every size.
    members = labels.select(F.col("node").alias("uid"))
    texts = only_members(sets.select("uid", "text"), members, "uid").join(members.hint("merge"), "uid")
    texts = texts.join(classes.select("uid", "weight").hint("merge"), "uid")
    checked = cells.join(texts.hint("merge"), "uid").repartition(parts, "label", "bi", "bj").sortWithinPartitions("label", "bi", "bj")
    checked = checked.select("label", "bi", "bj", "b", "uid", "weight", "text").mapInArrow(_verify, "u long, v long, links long")
    verified = scratch.keep(checked, "jaccard-links")
    links = verified.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(verified.filter("u != v").select("u", "v")).select(F.col("node").alias("rep"), "label")

    of_class = copies.join(links.hint("merge"), "rep", "left").join(joined.hint("merge"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    of_class = scratch.keep(of_class, "jaccard-labelled")
    heads = scratch.keep(of_class.groupBy("label").agg(F.min("head").alias("top"), F.count("*").alias("n")), "jaccard-heads")
    per_copy = join_hot(of_class, heads.drop("n"), ["label"], counts=heads.select("label", "n"))
    per_copy = per_copy.select(*same, "weight", "head", "top", F.coalesce("links", F.lit(0)).alias("links"))
    per_copy = scratch.keep(per_copy, "jaccard-classes-labelled", temporary=False)
    scratch.drop()
    found = join_hot(narrow, per_copy, same, counts=per_copy.select(*same, "weight"), size="weight")
    return found.select(
        "uid",
        "doc_id",
        F.col("top.doc_id").alias("class_id"),
        F.col("head.doc_id").alias("copy_id"),
        (F.col("links") + F.when(F.col("n") > 0, F.col("weight") - 1).otherwise(0)).cast("long").alias("n_links"),
        (F.col("uid") == F.col("top.uid")).alias("first"),
    )


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, class_id, copy_id, n_links`` of every row; see ``groups``."""
    return groups(docs, text, key).drop("uid", "first")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` of each class of links, with all its columns; ``docs`` is read from files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "jaccard-dropped")
    uid = unused_name("__uid", docs.columns)
    groups(docs, text, key).filter(~F.col("first")).select(F.col("uid").alias(uid)).write.parquet(path)
    # The list grows with the corpus: a sort-merge join at every size, never a broadcast.
    dropped = spark.read.schema(f"{uid} long").parquet(path).hint("merge")
    return docs.withColumn(uid, F.monotonically_increasing_id()).join(dropped, uid, "left_anti").drop(uid)
