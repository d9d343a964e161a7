"""MinHash bands over overlapping windows, in DataFrame functions only.

Both the licence scan and benchmark decontamination look for short texts
inside long ones.  Items are partitioned by size into classes whose upper
bounds are powers of two.  For a class with bound ``u`` every document is cut
into windows of ``SPAN * u`` five-word shingles that overlap by ``u``, so that a
passage of an item lies whole in some window.

A window's sketch is one-permutation MinHash: shingle hashes are sorted, the
top bits name a bin and the first of each bin is its minimum.  Each bin is a
band of one row.  An item and a window that share a bin's minimum meet in a
hash join.  ``bins_for`` takes the fewest bins with which an item whose
shingles are contained by the threshold misses with a chance below ``MISS``.

Items of fewer than five words are one shingle of all their words.  They meet
the runs of as many words of a document by their hashes, without windows.

A pair that met is verified on the complete document: the part of the item's
distinct shingles, as text, that occur anywhere in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

WIDTH = 5  #: words of a shingle
CONTAINED = 0.8
MISS = 1e-3  #: chance that a pair at the threshold is not found
SMALLEST_CLASS = 8
SPAN = 8  #: size of a window in bounds of its class; wider windows overlap less and need more bins
BROADCAST_ROWS = 200_000  #: of item sketches (16 bytes a row) or items; beyond it the join shuffles
BROADCAST_BYTES = 16 << 20  #: of the items' shingles as text
SALTS = 32  #: parts that the rows of one item are dealt to where the items are too many to broadcast


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; NULL has none."""
    raw = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+")
    first = F.when(F.get(raw, F.lit(0)) == "", 2).otherwise(1)
    last = F.size(raw) - F.when(F.get(raw, F.size(raw) - 1) == "", 1).otherwise(0)
    return F.slice(raw, first, F.greatest(F.lit(0), last - first + 1))


def once(value: Column) -> Column:
    """One row with the value, behind a generator: the optimizer cannot copy it into each use."""
    return F.explode(F.array(value))


def _runs(w: str, width: str) -> str:
    """Start positions of the runs of ``width`` words of the array ``w``."""
    return f"IF(size({w}) < {width}, CAST(array() AS ARRAY<INT>), sequence(0, size({w}) - {width}))"


def hashed_shingles(w: str, width: int = WIDTH) -> Column:
    """64-bit hashes of the runs of ``width`` words, in order, with repeats."""
    parts = ", ".join(f"get({w}, i + {k})" for k in range(width))
    return F.expr(f"transform({_runs(w, str(width))}, i -> xxhash64({parts}))")


def text_shingles(w: str, width: str = str(WIDTH)) -> Column:
    """The distinct shingles themselves; ``width`` is a number or a column."""
    return F.expr(f"array_distinct(transform({_runs(w, width)}, i -> array_join(slice({w}, i + 1, {width}), ' ')))")


def class_of(size: Column) -> Column:
    """The size class of an item: the least power of two that holds its shingles."""
    return F.greatest(F.lit(SMALLEST_CLASS), F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))).cast("int"))


def bins_for(bound: int, miss: float = MISS, contained: float = CONTAINED) -> int:
    """The fewest bins (a power of two) that find an item of this class with chance ``1 - miss``.

    Taken at the smallest item of the class, contained by the threshold in a
    full window of other shingles: each common shingle is its bin's minimum
    with chance ``(b / U) * (1 - exp(-U / b))`` for ``U`` shingles in ``b`` bins.
    """
    smallest = 1 if bound == SMALLEST_CLASS else bound // 2 + 1
    common = max(1, math.ceil(contained * smallest))
    union = SPAN * bound + smallest - common
    bins = 2
    while (1 - bins / union * (1 - math.exp(-union / bins))) ** common > miss:
        bins *= 2
    return bins


def sketch(shingles: str, bins: int) -> str:
    """The bins' minima of one array of hashes: sorted, the first of each bin."""
    shift = 64 - int(math.log2(bins))
    return f"filter({shingles}, (v, i) -> i = 0 OR shiftright(v, {shift}) != shiftright(get({shingles}, i - 1), {shift}))"


def window_sketches(shingles: str, bound: int, bins: int) -> Column:
    """The distinct minima of all windows of an array of hashes in order."""
    size, step = SPAN * bound, (SPAN - 1) * bound
    count = f"greatest(1, CAST(ceil((size({shingles}) - {size}) / {step}) AS INT) + 1)"
    sorted_windows = f"transform(sequence(0, {count} - 1), k -> sort_array(slice({shingles}, k * {step} + 1, {size})))"
    return F.expr(f"array_distinct(flatten(transform({sorted_windows}, s -> {sketch('s', bins)})))")


def write_items(items: DataFrame) -> DataFrame:
    """``uid, item_id, item, width`` of the items that have words, written.

    ``item`` holds the distinct shingles of ``width`` words.  Every row has a
    number of its own, so NULL and repeated ids stay apart; it is written, so a
    lost executor cannot change it.
    """
    spark = items.sparkSession
    worded = items.select("item_id", once(words(F.col("text"))).alias("w")).withColumn("width", F.least(F.lit(WIDTH), F.size("w")))
    shingled = worded.filter("width > 0").select(F.monotonically_increasing_id().alias("uid"), "item_id", once(text_shingles("w", "width")).alias("item"), "width")
    path = scratch_path(spark, "window-items")
    shingled.write.parquet(path)
    return spark.read.schema(shingled.schema).parquet(path)


def candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (doc_id, uid, width) whose sketches meet; written, so its size is known to later joins.

    ``docs`` has ``doc_id, text``; ``known`` comes from ``write_items``.
    """
    spark = docs.sparkSession
    hashes = F.transform("item", lambda x: F.call_function("xxhash64", *[F.get(F.split(x, " "), F.lit(k)) for k in range(WIDTH)]))
    sized = known.filter(F.col("width") == WIDTH).select("uid", once(hashes).alias("s")).withColumn("bound", class_of(F.size("s")))
    bounds = sorted(r.bound for r in sized.select("bound").distinct().collect())
    short = sorted(r.width for r in known.filter(F.col("width") < WIDTH).select("width").distinct().collect())
    schema = T.StructType([docs.schema["doc_id"], T.StructField("uid", T.LongType()), T.StructField("width", T.IntegerType())])
    if not bounds and not short:
        return spark.createDataFrame([], schema)
    bins = {b: bins_for(b) for b in bounds}
    of_items, sketches = None, []
    for b in bounds:
        part = sized.filter(F.col("bound") == b).withColumn("s", F.sort_array("s")).select("uid", F.lit(b).alias("bound"), F.explode(F.expr(sketch("s", bins[b]))).alias("v"))
        of_items = part if of_items is None else of_items.unionByName(part)
        sketches.append(F.struct(F.lit(b).alias("bound"), window_sketches("s", b, bins[b]).alias("vs")))
    for n in short:  # their class is the width, less than any bound
        one = F.split(F.get("item", F.lit(0)), " ")
        part = known.filter(F.col("width") == n).select("uid", F.lit(n).alias("bound"), F.xxhash64(*[F.get(one, F.lit(k)) for k in range(n)]).alias("v"))
        of_items = part if of_items is None else of_items.unionByName(part)
        sketches.append(F.struct(F.lit(n).alias("bound"), F.array_distinct(hashed_shingles("w", n)).alias("vs")))
    if of_items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        of_items = F.broadcast(of_items)
    shingled = docs.select("doc_id", once(words(F.col("text"))).alias("w"))
    shingled = shingled.select("doc_id", *(["w"] if short else []), once(hashed_shingles("w")).alias("s"))
    if not short:
        shingled = shingled.filter(F.size("s") > 0)
    per_class = shingled.select("doc_id", F.explode(F.array(*sketches)).alias("c")).select("doc_id", "c.bound", F.explode("c.vs").alias("v"))
    met = per_class.join(of_items, ["bound", "v"]).select("doc_id", "uid", F.least("bound", F.lit(WIDTH)).alias("width")).distinct()
    out = scratch_path(spark, "window-candidates")
    met.write.parquet(out)
    return spark.read.schema(schema).parquet(out)


def contained(docs: DataFrame, items: DataFrame, threshold: float = CONTAINED) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment, text_hash`` of the pairs at or above the threshold.

    ``containment`` is the part of the item's distinct five-word shingles
    that occur in the document.  Words are runs of letters and digits in
    lower case.  An item of one to four words is one shingle of all of them;
    texts without words, NULL among them, contain nothing and are not found.
    Ids may be of any type; a NULL or repeated id stands for each of its rows.
    ``items`` may be any size; it is broadcast only when counted and small,
    and an item that very many documents hold is never one task's.
    """
    docs, known = docs.select("doc_id", "text"), write_items(items.select("item_id", "text"))
    pairs = candidates(docs, known)
    found = docs.join(pairs.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")
    worded = found.select("doc_id", "uid", "width", F.xxhash64("text").alias("text_hash"), once(words(F.col("text"))).alias("w"))
    shingled = worded.select("doc_id", "uid", "text_hash", once(text_shingles("w", "width")).alias("s"))
    items_of = known.drop("width")
    size = known.agg(F.count("*").alias("n"), F.sum(F.expr("aggregate(item, 0L, (a, x) -> a + octet_length(x) + 16)")).alias("bytes")).first()
    if size.n <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES:
        both = shingled.join(F.broadcast(items_of), "uid")
    else:
        both = shingled.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS))).join(
            items_of.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["uid", "salt"]
        )
    counted = both.select("doc_id", "item_id", F.size(F.array_intersect("item", "s")).alias("n_shared"), F.size("item").alias("n_item"), "text_hash")
    return counted.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("containment") >= threshold)
