"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hotjoin import join_hot
from .scratch import Scratch


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges (u, v)``; the label is the least node it reaches.

    Each round is a written table of at most as many edges as there were, so
    nothing is collected and lineage stays short; the tables of a round are
    dropped when the next is there.  The neighbours of a hub are not gathered
    in one task.  Loops are allowed.
    """
    spark = edges.sparkSession
    held = Scratch(spark)
    nodes = held.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars-nodes")
    now, mark, last = nodes.filter("u != v"), None, Scratch(spark)
    while True:
        step, kept = Scratch(spark), Scratch(spark)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = step.keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "stars-low")
        large = join_hot(both, low.drop("n"), ["u"], counts=low.drop("m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = step.keep(large.filter("u != v").distinct(), "stars-large")
        least = step.keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "stars-least")
        small = join_hot(large, least.drop("n"), ["u"], counts=least.drop("m"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = kept.keep(small.select("e.u", "e.v").filter("u != v").distinct(), "stars")
        step.drop()
        last.drop()
        last = kept
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = roots.join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("label"))
    out = Scratch(spark).keep(labels, "components", temporary=False)
    last.drop()
    held.drop()
    return out
