"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node it reaches.

    Each round hangs every node's larger neighbours below its smallest one, then its smaller ones;
    a few rounds suffice, and a node with many links is only ever counted, joined and split by Spark.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    edges = written(edges.distinct(), "stars")
    while True:
        both = edges.unionAll(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("m", "node").alias("m"))
        # large star: neighbours beyond the node go to its smallest neighbour
        large = both.join(least, "node").filter("root > node").select(F.col("root").alias("node"), F.col("m").alias("root"))
        large = written(large.distinct(), "stars")
        # small star: the rest go to the smallest of them
        under = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(under, "node").select(F.explode(F.array(F.struct("node", F.col("m").alias("root")), F.struct(F.col("root").alias("node"), F.col("m").alias("root")))).alias("e"))
        out = written(small.select("e.*").filter("node > root").distinct(), "stars")
        # all are stars once no node has two roots or is one itself
        ends = out.select(F.explode(F.array(F.struct(F.col("node").alias("x"), F.lit(1).alias("k")), F.struct(F.col("root").alias("x"), F.lit(0).alias("k")))).alias("e"))
        ends = ends.groupBy("e.x").agg(F.sum("e.k").alias("above"), F.min("e.k").alias("least"))
        discard(edges, large)
        edges = out
        if ends.filter("above > 1 or above = 1 and least = 0").isEmpty():
            return edges
