"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import cut


def star_labels(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``x`` and its ``label`` (the smallest vertex of its component) for every vertex of the edges.

    Every step keeps one edge per vertex at most from its larger side, so a hub costs no more than its edges. The
    number of steps grows with the logarithm of the longest path. Self loops and null ends make no vertex.
    """
    cur = cut(edges.select(F.col(u).alias("a"), F.col(v).alias("b")).filter("a is not null and b is not null and a <> b"))
    before = None
    while True:
        arcs = cur.select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))))
        low = arcs.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # large star: the greater neighbours of a vertex go to the smallest of it and its neighbours
        large = arcs.filter("y > x").join(low, "x").select(F.col("m").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        floor = down.groupBy("x").agg(F.min("y").alias("m"))
        # small star: a vertex and its smaller neighbours go to the smallest of those
        small = down.join(floor, "x").select("m", F.inline(F.array(F.struct(F.col("x").alias("z")), F.struct(F.col("y").alias("z")))))
        cur = cut(small.filter("m <> z").select(F.col("m").alias("a"), F.col("z").alias("b")).distinct())
        mark = cur.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = cur.select(F.col("a").alias("x")).distinct()
    return cur.select(F.col("b").alias("x"), F.col("a").alias("label")).unionByName(roots.select("x", F.col("x").alias("label")))
