"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import drop, written


def ends(tree: DataFrame, *rows: Column) -> DataFrame:
    """Several rows for each edge, made in one pass over the table."""
    return tree.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def settled(tree: DataFrame) -> bool:
    """Whether every node hangs below one that hangs below none."""
    nodes = ends(tree, F.struct(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    return nodes.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below")).filter("above + below > 1 and above > 0").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge names, as a table that ``drop`` deletes; the component is its smallest node.

    Alternates the large-star and small-star steps, which hang every node below the smallest one that it knows: the
    number of rounds grows with the logarithm of the longest path.  Minima are aggregated map-side, so a node with very
    many neighbours is no hot key there; the joins that follow are dealt anew by AQE where they are skewed.  Each round
    is cut by a table in the shared folder, which is read in as many tasks as its size asks for, however many wrote it.
    """
    now = written(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "tree")
    for _ in range(max_rounds):
        if settled(now):
            break
        both = ends(now, F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v").unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, written(small, "tree")
        drop(before)
    else:
        raise RuntimeError("components did not settle")
    out = written(ends(now, F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "reach")
    drop(now)
    return out
