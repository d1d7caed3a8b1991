"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, has_rows

#: Rounds that contract towards the smallest id; later rounds use a random order, which shrinks any graph (long
#: sorted chains too) by a constant factor, and need one more pass for the smallest id.
ORDERED_ROUNDS = 6


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id reachable from each node that has a link.

    Each round sends every node to the first of its closed neighbourhood and contracts the links; the graph shrinks
    geometrically, so the number of rounds grows with the logarithm of the longest path. Neighbourhoods are reduced by
    min(), which combines before the shuffle, so hubs cost no more than other nodes. Nothing is gathered on the driver.
    """
    def clean(x: DataFrame) -> DataFrame:
        x = x.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        return x.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    links = cut(clean(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    steps: list[DataFrame] = []
    while has_rows(links):
        k = len(steps)
        rank = lambda c, k=k: F.struct(F.lit(0).cast("long").alias("o") if k < ORDERED_ROUNDS else F.xxhash64(F.col(c), F.lit(k)).alias("o"), F.col(c).alias("id"))
        both = links.select("u", rank("v").alias("r")).union(links.select(F.col("v").alias("u"), rank("u").alias("r")))
        first = both.groupBy("u").agg(F.min("r").alias("r"))
        steps.append(cut(first.select(F.col("u").alias("node"), F.least("r", rank("u"))["id"].alias("root"))))
        s = steps[-1]
        left, right = s.toDF("u", "ru"), s.toDF("v", "rv")
        links = cut(clean(links.join(left, "u").join(right, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))))
    if not steps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = steps[0]
    for s in steps[1:]:
        out = out.join(s.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    if len(steps) > ORDERED_ROUNDS:
        low = out.groupBy("root").agg(F.min("node").alias("component"))
        return cut(out.join(low, "root").select("node", "component"))
    return cut(out.select("node", F.col("root").alias("component")))
