"""What nodes of a large directed graph reach: strongly connected components first, then a walk that only adds rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, dropped, kept, tidied

#: Edges of one node that meet in one join key; a node of more of them is dealt to several keys.
FAN = 4096
Cut = Callable[[DataFrame], DataFrame]


def spread(edges: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(edges, parts): edges (a, ...) with ``part``, and (a, parts) of the nodes that have more than one part.

    An edge's part comes from a hash of its target ``b``, so about ``fan`` edges share a join key, however many a node has.
    """
    many = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / fan).cast("int").alias("parts")).where("parts > 1")
    return _parted(edges, many), many


def _parted(edges: DataFrame, many: DataFrame) -> DataFrame:
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("b"), F.col("parts"))).cast("int")
    return edges.join(many, "a", "left").withColumn("part", part).drop("parts")


def _to_parts(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Each node once for each part of its edges."""
    last = F.coalesce(F.col("parts"), F.lit(1)) - 1
    return nodes.join(parts, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), last))).drop("parts")


#: Nodes of a round that are sent to the edges, which then aren't dealt.
FEW = 10_000


def walk(seeds: DataFrame, edges: DataFrame, cut: Cut = checkpointed, fan: int = FAN) -> DataFrame:
    """(who, a): every node that ``who`` reaches from its seeds (who, a), these included; ``edges``: (a, b, closed)."""
    return walk_by(seeds, edges, (), cut, fan)[0]


def walk_by(seeds: DataFrame, edges: DataFrame, names: tuple[str, ...], cut: Cut = checkpointed, fan: int = FAN) -> tuple[DataFrame, DataFrame | None]:
    """(who, a) of ``walk``, and (who, a, names) of the edges (a, b, closed, names) that led to a node.

    ``closed`` lists those who may not take the edge (null: nobody). A round joins the last round's new rows alone; what
    was visited stays as it was written, a table a round, and new rows are added. Edges are by far the most rows, so they are
    kept compressed while the walk lasts, and what a round shuffles goes before the next.
    """
    spark, held = edges.sparkSession, kept(edges.select("a", "b", "closed", *names))
    parts = cut(spread(held, fan)[1])
    hubs = not parts.isEmpty()
    dealt = _parted(held, parts) if hubs else held
    rounds, by = [cut(seeds.select("who", "a").distinct())], []
    while not rounds[-1].isEmpty():
        last = rounds[-1]
        few = last.limit(FEW + 1).count() <= FEW
        if few:
            out = held.join(last.hint("broadcast"), "a")
        else:
            out = _to_parts(last, parts).join(dealt.hint("merge"), ["a", "part"]) if hubs else last.join(dealt.hint("merge"), "a")
        onward = out.where(~F.coalesce(F.array_contains("closed", F.col("who")), F.lit(False))).select("who", F.col("b").alias("a"), *names).distinct()
        if names:
            by.append(onward := cut(onward))
            onward = onward.select("who", "a").distinct()
        rounds.append(cut(onward.join(reduce(DataFrame.unionByName, rounds).hint("merge"), ["who", "a"], "left_anti")))
        del out, onward
        if not few:
            tidied(spark)
    dropped(held)
    return reduce(DataFrame.unionByName, rounds), reduce(DataFrame.unionByName, by) if by else None


def strong_components(edges: DataFrame, cut: Cut = checkpointed) -> DataFrame:
    """(a, component): the nodes of components of more than one node, with a name for their component.

    Nodes that nothing enters or leaves are trimmed. Then every node takes the largest name that reaches it; a node that
    keeps its own is in one component with all nodes of its name that reach it. Those are removed, with the edges
    between different names, and the rest goes on. Joins and aggregates only; sizes of nodes' neighbourhoods don't matter,
    since names are combined before the shuffle.
    """
    live = cut(edges.where("a != b").select("a", "b").distinct())
    found: list[DataFrame] = []
    while True:
        before = -1
        while before != (now := live.count()) and now:
            before = now
            entered, left = live.select(F.col("b").alias("a")).distinct(), live.select(F.col("a").alias("b")).distinct()
            live = cut(live.join(entered, "a", "left_semi").join(left, "b", "left_semi").select("a", "b"))
        if not now:
            break
        names = cut(live.select("a").union(live.select("b")).distinct().withColumn("name", F.col("a")))
        while True:
            sent = live.join(names, "a").groupBy(F.col("b").alias("a")).agg(F.max("name").alias("sent"))
            names, old = cut(names.join(sent, "a", "left").select("a", F.greatest("name", "sent").alias("name"), (F.col("sent") > F.col("name")).alias("moved"))), names
            moved = not names.where("moved").isEmpty()
            names = names.drop("moved")
            if not moved:
                break
        within = cut(live.join(names, "a").join(names.toDF("b", "other"), "b").where("name = other").select("a", "b"))
        # backwards: who reaches the node that gave the name
        roots = names.where("a = name").select(F.col("name").alias("who"), "a")
        back = walk(roots, within.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(None).cast("array<string>").alias("closed")), cut)
        members = cut(back.select("a", F.col("who").alias("component")))
        found.append(members)
        gone = members.select("a")
        live = cut(within.join(gone, "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select("a", "b"))
    if not found:
        return edges.select("a", F.col("a").alias("component")).limit(0)
    out = reduce(DataFrame.unionByName, found)
    size = out.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return out.join(size, "component", "left_semi").select("a", "component")


def condensed_walk(seeds: DataFrame, edges: DataFrame, cut: Cut = checkpointed, fan: int = FAN) -> DataFrame:
    """What ``walk`` gives, by components: each is walked once for each ``who``, however many nodes it has.

    Components are those of the edges that are closed to nobody.
    """
    edges = cut(edges.select("a", "b", "closed").distinct())
    open_ = edges.where(F.col("closed").isNull() | (F.size("closed") == 0))
    parts = cut(strong_components(open_, cut))
    name = lambda rows, c: rows.join(parts.toDF(c, "__in"), c, "left").withColumn(c, F.coalesce(F.concat(F.lit("*"), "__in"), F.concat(F.lit("."), c))).drop("__in")
    small = name(name(edges, "a"), "b").where("a != b").distinct()
    reached = walk(name(seeds.select("who", "a"), "a"), small, cut, fan)
    alone = reached.where(F.startswith("a", F.lit("."))).select("who", F.substring("a", F.lit(2), F.length("a")).alias("a"))
    members = parts.select("a", F.concat(F.lit("*"), "component").alias("in"))
    return alone.unionByName(reached.withColumnRenamed("a", "in").join(members, "in").select("who", "a"))
