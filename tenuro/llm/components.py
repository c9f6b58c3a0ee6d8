"""Connected components by alternating stars, on edges of any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenuro.functions.lineage import discard, written

#: Joins of a star are by the key that its groups have, so both sides are moved once, and
#: nothing goes through the driver.
_JOIN = "merge"


#: Edges for each task that reads or writes them, where that is fewer tasks than there are
#: files or shuffles have: a file takes longer to open than many edges to read.
_EDGES = 20_000


def _each(rows: DataFrame, *edges: Column) -> DataFrame:
    """The edges that every row gives; unlike a union, in the same partitions."""
    return rows.select(F.explode(F.array(*edges)).alias("e")).select("e.a", "e.b")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = _each(edges, F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    joined = both.where("b > a").join(least.hint(_JOIN), "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least.hint(_JOIN), "a")
    ends = (F.struct(F.col(x).alias("a"), F.col("m").alias("b")) for x in "ba")
    return _each(joined, *ends).where("a <> b")


def components(edges: DataFrame, rounds: int = 50, tasks: int | None = None) -> DataFrame:
    """(``node``, ``component``) for every node of ``edges`` (``a``, ``b``), written.

    ``component`` is the least node of the component. Nodes without an edge don't show.
    No node's neighbours are ever collected, and a node with many of them is aggregated
    before rows are moved. Rounds grow with the logarithm of the longest path. Each writes
    its edges and deletes those of the round before. The first are written by ``tasks`` at
    most, and those that follow by as many as their number needs.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct(), "edges", tasks)
    cores = edges.sparkSession.sparkContext.defaultParallelism
    state = None
    for _ in range(rounds):
        mark = now.agg(
            F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1_000_003)
        ).first()
        if mark == state or not mark[0]:
            roots = now.select("b", "b").distinct()
            found = now.union(roots).toDF("node", "component")
            found = written(found, "components", max(cores, mark[0] // _EDGES))
            discard(now)
            return found
        state = mark
        few = max(cores, mark[0] // _EDGES)
        after = _small_star(_large_star(now.coalesce(few))).distinct()
        after = written(after, "edges", few)
        discard(now)
        now = after
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def joined_groups(
    groups: DataFrame | None, links: DataFrame, tasks: int | None = None
) -> DataFrame:
    """(``c``, ``g``): groups of nodes with ``links`` (``a``, ``b``) added to them, written.

    ``groups`` has those known before, ``g`` being the least node; None is none. Links are
    contracted to pairs of groups first, so stars run on what is new alone. Tables are
    written by ``tasks`` at most.
    """
    if groups is None:
        found = components(links, tasks=tasks)
        joined = written(found.toDF("c", "g"), "groups", tasks)
    else:
        pairs = links
        for side in "ab":
            of_side = groups.select(F.col("c").alias(side), F.col("g").alias(f"g_{side}"))
            pairs = pairs.join(of_side.hint(_JOIN), side, "left")
        pairs = pairs.select(
            F.coalesce("g_a", "a").alias("a"), F.coalesce("g_b", "b").alias("b")
        )
        found = components(pairs, tasks=tasks)
        moved = groups.join(found.toDF("g", "to").hint(_JOIN), "g", "left")
        old = moved.select("c", F.coalesce("to", "g").alias("g"))
        # A node that had no group is its own in the contracted links.
        new = found.join(groups.select(F.col("c").alias("node")).hint(_JOIN), "node", "left_anti")
        joined = written(old.union(new.select("node", "component")), "groups", tasks)
    discard(found)
    return joined
