"""Iterative joins over edges: closures, hierarchies, levels and cycles.

Each round is written to the work folder, so plans stay short; loops stop on an
empty frontier and fail loudly at their bound of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablespec.operators.constraints import union_all
from tablespec.paths import written


def reach(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """All (src, dst) joined by a path of at least one edge; path lengths double each round."""
    known = written(edges.select("src", "dst").distinct())
    for _ in range(rounds):
        step = known.select(F.col("src").alias("_s"), F.col("dst").alias("src")).join(known, "src").select(F.col("_s").alias("src"), "dst").distinct()
        new = written(step.join(known, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return known
        known = written(known.unionByName(new))
    raise ValueError(f"closure not reached in {rounds} rounds")


def recursive_view(base: DataFrame, edges: DataFrame, max_depth: int = 100, union_all_rows: bool = False) -> DataFrame:
    """Nodes (node) reached from base along (parent, node), with depth and path.

    UNION keeps a node once, at its least depth; UNION ALL keeps every path. A path never visits a
    node twice. Nodes beyond max_depth are an error."""
    level = written(base.select("node", F.lit(0).alias("depth"), F.array("node").alias("path")))
    found = [level]
    for d in range(1, max_depth + 2):
        step = level.select(F.col("node").alias("parent"), "path").join(edges.select("parent", "node"), "parent").where(~F.array_contains("path", F.col("node")))
        step = step.select("node", F.lit(d).alias("depth"), F.concat("path", F.array("node")).alias("path"))
        if not union_all_rows:
            step = step.groupBy("node").agg(F.min("depth").alias("depth"), F.min("path").alias("path"))
            step = step.join(union_all(found).select("node"), "node", "left_anti")
        level = written(step)
        if level.isEmpty():
            break
        if d > max_depth:
            raise ValueError(f"nodes lie deeper than {max_depth}")
        found.append(level)
    return union_all(found)


def dependency_levels(edges: DataFrame, nodes: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, level): 1 for nodes without dependencies, else 1 + the highest level they depend on.

    edges are (node, needs); nodes on or behind a cycle get no level and are left out. More levels than
    rounds are an error."""
    left = written(nodes.select("node").distinct())
    need = written(edges.select("node", "needs").where("node != needs").distinct().join(left, "node", "left_semi"))
    loops = written(edges.where("node = needs").select("node").distinct())
    out = []
    for level in range(1, rounds + 2):
        ready = left.join(need.select("node"), "node", "left_anti").join(loops, "node", "left_anti")
        ready = written(ready.withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        if level > rounds:
            raise ValueError(f"nodes are left after {rounds} levels")
        out.append(ready)
        left = written(left.join(ready, "node", "left_anti"))
        need = written(need.join(ready.select(F.col("node").alias("needs")), "needs", "left_anti").select("node", "needs"))
    return union_all(out) if out else nodes.select("node").limit(0).withColumn("level", F.lit(1))


def cycle_members(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, blocked) for nodes on a cycle. edges are (src, dst, deferrable); blocked is true where
    the cycle stays after all deferrable edges are dropped. An edge with a null end is none."""
    stuck = strong_components(edges.where("not deferrable"), rounds).select("node", F.lit(True).alias("blocked"))
    return strong_components(edges, rounds).join(stuck, "node", "left").select("node", F.coalesce("blocked", F.lit(False)).alias("blocked"))


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, component) of the nodes on a cycle: nodes that reach each other have the same component.

    Nodes that nothing leads to, or that lead nowhere, are trimmed, and of the nodes with one edge in and
    one out those that come first among their like neighbours are taken out, their two edges becoming
    one; so chains and rings shrink by a share each round, and all rounds write a few times the edges.
    What is left is coloured: the highest node spreads along the edges, and the nodes that a colour's own
    node is reached from within the colour are its component. Nodes taken out follow in reverse: on a
    cycle are those whose neighbours are of one component."""
    both = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    own = [written(both.where("src = dst").select(F.col("src").alias("node")).distinct())]
    now, taken = written(both.where("src != dst").distinct()), []
    for k in range(rounds):
        before = now.count()
        now, log, loops = _shrunk(now, k)
        taken.append(log)
        own.append(loops)
        if now.count() == before and log.isEmpty():
            break
    else:
        raise ValueError(f"chains are left after {rounds} rounds")
    loops = written(union_all(own).distinct().withColumn("_own", F.lit(True)))
    found = _coloured(now, rounds)
    return written(_put_back(found, taken[:-1], loops))


def _shrunk(now: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges after one round of trimming and taking out, the nodes taken out with their neighbours, nodes left with an edge to themselves)."""
    ends = now.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast(now.schema["src"].dataType).alias("p"), F.col("dst").alias("s"))
    ends = ends.unionByName(now.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("p"), F.lit(None).cast(now.schema["dst"].dataType).alias("s")))
    nodes = written(ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.min("p").alias("p"), F.min("s").alias("s")))
    chain = nodes.where("i = 1 AND o = 1").select("node", "p", "s", F.xxhash64(F.lit(k), "node").alias("h"))
    rank = chain.select(F.col("node").alias("_n"), F.struct("h", "node").alias("_r"))
    near = chain.withColumn("_mine", F.struct("h", "node"))
    for side in ("p", "s"):
        near = near.join(rank.select(F.col("_n").alias(side), F.col("_r").alias(f"_{side}")), side, "left")
    first = near.where("(_p IS NULL OR _mine < _p) AND (_s IS NULL OR _mine < _s)")
    picked = written(first.select("node", "p", "s"))
    gone = nodes.where("i = 0 OR o = 0").select("node").unionByName(picked.select("node"))
    kept = now.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    joined = picked.where("p != s").select(F.col("p").alias("src"), F.col("s").alias("dst"))
    return written(kept.unionByName(joined).distinct()), picked, picked.where("p = s").select(F.col("p").alias("node"))


def _coloured(now: DataFrame, rounds: int) -> DataFrame:
    """(node, component) of the nodes on cycles in a graph without loops of one edge."""
    found = [now.limit(0).select(F.col("src").alias("node"), F.col("src").alias("component"))]
    while not now.isEmpty():
        colour = written(now.select(F.col("src").alias("node")).union(now.select("dst")).distinct().withColumn("colour", F.col("node")))
        fresh = colour
        for _ in range(rounds):
            # only what a fresh colour reaches can rise
            reached = now.join(fresh.withColumnsRenamed({"node": "src"}), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_more"))
            next_ = written(colour.join(reached, "node", "left").select("node", F.greatest("colour", "_more").alias("colour"), (F.col("_more") > F.col("colour")).alias("_rose")))
            fresh, colour = next_.where("_rose").select("node", "colour"), next_.select("node", "colour")
            if fresh.isEmpty():
                break
        else:
            raise ValueError(f"colours still spread after {rounds} rounds")
        tinted = now.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("_a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_b")), "dst")
        within = written(tinted.where("_a = _b").select("src", "dst"))
        level = written(colour.where("node = colour"))
        members = [level]
        for _ in range(rounds):
            back = within.join(level.select(F.col("node").alias("dst"), "colour"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            level = written(back.join(union_all(members).select("node"), "node", "left_anti"))
            if level.isEmpty():
                break
            members.append(level)
        else:
            raise ValueError(f"components still grow after {rounds} rounds")
        done = written(union_all(members).select("node", F.col("colour").alias("component")))
        several = done.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        found.append(done.join(several, "component", "left_semi").select("node", "component"))
        now = written(now.join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    return union_all(found)


def _put_back(found: DataFrame, taken: list[DataFrame], loops: DataFrame) -> DataFrame:
    """Components of all nodes on cycles from those of the nodes that stayed and the ones taken out, last ones first."""
    known = found.join(loops, "node", "full_outer").select("node", F.coalesce("component", "node").alias("component"))
    if not taken:
        return known
    # a node that was taken out gets its component below, even if it has an edge to itself
    known = written(known.join(union_all(taken).select("node"), "node", "left_anti"))
    for k in range(len(taken) - 1, -1, -1):
        at = lambda side: known.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
        near = taken[k].join(at("p"), "p", "left").join(at("s"), "s", "left").join(loops, "node", "left")
        component = F.when(F.col("_p") == F.col("_s"), F.col("_p")).when(F.col("_own"), F.col("node"))
        known = known.unionByName(near.select("node", component.alias("component")).where("component IS NOT NULL"))
        if k % 4 == 0:
            known = written(known)
    return known


def deferred_load_order(tables: DataFrame, fks: DataFrame) -> DataFrame:
    """(node, level, deferred): load levels of tables by foreign keys (node, needs, deferrable).

    Keys on a cycle are deferred to the end where they may be; deferred counts them per table."""
    edges = fks.where("node != needs").select(F.col("node").alias("src"), F.col("needs").alias("dst"), "deferrable")
    ring = written(cycle_members(edges).select("node"))
    cyclic = fks.where("deferrable").join(ring, "node", "left_semi").join(ring.select(F.col("node").alias("needs")), "needs", "left_semi").select("node", "needs")
    selfish = fks.where("node = needs").select("node", "needs")
    later = cyclic.unionByName(selfish).distinct()
    levels = dependency_levels(fks.select("node", "needs").join(later, ["node", "needs"], "left_anti"), tables)
    return levels.join(later.groupBy("node").agg(F.count("*").alias("deferred")), "node", "left").select("node", "level", F.coalesce("deferred", F.lit(0)).alias("deferred"))
