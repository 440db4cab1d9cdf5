"""Traversal of call graphs: reachability, bounded simple paths, trees, degrees and roles. Edges are (caller, callee)."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.lineage import cut

#: Rounds whose new nodes are kept as tables of their own.
MERGE = 16


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): nodes reachable from `roots` (node), roots at 0; a frontier loop that joins new nodes only and writes, each round,
    the new ones alone."""
    edges = cut(edges.select("caller", "callee"))
    front = cut(roots.select("node").distinct().withColumn("depth", F.lit(0).cast("long")))
    parts = [front]
    for depth in count(1):
        seen = reduce(DataFrame.unionByName, parts)
        step = front.join(edges, front.node == edges.caller).select(F.col("callee").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if front.isEmpty():
            return seen
        parts.append(front)
        if len(parts) > MERGE:  # many small tables become one
            parts = [cut(reduce(DataFrame.unionByName, parts))]


def paths(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(path, depth, note): every step of every simple path from the roots, one row a step. A callee on the path gives a row with
    note 'CYCLE' that goes no further; a callee with callees of its own at max_depth has note 'DEPTH'. Diamonds repeat."""
    has = edges.select(F.col("caller").alias("callee")).distinct().withColumn("goes_on", F.lit(True))
    step = cut(edges.join(has, "callee", "left").select("caller", "callee", F.coalesce("goes_on", F.lit(False)).alias("goes_on")))
    front = roots.select(F.array("node").alias("path"))
    out = None
    for depth in range(1, max_depth + 1):
        if depth > 1 and front.isEmpty():
            break
        rows = front.withColumn("caller", F.element_at("path", -1)).join(step, "caller")
        cycle = F.array_contains("path", F.col("callee"))
        note = F.when(cycle, "CYCLE").when(F.lit(depth == max_depth) & F.col("goes_on"), "DEPTH").otherwise("")
        # each level is written, so that the next one's plan is one join whatever the depth
        rows = cut(rows.select(F.concat("path", F.array("callee")).alias("path"), F.lit(depth).cast("long").alias("depth"), note.alias("note")))
        out = rows if out is None else out.unionByName(rows)
        front = rows.where("note = ''").select("path")
    return out


def tree(edges: DataFrame, root: int | str, max_depth: int, up: bool = False) -> DataFrame:
    """(path, depth, node, recursive, truncated): the callees (up: callers) tree of a node. Children once each; a node on the path is
    kept, marked recursive and not expanded; a self call shows under the root only; truncated where depth ends before the tree does."""
    if up:
        edges = edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    edges = edges.distinct()
    more = edges.where("caller <> callee").select(F.col("caller").alias("callee")).distinct().withColumn("more", F.lit(True))
    step = cut(edges.join(more, "callee", "left"))
    kind = edges.schema["caller"].dataType
    front = edges.sparkSession.range(1).select(F.array(F.lit(root).cast(kind)).alias("path"))
    out = None
    for depth in range(1, max_depth + 1):
        if depth > 1 and front.isEmpty():
            break
        rows = front.withColumn("caller", F.element_at("path", -1)).join(step, "caller").where((F.col("caller") != F.col("callee")) | (F.lit(depth == 1)))
        recursive = F.array_contains("path", F.col("callee"))
        truncated = F.lit(depth == max_depth) & ~recursive & F.coalesce("more", F.lit(False))
        rows = cut(rows.select(F.concat("path", F.array("callee")).alias("path"), F.lit(depth).cast("long").alias("depth"), F.col("callee").alias("node"), recursive.alias("recursive"), truncated.alias("truncated")))
        out = rows if out is None else out.unionByName(rows)
        front = rows.where("NOT recursive").select("path")
    return out


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) for `nodes` (node)."""
    ins = edges.groupBy(F.col("callee").alias("node")).agg(F.count("*").alias("in_degree"))
    outs = edges.groupBy(F.col("caller").alias("node")).agg(F.count("*").alias("out_degree"))
    return nodes.join(ins, "node", "left").join(outs, "node", "left").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def roles(degree: DataFrame, framework: DataFrame) -> DataFrame:
    """(node, role): FRAMEWORK_ENTRY before ISOLATED, ENTRY_CANDIDATE, LEAF, NORMAL. framework: (node) that something outside calls."""
    known = degree.join(framework.select("node").distinct().withColumn("outside", F.lit(True)), "node", "left")
    role = F.when(F.col("outside"), "FRAMEWORK_ENTRY").when((F.col("in_degree") == 0) & (F.col("out_degree") == 0), "ISOLATED")
    return known.select("node", role.when(F.col("in_degree") == 0, "ENTRY_CANDIDATE").when(F.col("out_degree") == 0, "LEAF").otherwise("NORMAL").alias("role"))


def splice(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """Edges between nodes that are not `excluded` (node), with those reached through excluded nodes only spliced in; the loop
    ends when no new excluded node is reached, so cycles of them end too."""
    ex = excluded.select("node").distinct()
    into = edges.join(ex, edges.callee == ex.node, "left_semi")
    out = edges.join(ex, edges.callee == ex.node, "left_anti").join(ex, F.col("caller") == ex.node, "left_anti")
    front = into.join(ex, into.caller == ex.node, "left_anti").select("caller", F.col("callee").alias("via"))
    inner = edges.join(ex, edges.caller == ex.node, "left_semi").select(F.col("caller").alias("via"), "callee")
    seen = front
    while True:
        step = cut(front.join(inner, "via").select("caller", "callee").distinct())
        out = cut(out.unionByName(step.join(ex, step.callee == ex.node, "left_anti")))
        front = cut(step.join(ex, step.callee == ex.node, "left_semi").select("caller", F.col("callee").alias("via")).join(seen, ["caller", "via"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return out.distinct()
