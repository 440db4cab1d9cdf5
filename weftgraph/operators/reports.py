"""Inventories and the rows of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import names
from weftgraph.operators import graph

#: Causes of absence by precedence, the largest wins.
CAUSES = {"PRUNED": 1, "CYCLE": 2, "CHA": 3, "EXCLUDED": 4}


def path_lines(paths: DataFrame) -> DataFrame:
    """(line): caller, callee, resolved-by, depth, the path's labels, and the note if there is one; as many fields as the path needs.
    paths: (caller, callee, resolved_by, depth, path array<string>, note)."""
    head = [names.csv_field(F.col(c)) for c in ("caller", "callee", "resolved_by")] + [F.col("depth").cast("string")]
    steps = F.transform("path", names.csv_field)
    note = F.when(F.coalesce(F.col("note"), F.lit("")) != "", F.array(names.csv_field(F.col("note")))).otherwise(F.array().cast("array<string>"))
    return paths.select(F.array_join(F.concat(F.array(*head), steps, note), ",").alias("line"))


def unresolved_causes(unresolved: DataFrame) -> DataFrame:
    """(caller, n, causes): how many calls (caller, line, ord, cause) stay open, and their causes in order of first occurrence."""
    first = unresolved.groupBy("caller", "cause").agg(F.count("*").alias("n"), F.min(F.struct("line", "ord")).alias("at"))
    causes = F.transform(F.array_sort(F.collect_list(F.struct("at", "cause"))), lambda x: x["cause"])
    return first.groupBy("caller").agg(F.sum("n").alias("n"), F.array_join(causes, ";").alias("causes"))


def absent_cause(nodes: DataFrame, present: DataFrame, causes: DataFrame) -> DataFrame:
    """(node, cause): why a node is not in the hierarchy: the cause (node, cause) of highest precedence, NOT_REACHED without one."""
    code = F.create_map(*[F.lit(x) for kv in CAUSES.items() for x in kv])
    most = causes.groupBy("node").agg(F.max_by("cause", code[F.col("cause")]).alias("cause"))
    return nodes.join(present.select("node").distinct(), "node", "left_anti").join(most, "node", "left").select("node", F.coalesce("cause", F.lit("NOT_REACHED")).alias("cause"))


def pruned_subtree(kept: DataFrame, pruned: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): nodes below the targets of pruned calls that nothing emitted reaches: forward from those targets, less what the roots
    reach over kept calls. Only calls whose caller is reached count as pruned."""
    every = kept.unionByName(pruned)
    emitted = graph.reachable(kept, roots).select("node")
    targets = pruned.join(emitted, pruned.caller == emitted.node, "left_semi").select(F.col("callee").alias("node"))
    return graph.reachable(every, targets).select("node").join(emitted, "node", "left_anti")


def methods_inventory(methods: DataFrame, edges: DataFrame, framework: DataFrame, reached: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, role, reachable) of every method (node), each once."""
    degree = graph.degrees(edges, methods.select("node").distinct())
    hit = reached.select("node").distinct().withColumn("hit", F.lit(True))
    return degree.join(graph.roles(degree, framework), "node").join(hit, "node", "left").select("node", "in_degree", "out_degree", "role", F.coalesce("hit", F.lit(False)).alias("reachable"))


def field_tree(accesses: DataFrame, edges: DataFrame) -> DataFrame:
    """(field, accessor, access, caller): who touches a field, and who calls those; caller is null where none does. access is read,
    write or, for both, readwrite. accesses: (field, accessor, access)."""
    reads, writes = F.col("access").isin("read", "readwrite"), F.col("access").isin("write", "readwrite")
    both = accesses.groupBy("field", "accessor").agg(F.max(reads).alias("r"), F.max(writes).alias("w"))
    kind = F.when(F.col("r") & F.col("w"), "readwrite").when(F.col("w"), "write").otherwise("read")
    callers = edges.select(F.col("callee").alias("accessor"), "caller").distinct()
    return both.select("field", "accessor", kind.alias("access")).join(callers, "accessor", "left").select("field", "accessor", "access", "caller")


def unexpanded_summary(sites: DataFrame, most: int = 3) -> DataFrame:
    """(callee, max_candidates, n_sites): the callees of calls with over `most` candidates, the most there were, and at how many calls.
    sites: (edge_id, callee, n_candidates), a call as often as paths meet it; unknown counts are not over the limit."""
    return sites.where(F.col("n_candidates") > most).groupBy("callee").agg(F.max("n_candidates").alias("max_candidates"), F.countDistinct("edge_id").alias("n_sites"))


def methods_by_name(decls: DataFrame) -> DataFrame:
    """(type, name, method_ids array): the methods with a body of each type and name, by file, then line, then id.
    decls: (method_id, type, name, file, line, has_body)."""
    of = decls.where("has_body").groupBy("type", "name").agg(F.array_sort(F.collect_list(F.struct("file", "line", "method_id"))).alias("m"))
    return of.select("type", "name", F.transform("m", lambda x: x["method_id"]).alias("method_ids"))


def inventory_stats(inventory: DataFrame) -> DataFrame:
    """One row: how many methods there are, are reached and have each role; zeros if there are none. inventory: of methods_inventory."""
    roles = ("FRAMEWORK_ENTRY", "ENTRY_CANDIDATE", "ISOLATED", "LEAF", "NORMAL")
    return inventory.agg(F.count("*").alias("n_methods"), F.count_if("reachable").alias("n_reachable"), *[F.count_if(F.col("role") == r).alias(f"n_{r.lower()}") for r in roles])


def ambiguous_labels(methods: DataFrame) -> DataFrame:
    """(label, n): short labels (method, label) that several methods share, and how many: those are shown in full."""
    return methods.groupBy("label").agg(F.countDistinct("method").alias("n")).where("n > 1")
