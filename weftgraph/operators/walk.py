"""The walk over resolved calls: fan-out, pruned and hidden calls, silence of constructors, callbacks, notes, limits, orders.

The frontier is a table of paths; each level is one join with the steps of the next callees, written out before the next level begins,
so a plan never holds more than one level. Steps: (caller, edge_id, ord, callee, and what notes need). The number of simple paths can be
exponential in the depth, as it is for whoever enumerates them: `max_rows` bounds what is written, in the order of paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.names import is_test_path
from weftgraph.operators.graph import splice
from weftgraph.operators.lineage import cut

# What notes say of a receiver and of the end of a path.
RECEIVERS = {
    "M": "return value (factory method etc.)",
    "P": "parameter (passed in from outside the method)",
    "F": "field",
    "L": "local variable",
    "T": "own class (this)",
    "S": "type name (unbound method reference)",
    "O": "receiver unknown",
}
CYCLE = "[UNEXPANDED:CYCLE] returns to a method already on this path"
NO_IMPL = "[UNEXPANDED:NO_IMPL] no implementation with a body in the source"
LAMBDA = "[UNEXPANDED:LAMBDA] implemented by a lambda/method reference"
GENERATED = "[UNEXPANDED:GENERATED] implementation is generated at compile time ("


def steps(edges: DataFrame, targets: DataFrame, pruned: DataFrame | None = None, callbacks: DataFrame | None = None, expand: int = 3, listed: int = 20) -> DataFrame:
    """(caller, edge_id, ord, callee, label, n, rank, goes_on, unreachable): what may follow a method on a path.

    edges: (edge_id, caller, ord); targets: (edge_id, label, callee). Up to `expand` targets are followed; of more the first `listed` by
    name are rows that go no further. Calls that guards rule out (pruned: edge_id, reason) are rows that go no further either. callbacks:
    (edge_id, caller, callee) follow after the call, unless it is ruled out.
    """
    w = Window.partitionBy("edge_id").orderBy("callee")
    t = targets.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("edge_id"))).where(F.col("rank") <= listed)
    s = edges.select("edge_id", "caller", "ord").join(t.select("edge_id", "label", "callee", "n", "rank"), "edge_id")
    s = s.withColumn("unreachable", F.lit(None).cast("string")) if pruned is None else s.join(pruned.select("edge_id", F.col("reason").alias("unreachable")), "edge_id", "left")
    s = s.withColumn("goes_on", (F.col("n") <= expand) & F.col("unreachable").isNull())
    if callbacks is not None:
        back = callbacks if pruned is None else callbacks.join(pruned.select("edge_id"), "edge_id", "left_anti")
        own = back.join(edges.select("edge_id", "ord"), "edge_id").select("edge_id", "caller", "ord", F.lit("CALLBACK").alias("label"), "callee", F.lit(1).cast("long").alias("n"), F.lit(listed + 1).alias("rank"), F.lit(None).cast("string").alias("unreachable"), F.lit(True).alias("goes_on"))
        s = s.unionByName(own)
    return s


def walk(step: DataFrame, roots: DataFrame, methods: DataFrame, max_depth: int = 50, max_rows: int | None = None) -> DataFrame:
    """(path, order, depth, caller, callee, edge_id, label, n, cycle, at_depth, unreachable): one row for each step of each path.

    methods: (method, hidden boolean, silent boolean). A hidden method is not on paths, but what it calls is, as if its caller did; a
    silent one (a constructor) is on paths without a row of its own. A callee that is on the path, or hidden on the way, ends it (cycle).
    order: the places (ord, rank) of the steps so far, so that rows sorted by it come as a depth-first walk meets them. `max_rows`: the
    first so many in that order.
    """
    flags = methods.select(F.col("method").alias("callee"), "hidden", "silent")
    has_more = step.select(F.col("caller").alias("callee")).distinct().withColumn("more", F.lit(True))
    s = cut(step.join(flags, "callee", "left").join(has_more, "callee", "left").withColumn("hidden", F.coalesce("hidden", F.lit(False))).withColumn("silent", F.coalesce("silent", F.lit(False))).withColumn("more", F.coalesce("more", F.lit(False))))
    kind = step.schema["callee"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    place = "array<struct<ord:bigint,rank:bigint>>"
    front = roots.select(F.array("node").alias("path"), none.alias("unseen"), F.col("node").alias("at"), F.array().cast(place).alias("order"), F.lit(0).alias("depth"))
    out = None
    while True:
        here = F.array(F.struct(F.col("ord").cast("long").alias("ord"), F.col("rank").cast("long").alias("rank")))
        rows = front.join(s, front["at"] == s["caller"]).withColumn("cycle", F.array_contains("path", F.col("callee")) | F.array_contains("unseen", F.col("callee")))
        rows = rows.withColumn("order", F.concat("order", here.cast(place))).where("NOT (hidden AND (cycle OR NOT goes_on))")
        rows = cut(rows)
        if rows.isEmpty():
            break
        depth = F.col("depth") + 1
        shown = rows.where("NOT hidden AND NOT silent")
        shown = shown.select(
            F.concat("path", F.array("callee")).alias("path"), "order", depth.alias("depth"), F.element_at("path", -1).alias("caller"), "callee", "edge_id", "label", "n", "cycle",
            ((depth >= max_depth) & F.col("goes_on") & ~F.col("cycle") & F.col("more")).alias("at_depth"), "unreachable",
        )
        out = shown if out is None else out.unionByName(shown)
        on = rows.where("goes_on AND NOT cycle")
        seen = on.where("NOT hidden").where(depth < max_depth).select(F.concat("path", F.array("callee")).alias("path"), "unseen", F.col("callee").alias("at"), "order", depth.alias("depth"))
        unseen = on.where("hidden").select("path", F.concat("unseen", F.array("callee")).alias("unseen"), F.col("callee").alias("at"), "order", "depth")
        front = seen.unionByName(unseen)
    if out is None:
        out = rows.select("path", "order", "depth", "caller", "callee", "edge_id", "label", "n", "cycle", F.lit(False).alias("at_depth"), "unreachable")
    return out if max_rows is None else out.orderBy(F.element_at("path", 1), "order").limit(max_rows)


def collapse_lambdas(edges: DataFrame, lambdas: DataFrame) -> DataFrame:
    """Edges (caller, callee) without lambda bodies (node): what a body calls, its runner calls, once; bodies of bodies too."""
    return splice(edges, lambdas)


def note(cycle: Column, unreachable: Column, label: Column, n: Column, has_source: Column, at_depth: Column, receiver: Column, functional: Column, excluded: Column, max_depth: int = 50, expand: int = 3, listed: int = 20) -> Column:
    """The note of a step, '' without one. First why the path ends here: ruled out, a cycle, a guessed type, no source, the depth. Then what
    the label doesn't say: how many candidates and why, that a lambda may run, that nothing implements it, that a rule ties it."""
    first = F.when(unreachable.isNotNull(), unreachable).when(cycle, CYCLE).when(label == "EXTERNAL_GUESS", "[EXTERNAL] type guessed from an import (unverified)")
    first = first.when(~has_source, "[EXTERNAL] no source to follow").when(at_depth, f"[UNEXPANDED:DEPTH] depth limit ({max_depth}) reached")
    mark = F.when(n <= expand, "[CANDIDATE:").otherwise("[UNEXPANDED:")
    count = n.cast("string")
    why = F.create_map(*[F.lit(x) for kv in RECEIVERS.items() for x in kv])[receiver]
    written = F.least(n, F.lit(listed))
    cut_off = F.when(n > listed, F.concat(F.lit(" (only the first "), written.cast("string"), F.lit(" are written as rows)"))).otherwise("")
    left_out = F.when(excluded > 0, F.concat(F.lit(" ("), excluded.cast("string"), F.lit(" excluded by exclude.packages and not written as rows)"))).otherwise("")
    several = F.concat(mark, F.lit("CHA] "), count, F.lit(" candidates: "), F.coalesce(why, F.lit(RECEIVERS["O"])), cut_off, left_out)
    reflected = F.concat(mark, F.lit("REFLECTION] "), count, F.lit(" candidates: matched by name because argument types are unknown"))
    second = F.when((n > 1) & (label == "REFLECTION"), reflected).when(n > 1, several).when(label == "DATAFLOW_LAMBDA", None)
    made = F.concat(F.lit(GENERATED), F.substring(label, len("GENERATED_IMPL:") + 1, 1 << 20), F.lit(")"))
    second = second.when(functional, LAMBDA + " (which one runs is undetermined)").when(label.startswith("GENERATED_IMPL"), made)
    second = second.when(label == "NO_IMPL", NO_IMPL).when(label == "CALLBACK", "[RESOLVED:CALLBACK]")
    return F.concat_ws(" / ", first, second)


def select_entries(methods: DataFrame, edges: DataFrame, framework: DataFrame, pattern_match: Column | None = None) -> DataFrame:
    """(method, by): where walks begin. With a pattern the methods of sources that it matches, but lambda bodies (by PATTERN); without one
    those with a body that nothing calls, and those that frameworks call (framework: method). methods: (method, has_body, is_lambda,
    in_source); edges: (callee) resolved."""
    own = methods.where("in_source AND NOT is_lambda")
    if pattern_match is not None:
        return own.where(pattern_match).select("method", F.lit("PATTERN").alias("by"))
    called = edges.select(F.col("callee").alias("method")).distinct()
    free = own.where("has_body").join(called, "method", "left_anti").select("method", F.lit("NOT_CALLED").alias("by"))
    outside = own.join(framework.select("method").distinct(), "method", "left_semi").select("method", F.lit("FRAMEWORK").alias("by"))
    return outside.unionByName(free.join(outside, "method", "left_anti"))


def source_order(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """`rows` (folder, file, line, ord, key) in the order of sources: folder by its place (folder, place), file, line, place in the file, key."""
    return rows.join(folders, "folder", "left").orderBy(F.col("place").asc_nulls_last(), "file", "line", "ord", "key").drop("place")


def sibling_order(tree: DataFrame) -> DataFrame:
    """Rows of a tree (path of keys, ...) as shown: children after their parent, siblings by key."""
    return tree.orderBy("path")


def unresolved_order(rows: DataFrame, files: DataFrame) -> DataFrame:
    """`rows` (file, line, ord) by the rank of their file (file, rank), then line and place."""
    return rows.join(files.select("file", "rank"), "file", "left").orderBy(F.col("rank").asc_nulls_last(), "file", "line", "ord").drop("rank")


def in_argument_order(args: DataFrame) -> DataFrame:
    """(node, args): the arguments (node, pos, seq, arg) of each node by position, as written where positions are equal."""
    return args.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seq", "arg"))), lambda x: x["arg"]).alias("args"))


def tree_filters(tree: DataFrame, text: str | None = None, tests: bool = True, guessed: bool = True, exclude: Column | None = None, depth: int | None = None, dedupe: bool = True, most: int = 20_000) -> DataFrame:
    """Rows of a tree (path, depth, key, file, guessed) that the filters leave, `most` of them in order: by text in the key, without tests'
    sources, guessed calls or excluded keys. A row goes with those above it: a path that lost a step is no path."""
    out = F.lit(False)
    if not tests:
        out = out | is_test_path(F.coalesce("file", F.lit("")))
    if not guessed:
        out = out | F.col("guessed")
    if exclude is not None:
        out = out | exclude
    rows = tree.withColumn("_out", out)
    if depth is not None:
        rows = rows.where(F.col("depth") <= depth)
    gone = rows.where("_out").select(F.col("path").alias("_gone"))
    heads = rows.where("NOT _out").withColumn("_head", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))))
    lost = heads.join(gone.distinct(), heads["_head"] == gone["_gone"], "left_semi").select("path").distinct()
    kept = rows.where("NOT _out").drop("_out").join(lost, "path", "left_anti")
    if text is not None:
        match = kept.where(F.instr(F.lower("key"), text.lower()) > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))).alias("path")).distinct()
        kept = kept.join(match, "path", "left_semi")
    if dedupe:
        kept = kept.dropDuplicates(["path"])
    return kept.orderBy("path").limit(most)


def edge_sites(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(edge_id, caller, file, line): where calls are written, for some of them (edge_id)."""
    return edges.join(ids.select("edge_id").distinct(), "edge_id", "left_semi").select("edge_id", "caller", "file", "line")


def unresolved_cause(label: Column, n: Column, functional: Column, receiver: Column, expand: int = 3) -> Column:
    """Why a call stays open, in the words of notes; null for one that doesn't."""
    why = F.coalesce(F.create_map(*[F.lit(x) for kv in RECEIVERS.items() for x in kv])[receiver], F.lit(RECEIVERS["O"]))
    several = F.concat(F.when(n <= expand, "[CANDIDATE:CHA] ").otherwise("[UNEXPANDED:CHA] "), why)
    made = F.concat(F.lit(GENERATED), F.substring(label, len("GENERATED_IMPL:") + 1, 1 << 20), F.lit(")"))
    return F.when(n > 1, several).when(functional, LAMBDA).when(label == "NO_IMPL", NO_IMPL).when(label.startswith("GENERATED_IMPL"), made)
