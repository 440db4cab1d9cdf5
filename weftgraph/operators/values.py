"""What is known of values: which type an expression makes, what arguments bind, what a field always holds.

Nodes: (node, kind, value, recv): T new of a type, L literal, K class, V constant, A parameter by index, P captured parameter by index, F own
field, O field of another object, M result of a method, C type by reflective name, Z function (its body), U unknown. Args: (node, pos, arg).
Environments are rows (ctx, index, tag, value): what parameter `index` is in a context; tags TYPE, LITERAL, CLASS, CONST, FUNCTIONAL, BOUND
(an upper type). A missing row is unknown, and unknown never equals anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.lineage import cut
from weftgraph.operators.selection import has

#: Levels that the evaluation of a value follows results of calls.
DEPTH = 5
#: Tag by kind of values that are known by themselves.
VALUE_TAGS = {"L": "LITERAL", "K": "CLASS", "V": "CONST", "Z": "FUNCTIONAL"}


def _tag():
    return F.create_map(*[F.lit(x) for kv in VALUE_TAGS.items() for x in kv])


def uses(nodes: DataFrame, args: DataFrame, calls: DataFrame, kind: str = "A", guarded: DataFrame | None = None) -> DataFrame:
    """(caller): methods with a call (caller, recv, args_node) whose receiver or arguments rest on a node of `kind`, directly or below, or
    whose guard does (guarded: caller). Marks go up from such nodes; the loop ends when none is new."""
    up = args.select(F.col("arg").alias("low"), F.col("node").alias("high")).unionByName(nodes.where("recv IS NOT NULL").select(F.col("recv").alias("low"), F.col("node").alias("high"))).distinct()
    seen = cut(nodes.where(F.col("kind") == kind).select("node"))
    front = seen
    while True:
        front = cut(front.join(up, front.node == up.low).select(F.col("high").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    touched = calls.select("caller", F.explode(F.array("recv", "args_node")).alias("node")).join(seen, "node", "left_semi").select("caller")
    return (touched if guarded is None else touched.unionByName(guarded.select("caller"))).distinct()


def uses_parameters(nodes: DataFrame, args: DataFrame, calls: DataFrame, makes: DataFrame, guarded: DataFrame | None = None) -> DataFrame:
    """(caller): methods that need to know what they were given: those whose calls rest on parameters, and those that make a lambda
    (makes: caller, body) whose calls rest on what it captured."""
    captured = uses(nodes, args, calls, "P").select(F.col("caller").alias("body"))
    return uses(nodes, args, calls, "A", guarded).unionByName(makes.join(captured, "body", "left_semi").select("caller")).distinct()


def reflection_kinds(methods: DataFrame) -> DataFrame:
    """(method, kind): keys of the reflection API: INVOKE, FOR_NAME, NEW_INSTANCE, CTOR_NEW_INSTANCE."""
    key = F.col("method")
    kind = F.when(key == "java.lang.reflect.Method#invoke(java.lang.Object,java.lang.Object[])", "INVOKE").when(key.startswith("java.lang.Class#forName("), "FOR_NAME")
    kind = kind.when(key == "java.lang.Class#newInstance()", "NEW_INSTANCE").when(key == "java.lang.reflect.Constructor#newInstance(java.lang.Object[])", "CTOR_NEW_INSTANCE")
    return methods.select("method", kind.alias("kind")).where("kind IS NOT NULL")


def returns_of(returns: DataFrame, nodes: DataFrame) -> DataFrame:
    """(method, kind, value): the distinct values that a method's returns (method, node) give; a missing node is unknown."""
    j = returns.join(nodes.select("node", "kind", "value"), "node", "left")
    return j.select("method", F.coalesce("kind", F.lit("U")).alias("kind"), "value").distinct()


def concrete_types(nodes: DataFrame, args: DataFrame, factories: DataFrame, fields: DataFrame, known: DataFrame, env: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """(node, type, how): the type that a value surely has; with `env` (ctx, node, type, how), what rests on parameters alone. how: T, M, F,
    O or A, what it rests on first.

    New makes its type. A result has the type that the method's folded return (factories: method, kind, value) has: a new one, or a
    parameter's or reflective name's by the argument; methods that others override are left out by the caller. A field has the type
    that it always holds (fields: field, kind, value); of another object only a new one. A parameter has what `env` binds to it, per ctx;
    without `env` there is no ctx column, and parameters are unknown. known: (type) that a reflective name may give.
    """
    keys = [] if env is None else ["ctx"]
    base = nodes.select("node", "kind", "value")
    # without contexts values are decided once; in a context only what rests on parameters is decided, and only that has rows
    new = base.where("kind = 'T'").select("node", F.col("value").alias("type"), F.lit("T").alias("how"))
    held = base.join(fields.select(F.col("field").alias("value"), F.col("kind").alias("head"), F.col("value").alias("type")), "value").where("(kind = 'F' OR kind = 'O') AND head = 'T'")
    fixed = new.unionByName(held.select("node", "type", F.col("kind").alias("how")))
    results = base.where("kind = 'M'").join(factories.select(F.col("method").alias("value"), F.col("kind").alias("made"), F.col("value").alias("by")), "value")
    fixed = fixed.unionByName(results.where("made = 'T'").select("node", F.col("by").alias("type"), F.lit("M").alias("how")))
    at = args.select("node", F.col("pos").cast("string").alias("by"), "arg")
    names = results.where("made = 'C'").join(at, ["node", "by"]).join(nodes.where("kind = 'L'").select(F.col("node").alias("arg"), F.col("value").alias("type")), "arg").join(known.select("type"), "type", "left_semi")
    fixed = fixed.unionByName(names.select("node", "type", F.lit("M").alias("how")))
    if env is None:
        out = fixed
        through = results.where("made = 'A'").join(at, ["node", "by"]).select("node", "arg")
    else:
        bound = env.where("tag = 'TYPE'").select("ctx", F.col("index").cast("string").alias("value"), F.col("value").alias("type"))
        out = base.where("kind = 'A'").join(bound, "value").select("ctx", "node", "type", F.lit("A").alias("how"))
        own = base.where("kind = 'F'").join(fields.where("kind = 'A'").select(F.col("field").alias("value"), F.col("value").alias("by")), "value")
        out = out.unionByName(own.join(bound.withColumnRenamed("value", "by"), "by").select("ctx", "node", "type", F.lit("F").alias("how")))
        through = results.where("made = 'A'").join(at, ["node", "by"]).select("node", "arg")
    front = out
    for _ in range(depth):
        front = cut(through.join(front.select(*keys, F.col("node").alias("arg"), "type"), "arg").select(*keys, "node", "type", F.lit("M").alias("how")).distinct())
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.groupBy(*keys, "node").agg(F.min(F.struct("type", "how")).alias("t")).select(*keys, "node", "t.type", "t.how")


def bind_arguments(calls: DataFrame, args: DataFrame, nodes: DataFrame, types: DataFrame, env: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """(ctx, edge_id, index, tag, value): the environment that a callee gets from a call (ctx, edge_id, args_node) in a context: of each
    argument its type (types: node, type, and ctx where they depend on it), else its value, else what the caller's parameter is, else its
    upper type (bounds: node, type). Arguments of which nothing is known bind nothing."""
    given = calls.select("ctx", "edge_id", F.col("args_node").alias("node")).join(args, "node").select("ctx", "edge_id", F.col("pos").alias("index"), "arg")
    on = ["ctx", "arg"] if "ctx" in types.columns else ["arg"]
    t = types.select(*[c for c in ("ctx",) if c in types.columns], F.col("node").alias("arg"), F.col("type").alias("t"))
    n = nodes.select(F.col("node").alias("arg"), "kind", F.col("value").alias("v"))
    given = given.join(t, on, "left").join(n, "arg", "left")
    passed = env.select("ctx", F.lit("A").alias("kind"), F.col("index").cast("string").alias("v"), F.col("tag").alias("e_tag"), F.col("value").alias("e_value"))
    given = given.join(passed, ["ctx", "kind", "v"], "left")
    if bounds is not None:
        given = given.join(bounds.select(F.col("node").alias("arg"), F.col("type").alias("b")), "arg", "left")
    else:
        given = given.withColumn("b", F.lit(None).cast("string"))
    own = _tag()[F.col("kind")]
    tag = F.when(F.col("t").isNotNull(), "TYPE").when(own.isNotNull(), own).when(F.col("e_tag").isNotNull(), F.col("e_tag")).when(F.col("b").isNotNull(), "BOUND")
    value = F.when(F.col("t").isNotNull(), F.col("t")).when(own.isNotNull(), F.col("v")).when(F.col("e_tag").isNotNull(), F.col("e_value")).otherwise(F.col("b"))
    return given.select("ctx", "edge_id", "index", tag.alias("tag"), value.alias("value")).where("tag IS NOT NULL")


def bind_constructor(creations: DataFrame, args: DataFrame, types: DataFrame, fields: DataFrame) -> DataFrame:
    """(node, field, type): what own fields hold in an object that a creation (node, ctor) made: fields (field, ctor, pos) that a constructor
    sets from its argument, by that argument's type (types: node, type)."""
    given = creations.join(args, "node").join(types.select(F.col("node").alias("arg"), "type"), "arg")
    return given.join(fields, (fields.ctor == given.ctor) & (fields.pos == given.pos)).select("node", "field", "type")


def narrower(bounds: DataFrame, up: DataFrame) -> DataFrame:
    """(node, type): of several upper types (node, type) of a value those that no other one is below; where that leaves two unrelated ones
    the first by name."""
    high = bounds.select("node", F.col("type").alias("sub")).join(up.select("sub", "sup"), "sub").select("node", F.col("sup").alias("type")).distinct()
    return bounds.join(high, ["node", "type"], "left_anti").groupBy("node").agg(F.min("type").alias("type"))


def evaluate(nodes: DataFrame, args: DataFrame, folded: DataFrame, env: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """(node, tag, value) of literals, classes and constants, and of results whose method always returns one (folded: method, kind, value) or
    its argument; with `env` (ctx, node, tag, value), of parameters that it binds to such and what rests on them alone. Results are
    followed `depth` levels."""
    keys = [] if env is None else ["ctx"]
    base = nodes.select("node", "kind", "value")
    out = base.where(F.col("kind").isin(*VALUE_TAGS)).select("node", _tag()[F.col("kind")].alias("tag"), "value")
    made = base.where("kind = 'M'").join(folded.select(F.col("method").alias("value"), F.col("kind").alias("made"), F.col("value").alias("by")), "value")
    out = out.unionByName(made.where(F.col("made").isin(*VALUE_TAGS)).select("node", _tag()[F.col("made")].alias("tag"), F.col("by").alias("value")))
    if env is not None:
        bound = env.where(F.col("tag").isin(*VALUE_TAGS.values())).select("ctx", F.col("index").cast("string").alias("value"), "tag", F.col("value").alias("v"))
        out = base.where("kind = 'A'").join(bound, "value").select("ctx", "node", "tag", F.col("v").alias("value"))
    through = made.where("made = 'A'").join(args.select("node", F.col("pos").cast("string").alias("by"), "arg"), ["node", "by"]).select("node", "arg")
    front = out
    for _ in range(depth):
        front = cut(through.join(front.select(*keys, F.col("node").alias("arg"), "tag", "value"), "arg").select(*keys, "node", "tag", "value").distinct())
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.distinct()


def field_values(fields: DataFrame, assigns: DataFrame, constructors: DataFrame, delegating: DataFrame) -> DataFrame:
    """(field, kind, value): what a field holds in every object, whatever constructor made it.

    fields: (field, type, mods, framework boolean: something else may set it); assigns: (field, site, kind, value), site <field> or a
    constructor, any other means a later write; constructors: (type, sig) that don't call another of the type; delegating: (type) with
    some that do. The field is private or final, not static, not of a framework; it has an initializer or all those constructors set it,
    nothing else does, all its values are known and the same; a parameter's only if no constructor delegates.
    """
    own = fields.where(~F.col("framework") & ~has("mods", "static") & has("mods", "private", "final")).select("field", "type")
    roots = constructors.select("type", F.col("sig").alias("site"), F.lit(True).alias("root")).distinct()
    n_roots = constructors.groupBy("type").agg(F.countDistinct("sig").alias("n_roots"))
    a = assigns.join(own, "field").join(roots, ["type", "site"], "left")
    first = F.col("site") == "<field>"
    value = F.concat_ws("\u0001", "kind", "value")
    by = a.groupBy("field", "type").agg(
        F.max(first).alias("initial"), F.min(first | F.coalesce("root", F.lit(False))).alias("early"), F.countDistinct(F.when(~first, F.col("site"))).alias("set_in"),
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.min("kind").alias("kind"), F.min("value").alias("value"), F.max((F.col("kind") == "U") | F.col("kind").isNull()).alias("unknown"),
    )
    by = by.join(n_roots, "type", "left").where("early AND (initial OR set_in >= coalesce(n_roots, 0)) AND NOT unknown AND lo = hi")
    chained = delegating.select("type", F.lit(True).alias("chained")).distinct()
    return by.join(chained, "type", "left").where("kind <> 'A' OR chained IS NULL").select("field", "kind", "value")


def own_valued(fields: DataFrame, assigns: DataFrame, foreign: DataFrame) -> DataFrame:
    """(field): fields (field, mods), not static, that some write gives another value than a parameter's: their own (assigns: field, kind) or
    one from another class (foreign: field, kind)."""
    writes = assigns.select("field", "kind").unionByName(foreign.select("field", "kind")).where("kind <> 'A'")
    return fields.where(~has("mods", "static")).join(writes, "field", "left_semi").select("field").distinct()


def merged_origins(assigns: DataFrame, nodes: DataFrame, rounds: int = 8) -> DataFrame:
    """(var, kind, value): what a local variable may only be, by its assignments (var, node): the value of all, through other variables (kind
    X, value the variable) for `rounds` rounds; U where they differ or where the rounds run out."""
    rows = assigns.join(nodes.select("node", "kind", "value"), "node", "left").select("var", F.coalesce("kind", F.lit("U")).alias("kind"), "value")
    n = rows.groupBy("var").agg(F.count("*").alias("n"))
    known = None
    for _ in range(rounds):
        now = rows.where("kind <> 'X'")
        if known is not None:
            now = now.unionByName(rows.where("kind = 'X'").join(known.select(F.col("var").alias("value"), F.col("kind").alias("k"), F.col("value").alias("v")), "value").select("var", F.col("k").alias("kind"), F.col("v").alias("value")))
        same = F.concat_ws("\u0001", "kind", F.coalesce("value", F.lit("")))
        by = now.groupBy("var").agg(F.count("*").alias("c"), F.min(same).alias("lo"), F.max(same).alias("hi"), F.min("kind").alias("kind"), F.min("value").alias("value")).join(n, "var")
        step = cut(by.where("c = n").select("var", F.when(F.col("lo") == F.col("hi"), F.col("kind")).otherwise("U").alias("kind"), F.when(F.col("lo") == F.col("hi"), F.col("value")).alias("value")))
        if known is not None and step.count() == known.count():
            break
        known = step
    return n.select("var").join(known, "var", "left").select("var", F.coalesce("kind", F.lit("U")).alias("kind"), "value")


def shared_nodes(nodes: DataFrame, args: DataFrame) -> DataFrame:
    """(file, node, shared): the number under which equal nodes of a file (file, node, kind, value, recv) are kept: the smallest of those
    with the same content and arguments. args: (file, node, pos, arg)."""
    given = args.groupBy("file", "node").agg(F.array_sort(F.collect_list(F.struct("pos", "arg"))).alias("given"))
    j = nodes.join(given, ["file", "node"], "left").withColumn("print", F.xxhash64("kind", "value", "recv", "given")).select("file", "node", "kind", "value", "recv", "given", "print")
    least = j.groupBy("file", "kind", "value", "recv", "given").agg(F.min("node").alias("shared"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("file", "kind", "value", "recv", "given")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return j.alias("a").join(least.alias("b"), cond).select("a.file", "a.node", "shared")


def reachable_nodes(nodes: DataFrame, args: DataFrame, roots: DataFrame) -> DataFrame:
    """The `nodes` that calls, returns or fields refer to (roots: node), with all below them: arguments and receivers."""
    down = args.select("node", "arg").unionByName(nodes.where("recv IS NOT NULL").select("node", F.col("recv").alias("arg"))).distinct()
    seen = cut(roots.select("node").where("node IS NOT NULL").distinct())
    front = seen
    while True:
        front = cut(front.join(down, "node").select(F.col("arg").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return nodes.join(seen, "node", "left_semi")
        seen = cut(seen.unionByName(front))
