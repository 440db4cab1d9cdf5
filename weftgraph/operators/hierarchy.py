"""Type hierarchies and the choice of bodies: closure, chains, most specific types, candidates and the resolution cascade."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.lineage import cut


def closure(type_edges: DataFrame) -> DataFrame:
    """(sub, sup, depth) of all strict supertypes, least depth; a loop that ends when no new pair comes, so cycles end too."""
    seen = type_edges.distinct().withColumn("depth", F.lit(1).cast("long"))
    front = seen
    for depth in count(2):
        e = type_edges.select(F.col("sub").alias("sup"), F.col("sup").alias("next"))
        new = cut(front.join(e, "sup").select("sub", F.col("next").alias("sup")).distinct().join(seen, ["sub", "sup"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if new.isEmpty():
            break
        seen, front = cut(seen.unionByName(new)), new
    return seen


def most_specific(members: DataFrame, up: DataFrame) -> DataFrame:
    """(grp, type) without types that are strict supertypes of another member of the group."""
    below = members.select("grp", F.col("type").alias("sub")).join(up, "sub").select("grp", F.col("sup").alias("type"))
    return members.join(below, ["grp", "type"], "left_anti")


def chosen_bodies(up: DataFrame, decls: DataFrame) -> DataFrame:
    """(type, sig, impl): for a type and signature the nearest declaration with a body in the type itself (any) or above it (not
    private)."""
    own = decls.where("has_body").select(F.col("type"), "sig", F.col("type").alias("impl"), F.lit(0).cast("long").alias("depth"))
    above = up.join(decls.where("has_body AND NOT private"), up.sup == decls.type).select(F.col("sub").alias("type"), "sig", F.col("sup").alias("impl"), "depth")
    near = Window.partitionBy("type", "sig").orderBy("depth", "impl")
    return own.unionByName(above).withColumn("r", F.row_number().over(near)).where("r = 1").select("type", "sig", "impl")


def virtual_candidates(up: DataFrame, decls: DataFrame, callees: DataFrame) -> DataFrame:
    """(type, sig, n, label, targets): bodies that a virtual call of `callees` (type, sig) can reach: its own body and the one of each
    subtype. No body NO_IMPL, the callee's only NO_OVERRIDE, another one only SINGLE_IMPL, more CHA."""
    bodies = chosen_bodies(up, decls)
    self_ = callees.join(decls.where("has_body").select("type", "sig", F.col("type").alias("impl")), ["type", "sig"])
    subs = callees.join(up.select("sub", F.col("sup").alias("type")), "type").join(bodies.select(F.col("type").alias("sub"), "sig", "impl"), ["sub", "sig"]).select("type", "sig", "impl")
    every = callees.join(self_.unionByName(subs).distinct(), ["type", "sig"], "left").groupBy("type", "sig").agg(F.array_sort(F.collect_set("impl")).alias("t"))
    label = F.when(F.size("t") == 0, "NO_IMPL").when((F.size("t") == 1) & (F.get("t", F.lit(0)) == F.col("type")), "NO_OVERRIDE").when(F.size("t") == 1, "SINGLE_IMPL").otherwise("CHA")
    return every.select("type", "sig", F.size("t").cast("long").alias("n"), label.alias("label"), F.array_join("t", ",").alias("targets"))


def bind_kind(name, mods):
    """The kind of binding from a method's name and modifiers, first match: C U P T F L V."""
    out = F.lit("V")
    for token, kind in reversed([("super", "U"), ("private", "P"), ("static", "T"), ("final", "F"), ("finalclass", "L")]):
        out = F.when(F.array_contains(mods, token), kind).otherwise(out)
    return F.when(name == "<init>", "C").otherwise(out)


#: Labels of kinds that leave nothing to choose.
BOUND = {"C": "STATIC_BOUND:CTOR", "U": "STATIC_BOUND:SUPER", "P": "STATIC_BOUND:PRIVATE", "T": "STATIC_BOUND:STATIC", "F": "NOT_OVERRIDABLE:FINAL_METHOD", "L": "NOT_OVERRIDABLE:FINAL_CLASS"}


#: Rules up to so many are broadcast to the calls; more are joined by a shuffle.
BROADCAST_RULES = 100_000


def cascade(sites: DataFrame, virtual: DataFrame, rules: DataFrame) -> DataFrame:
    """(edge_id, label, n, targets): bound kinds first; else the virtual candidates, unless CHA; then a rule (decl_type, sig or null,
    impl) that is the most specific; else CHA. Nothing is dropped: a site without candidates keeps its declaration."""
    bound = F.create_map(*[F.lit(x) for kv in BOUND.items() for x in kv])
    s = sites.withColumn("kind", bind_kind(F.col("sig"), F.col("mods")))
    s = s.join(virtual.select(F.col("type").alias("decl_type"), "sig", "n", "label", "targets"), ["decl_type", "sig"], "left")
    exact = rules.where("sig IS NOT NULL").select("decl_type", "sig", F.col("impl").alias("by_method"))
    wide = rules.where("sig IS NULL").select("decl_type", F.col("impl").alias("by_type"))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    s = s.join(F.broadcast(exact) if few else exact, ["decl_type", "sig"], "left").join(F.broadcast(wide) if few else wide, "decl_type", "left")
    rule, fixed = F.coalesce("by_method", "by_type"), bound[F.col("kind")]
    cha = (F.col("label") == "CHA") & rule.isNotNull()
    return s.select(
        "edge_id",
        F.when(fixed.isNotNull(), fixed).when(cha, F.lit("CALL_RULE")).otherwise(F.coalesce("label", F.lit("NO_IMPL"))).alias("label"),
        F.when(fixed.isNotNull() | cha, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"),
        F.when(fixed.isNotNull(), F.col("decl_type")).when(cha, rule).otherwise(F.coalesce(F.when(F.col("targets") == "", None).otherwise(F.col("targets")), F.col("decl_type"))).alias("targets"),
    )


#: Delegations that a chain of factories may have; beyond it the reference leaves them undecided too.
HARD_CAP = 512


def factory_fold(returns: DataFrame) -> DataFrame:
    """(method, value): methods whose every return folds to one value. returns (method, kind, value): kind T is a value, M delegates
    to another method, others are unknown. From none decided upwards, so members of a cycle of delegates stay undecided,
    and those more than HARD_CAP delegations away from a value."""
    known = None
    direct = returns.where("kind = 'T'").select("method", "value")
    total = returns.groupBy("method").agg(F.count("*").alias("n"))
    count = -1
    for _ in range(HARD_CAP + 1):
        rows = direct
        if known is not None:
            via = returns.where("kind = 'M'").select("method", F.col("value").alias("to")).join(known.select(F.col("method").alias("to"), "value"), "to")
            rows = rows.unionByName(via.select("method", "value"))
        agreed = rows.groupBy("method").agg(F.count("*").alias("c"), F.min("value").alias("value"), F.max("value").alias("most")).join(total, "method")
        known = cut(agreed.where("c = n AND value = most").select("method", "value"))
        now = known.count()
        if now == count:
            break
        count = now
    return known
