"""Which body runs when a method is called on a type: class chains, selection with access rules, overriders, super targets.

Tables: chain (type, pos, ancestor), the type itself at 0; interfaces (type, rank, interface), nearest first; up (sub, sup, depth), all
strict supertypes; decls (type, sig, has_body, mods array, pkg); types (type, pkg) of the types whose source is known.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.lineage import cut

#: Methods of all enums that cannot be overridden.
ENUM_FINAL = ["name()", "ordinal()", "compareTo(java.lang.Enum)", "equals(java.lang.Object)", "hashCode()", "getDeclaringClass()", "describeConstable()", "clone()", "finalize()"]


def class_chain(parents: DataFrame, types: DataFrame) -> DataFrame:
    """(type, pos, ancestor): each type with its superclasses up to the root, itself at 0. parents: (sub, sup), one class above each;
    types: (type), those without a class above among them. java.lang.Object is left out, and a cycle ends where it closes."""
    p = parents.where("sup <> 'java.lang.Object'").select("sub", "sup").distinct()
    every = p.select(F.col("sub").alias("type")).unionByName(p.select(F.col("sup").alias("type"))).unionByName(types.select("type")).distinct()
    front = every.select("type", F.lit(0).cast("long").alias("pos"), F.col("type").alias("ancestor"), F.array("type").alias("seen"))
    out = front.drop("seen")
    for pos in count(1):
        step = front.join(p, front.ancestor == p.sub).where(~F.array_contains("seen", F.col("sup")))
        front = cut(step.select("type", F.lit(pos).cast("long").alias("pos"), F.col("sup").alias("ancestor"), F.concat("seen", F.array("sup")).alias("seen")))
        if front.isEmpty():
            return cut(out)
        out = out.unionByName(front.drop("seen"))


def has(mods: Column | str, *tokens: str) -> Column:
    """Is one of the tokens among the modifiers?"""
    return F.arrays_overlap(F.coalesce(mods if isinstance(mods, Column) else F.col(mods), F.array().cast("array<string>")), F.array(*map(F.lit, tokens)))


def package_access(mods: Column | str) -> Column:
    return ~has(mods, "public", "protected", "private")


def overrides_in_package(wanted: DataFrame, chain: DataFrame, decls: DataFrame) -> DataFrame:
    """(type, sig, callee_type): declarations that override a package-access method of another package all the same, as a class of the
    callee's package between the two declares it public or protected. wanted: (type, sig, callee_type, callee_pkg)."""
    steps = wanted.join(chain.where("pos > 0"), "type")
    limit = chain.select("type", F.col("ancestor").alias("callee_type"), F.col("pos").alias("limit"))
    steps = steps.join(limit, ["type", "callee_type"], "left").where("limit IS NULL OR pos < limit")
    open_ = decls.where(has("mods", "public", "protected")).select(F.col("type").alias("ancestor"), "sig", F.col("pkg").alias("callee_pkg"))
    return steps.join(open_, ["ancestor", "sig", "callee_pkg"], "left_semi").select("type", "sig", "callee_type").distinct()


def implementations(wanted: DataFrame, chain: DataFrame, interfaces: DataFrame, up: DataFrame, decls: DataFrame, types: DataFrame, overrides: DataFrame | None = None, inherited: DataFrame | None = None) -> DataFrame:
    """(type, callee_type, sig, impl, impl_sig): the body that a call of callee_type's `sig` runs on an object of `type`; no row if
    there is none. wanted: (type, callee_type, sig).

    The class chain comes first, upwards: a declaration of the signature, or one that an override fact ties to the callee, with a body;
    above the type itself not a private one, a static one only if public, protected or of the type's package; for a callee of package
    access one of that package, or one that overrides it by way of it. In a class an inherited implementation comes after its own. Then
    superinterfaces: of the declarations that are neither private nor static the most specific with a body, sources before libraries,
    nearest first. overrides: (of_type, of_sig, type, sig) as transitive facts; inherited: (type, of_type, of_sig, by_type, by_sig).
    """
    pairs = wanted.select("type", "callee_type", "sig").distinct()
    known = decls.select(F.col("type").alias("d_type"), F.col("sig").alias("d_sig"), "has_body", "mods", F.col("pkg").alias("d_pkg"))
    callee = decls.select(F.col("type").alias("callee_type"), "sig", package_access("mods").alias("closed"), F.col("pkg").alias("callee_pkg"))
    pairs = pairs.join(callee, ["callee_type", "sig"], "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
    pairs = pairs.join(types.select("type", F.col("pkg").alias("own_pkg")), "type", "left")
    direct = known.select(F.col("d_type").alias("at"), F.col("d_sig").alias("sig"), "d_type", "d_sig", "has_body", "mods", "d_pkg")
    pairs = cut(pairs)
    steps = pairs.join(chain.withColumnRenamed("ancestor", "at"), "type")
    found = steps.join(direct, ["at", "sig"]).withColumn("by_fact", F.lit(False))
    far = found.where("closed AND d_pkg <> callee_pkg").select(F.col("d_type").alias("type"), "sig", "callee_type", "callee_pkg").distinct()
    across = overrides_in_package(far, chain, decls).select(F.col("type").alias("d_type"), "sig", "callee_type", F.lit(True).alias("across"))
    found = found.join(across, ["d_type", "sig", "callee_type"], "left").where("NOT closed OR d_pkg = callee_pkg OR across").drop("across")
    tied = None
    if overrides is not None:
        facts = overrides.select(F.col("of_type").alias("callee_type"), F.col("of_sig").alias("sig"), F.col("type").alias("d_type"), F.col("sig").alias("d_sig"))
        tied = facts.join(known, ["d_type", "d_sig"]).withColumn("at", F.col("d_type"))
        found = found.unionByName(steps.join(tied, ["callee_type", "sig", "at"]).withColumn("by_fact", F.lit(True)))
    inherits = (F.col("pos") == 0) | (~has("mods", "private") & (~has("mods", "static") | has("mods", "public", "protected") | (F.col("d_pkg") == F.col("own_pkg"))))
    found = found.where(F.col("has_body") & inherits)
    keys = ["type", "callee_type", "sig"]
    out = found.select(*keys, F.struct(F.lit(0).alias("by"), F.col("pos"), F.col("by_fact").cast("int").alias("kind"), F.col("d_type").alias("impl"), F.col("d_sig").alias("impl_sig")).alias("rank"))
    if inherited is not None:
        facts = inherited.select(F.col("type").alias("at"), F.col("of_type").alias("callee_type"), F.col("of_sig").alias("sig"), F.col("by_type").alias("d_type"), F.col("by_sig").alias("d_sig"))
        got = steps.join(facts, ["at", "callee_type", "sig"]).join(known.where("has_body"), ["d_type", "d_sig"])
        out = out.unionByName(got.select(*keys, F.struct(F.lit(0).alias("by"), F.col("pos"), F.lit(2).alias("kind"), F.col("d_type").alias("impl"), F.col("d_sig").alias("impl_sig")).alias("rank")))
    ends = steps.where((F.col("pos") > 0) & (F.col("at") == "java.lang.Enum") & F.col("sig").isin(ENUM_FINAL)).select(*keys, F.struct(F.lit(0).alias("by"), F.col("pos"), F.lit(3).alias("kind"), F.lit(None).cast("string").alias("impl"), F.col("sig").alias("impl_sig")).alias("rank"))
    out = out.unionByName(ends)
    # what the class chain decides asks no interface: few pairs are left to meet them
    by_class = cut(out.groupBy(*keys).agg(F.min("rank").alias("rank")))
    rest = cut(pairs.join(by_class.select(*[F.col(k).alias(f"{k}_") for k in keys]), [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], "left_anti"))
    declared = rest.join(interfaces.withColumnRenamed("interface", "at"), "type").join(direct, ["at", "sig"])
    declared = declared.where("NOT closed OR d_pkg = callee_pkg")
    if tied is not None:
        declared = declared.unionByName(rest.join(interfaces.withColumnRenamed("interface", "at"), "type").join(tied, ["callee_type", "sig", "at"]).select(declared.columns))
    declared = declared.where(~has("mods", "private", "static"))
    below = declared.select(*keys, F.col("at").alias("sub")).join(up.select("sub", "sup"), "sub").select(*keys, F.col("sup").alias("at")).distinct()
    specific = declared.join(below, [*keys, "at"], "left_anti").where("has_body")
    source = types.select(F.col("type").alias("at"), F.lit(0).alias("in_source"))
    specific = specific.join(source, "at", "left").withColumn("pos", F.coalesce("in_source", F.lit(1)) * F.lit(1 << 40) + F.col("rank"))
    by_face = specific.select(*keys, F.struct(F.lit(1).alias("by"), F.col("pos"), F.lit(0).alias("kind"), F.col("d_type").alias("impl"), F.col("d_sig").alias("impl_sig")).alias("rank"))
    best = by_class.unionByName(by_face.groupBy(*keys).agg(F.min("rank").alias("rank"))).where("rank.impl IS NOT NULL")
    best = best.select(*keys, F.col("rank.by").alias("by"), F.col("rank.pos").alias("found"), F.col("rank.impl").alias("impl"), F.col("rank.impl_sig").alias("impl_sig"))
    # written, as all that follows joins it several times
    return cut(lowest_overriders(best, chain, decls).select(*keys, "impl", "impl_sig"))


def lowest_overriders(chosen: DataFrame, chain: DataFrame, decls: DataFrame) -> DataFrame:
    """`chosen` (type, callee_type, sig, by, found, impl, impl_sig) where bodies that were found under another signature than the callee's
    give way to the lowest class below them that declares that signature again: with a body, neither private nor static, and where the
    body found is public, protected or of the same package."""
    d = decls.select(F.col("type").alias("ancestor"), F.col("sig").alias("impl_sig"), "has_body", F.col("mods").alias("low_mods"), F.col("pkg").alias("low_pkg"))
    own = decls.select(F.col("type").alias("impl"), F.col("sig").alias("impl_sig"), F.col("mods").alias("impl_mods"), F.col("pkg").alias("impl_pkg"))
    other = chosen.where("by = 0 AND found > 0 AND impl_sig <> sig").join(own, ["impl", "impl_sig"], "left")
    low = other.join(chain, "type").where("pos < found").join(d, ["ancestor", "impl_sig"]).where(F.col("has_body") & ~has("low_mods", "private", "static"))
    low = low.where(has("impl_mods", "public", "protected") | (F.col("low_pkg") == F.col("impl_pkg")))
    low = low.groupBy("type", "callee_type", "sig").agg(F.min_by("ancestor", "pos").alias("low"))
    return chosen.join(low, ["type", "callee_type", "sig"], "left").withColumn("impl", F.coalesce("low", "impl")).drop("low")


def signature_implementations(wanted: DataFrame, chain: DataFrame, interfaces: DataFrame, up: DataFrame, decls: DataFrame, types: DataFrame) -> DataFrame:
    """(type, sig, impl): the same by signature alone, for (type, sig): no callee, so no package of its own to keep to."""
    got = implementations(wanted.select("type", F.lit(None).cast("string").alias("callee_type"), "sig").withColumn("callee_type", F.lit("")), chain, interfaces, up, decls, types)
    return got.select("type", "sig", "impl")


def passes_binary(pairs: DataFrame, chain: DataFrame, interfaces: DataFrame, types: DataFrame) -> DataFrame:
    """(type, impl): pairs between which a class without source lies, so that what runs may be a body that nobody sees. For a body in an
    interface every class of the chain counts, and so do unseen interfaces but those of java and javax. pairs: (type, impl, interface
    boolean: is impl one)."""
    unseen = chain.join(types.select(F.col("type").alias("ancestor")), "ancestor", "left_anti").select("type", "pos")
    place = chain.select("type", F.col("ancestor").alias("impl"), F.col("pos").alias("place"))
    first = unseen.groupBy("type").agg(F.min("pos").alias("first"))
    by_class = pairs.join(first, "type").join(place, ["type", "impl"], "left").where("place IS NULL OR first < place").select("type", "impl")
    foreign = interfaces.where(~F.col("interface").rlike(r"^javax?\.")).join(types.select(F.col("type").alias("interface")), "interface", "left_anti").select("type")
    by_interface = pairs.where("interface").join(foreign, "type", "left_semi").select("type", "impl")
    return by_class.unionByName(by_interface).distinct()


def overriding(methods: DataFrame, up: DataFrame, chosen: DataFrame) -> DataFrame:
    """(type, sig, impl): bodies other than a method's own that a call of it may run: those chosen for the subtypes of its type.
    methods: (type, sig); chosen: of `implementations` for every subtype."""
    got = chosen.select(F.col("type").alias("sub"), F.col("callee_type").alias("type"), "sig", "impl").join(up.select("sub", F.col("sup").alias("type")), ["sub", "type"], "left_semi")
    return methods.select("type", "sig").distinct().join(got, ["type", "sig"]).where("impl <> type").select("type", "sig", "impl").distinct()


def dispatches_elsewhere(methods: DataFrame, up: DataFrame, chosen: DataFrame, binary: DataFrame, types: DataFrame, functional: DataFrame | None = None) -> DataFrame:
    """(type, sig, elsewhere): can a call of the method (type, sig, mods) run another body? Not if it is a constructor, static, private or
    final; yes if its source is unknown, if lambdas implement it (functional: type, sig), or if for some subtype another body or none is
    chosen, or a class without source lies between (binary: type, impl)."""
    subs = methods.select("type", "sig").join(up.select("sub", F.col("sup").alias("type")), "type")
    picked = chosen.select(F.col("type").alias("sub"), F.col("callee_type").alias("type"), "sig", "impl")
    hidden = binary.select(F.col("type").alias("sub"), "impl", F.lit(True).alias("hidden"))
    other = subs.join(picked, ["sub", "type", "sig"], "left").join(hidden, ["sub", "impl"], "left").where("impl IS NULL OR impl <> type OR hidden").select("type", "sig")
    if functional is not None:
        other = other.unionByName(functional.select("type", "sig"))
    other = other.distinct().withColumn("other", F.lit(True))
    fixed = F.col("sig").rlike(r"^<(?:cl)?init>") | has("mods", "static", "private", "final")
    seen = types.select("type", F.lit(True).alias("seen"))
    got = methods.select("type", "sig", "mods").join(other, ["type", "sig"], "left").join(seen, "type", "left")
    return got.select("type", "sig", F.when(F.col("seen").isNull(), True).when(fixed, False).otherwise(F.coalesce("other", F.lit(False))).alias("elsewhere"))


def super_targets(sites: DataFrame, chosen: DataFrame) -> DataFrame:
    """(edge_id, target): what a call by super runs: the body chosen for the qualifying type, else the declaration. sites: (edge_id,
    qualifier, decl_type, sig)."""
    body = chosen.select(F.col("type").alias("qualifier"), F.col("callee_type").alias("decl_type"), "sig", "impl")
    return sites.join(body, ["qualifier", "decl_type", "sig"], "left").select("edge_id", F.coalesce("impl", "decl_type").alias("target"))


def resolved_declarations(wanted: DataFrame, chain: DataFrame, interfaces: DataFrame, up: DataFrame, decls: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """(type, sig, decl, has_body): where a reference to (type, sig) is linked: the first class of the chain that declares it, abstract and
    private ones too; else of the superinterfaces' declarations that are neither private nor static the most specific, those with a
    body first. bridges: (type, sig, by_type) whose own declaration stands in for a signature before it is declared there."""
    pairs = wanted.select("type", "sig").distinct()
    own = decls.select(F.col("type").alias("at"), "sig", F.col("type").alias("decl"), "has_body", "mods", F.lit(1).alias("late"))
    if bridges is not None:
        body = decls.select(F.col("type").alias("decl"), "has_body", "mods").where("has_body").dropDuplicates(["decl"])
        own = own.unionByName(bridges.select(F.col("type").alias("at"), "sig", F.col("by_type").alias("decl")).join(body, "decl").withColumn("late", F.lit(0)).select(own.columns))
    by_class = pairs.join(chain.withColumnRenamed("ancestor", "at"), "type").join(own, ["at", "sig"])
    out = by_class.select("type", "sig", F.struct(F.lit(0).alias("by"), F.lit(0).alias("no_body"), F.col("pos"), "late", "decl", "has_body").alias("d"))
    declared = pairs.join(interfaces.withColumnRenamed("interface", "at"), "type").join(own, ["at", "sig"]).where(~has("mods", "private", "static"))
    below = declared.select("type", "sig", F.col("at").alias("sub")).join(up.select("sub", "sup"), "sub").select("type", "sig", F.col("sup").alias("at")).distinct()
    specific = declared.join(below, ["type", "sig", "at"], "left_anti")
    out = out.unionByName(specific.select("type", "sig", F.struct(F.lit(1).alias("by"), (~F.col("has_body")).cast("int").alias("no_body"), F.col("rank").alias("pos"), "late", "decl", "has_body").alias("d")))
    return out.groupBy("type", "sig").agg(F.min("d").alias("d")).select("type", "sig", "d.decl", "d.has_body")
