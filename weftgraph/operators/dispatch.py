"""Further ways to find a call's targets: guards, values made nearby, injection, linkage, nearness of interfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pruned_by_guards(guards: DataFrame) -> DataFrame:
    """(edge_id): calls that some guard (edge_id, op, subject, values) rules out. Atoms are ANDed; an atom rules a call out only if its
    subject is known and violates it, so a null subject and an unknown op keep the call. Ops: EQ, NE, IN, NI."""
    inside = F.array_contains("values", F.col("subject"))
    bad = F.when(F.col("op").isin("EQ", "IN"), ~inside).when(F.col("op").isin("NE", "NI"), inside)
    return guards.where(F.coalesce(bad, F.lit(False))).select("edge_id").distinct()


def superinterfaces(up: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(type, interface, rank): the interfaces (type) above each type, nearest first, by name within a level."""
    near = Window.partitionBy("sub").orderBy("depth", "sup")
    rows = up.join(interfaces.select(F.col("type").alias("sup")).distinct(), "sup", "left_semi")
    return rows.select(F.col("sub").alias("type"), F.col("sup").alias("interface"), F.row_number().over(near).cast("long").alias("rank"))


def linked_declarations(up: DataFrame, decls: DataFrame) -> DataFrame:
    """(type, sig, decl, has_body): where linkage of a signature stops, from the type upwards: at the nearest declaration, whether it
    has a body or not, private ones too."""
    own = decls.select("type", "sig", F.struct(F.lit(0).cast("long").alias("depth"), F.col("type").alias("decl"), "has_body").alias("d"))
    above = up.join(decls, up.sup == decls.type).select(F.col("sub").alias("type"), "sig", F.struct("depth", F.col("sup").alias("decl"), "has_body").alias("d"))
    return own.unionByName(above).groupBy("type", "sig").agg(F.min("d").alias("d")).select("type", "sig", "d.decl", "d.has_body")


def local_new(sites: DataFrame, bodies: DataFrame) -> DataFrame:
    """(edge_id, label, targets): sites (edge_id, sig, hints: types that the receiver is made of nearby) whose hints all have a body:
    LOCAL_NEW if they choose one, else LOCAL_NEW_MULTI. A hint without a body leaves the site to later stages."""
    hints = sites.select("edge_id", "sig", F.explode(F.array_distinct("hints")).alias("type"))
    chosen = hints.join(bodies, ["type", "sig"], "left").groupBy("edge_id").agg(F.count("*").alias("n"), F.count("impl").alias("c"), F.array_sort(F.collect_set("impl")).alias("t"))
    return chosen.where("n = c").select("edge_id", F.when(F.size("t") == 1, "LOCAL_NEW").otherwise("LOCAL_NEW_MULTI").alias("label"), F.array_join("t", ",").alias("targets"))


def injected(points: DataFrame, beans: DataFrame, up: DataFrame) -> DataFrame:
    """(point, label, impl): injection points (point, type, qualifier) that exactly one bean (type, name, undetermined) fits.

    Candidates are beans of the type and its subtypes, with the qualifier as name where there is one. An undetermined bean among the
    type and its subtypes, or none or several candidates, decide nothing: such points have no row.
    """
    wanted = points.select("type").distinct()
    below = wanted.select("type", F.col("type").alias("impl")).unionByName(up.select(F.col("sup").alias("type"), F.col("sub").alias("impl")).join(wanted, "type", "left_semi")).distinct()
    of_type = below.join(beans.select(F.col("type").alias("impl"), "name", "undetermined"), "impl")
    # one row a type and name, and one a type: points join counts, never the beans themselves
    by_name = of_type.groupBy("type", F.col("name").alias("qualifier")).agg(F.countDistinct("impl").alias("n"), F.min("impl").alias("impl"))
    by_type = of_type.groupBy("type").agg(F.countDistinct("impl").alias("n_all"), F.min("impl").alias("impl_all"), F.max("undetermined").alias("unsure"))
    j = points.join(by_type, "type").where("NOT unsure").join(by_name, ["type", "qualifier"], "left")
    j = j.withColumn("n", F.when(F.col("qualifier").isNull(), F.col("n_all")).otherwise(F.col("n"))).where("n = 1")
    return j.select("point", F.when(F.col("qualifier").isNull(), "SPRING_DI").otherwise("SPRING_DI_QUALIFIER").alias("label"), F.when(F.col("qualifier").isNull(), F.col("impl_all")).otherwise(F.col("impl")).alias("impl"))


def narrowed(candidates: DataFrame, bound: DataFrame) -> DataFrame:
    """(edge_id, targets, narrowed): candidate arrays cut to those of the declared upper type (edge_id, allowed), in their order; an
    empty cut leaves them as they are."""
    j = candidates.join(bound, "edge_id", "left")
    few = F.filter("targets", lambda x: F.array_contains("allowed", x))
    use = F.coalesce((F.size(few) > 0) & (F.size(few) < F.size("targets")), F.lit(False))
    return j.select("edge_id", F.when(use, few).otherwise(F.col("targets")).alias("targets"), use.alias("narrowed"))


def mapped(sites: DataFrame, mapping: DataFrame) -> DataFrame:
    """(edge_id, impl): the mapping (key, impl) of a site (edge_id, decl_type, sig, hint) by HINT@hint, else type#method, else type."""
    keys = F.array(F.concat(F.lit("HINT@"), "hint"), F.concat_ws("#", "decl_type", "sig"), F.col("decl_type"))
    rows = sites.select("edge_id", F.posexplode(keys).alias("pos", "key")).where("key IS NOT NULL")
    return rows.join(mapping, "key").groupBy("edge_id").agg(F.min_by("impl", F.struct("pos", "impl")).alias("impl"))
