"""Transitive dependencies: walks by level, mediation of versions, exclusions, order of versions.

Edges are (artifact, version, dep, dep_version, ord, exclusions): what a version of an artifact asks for, in order. exclusions is an
array of artifacts that are not to be followed below that edge, `*` for all.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.lineage import cut


def version_key(version: Column) -> Column:
    """An array that orders versions: numbers by value, letters (a qualifier) before the release, more numbers after it; zeros
    at the end or before a qualifier don't count."""
    plain = F.regexp_replace(version, r"([.-]0+)+(?=$|[.-]?[A-Za-z])", "")
    tokens = F.regexp_extract_all(plain, F.lit(r"([0-9]+|[A-Za-z]+)"), F.lit(1))
    coded = F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("2"), F.lpad(t, 20, "0"))).otherwise(F.concat(F.lit("0"), F.lower(t))))
    return F.concat(coded, F.array(F.lit("1")))


def in_range(version: Column, low: str | None, high: str | None, low_in: bool = True, high_in: bool = False) -> Column:
    """Is the version between the bounds? A bound of None is open."""
    key, out = version_key(version), F.lit(True)
    if low is not None:
        edge = version_key(F.lit(low))
        out = out & ((key >= edge) if low_in else (key > edge))
    if high is not None:
        edge = version_key(F.lit(high))
        out = out & ((key <= edge) if high_in else (key < edge))
    return out


def _walk(roots: DataFrame, edges: DataFrame, forced: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(chosen, asked): by level the first mention of each artifact, and every mention (artifact, version)."""
    front = roots.select("artifact", "version", F.lit(0).cast("long").alias("depth"), F.array("ord").alias("place"), F.array().cast("array<string>").alias("excluded"), F.array("artifact").alias("via"))
    chosen = asked = None
    for depth in count():
        if forced is not None:
            front = front.join(forced.select("artifact", F.col("version").alias("forced")), "artifact", "left").withColumn("version", F.coalesce("forced", "version")).drop("forced")
        if chosen is not None:
            front = front.join(chosen.select("artifact"), "artifact", "left_anti")
        first = Window.partitionBy("artifact").orderBy("place")
        front = cut(front.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r"))
        if front.isEmpty():
            break
        chosen = front if chosen is None else cut(chosen.unionByName(front))
        below = front.join(edges.withColumnsRenamed({"artifact": "_a", "version": "_v", "ord": "_o"}), (F.col("artifact") == F.col("_a")) & (F.col("version") == F.col("_v")))
        below = below.where(~F.array_contains("excluded", F.col("dep")) & ~F.array_contains("excluded", F.lit("*")))
        front = cut(below.select(
            F.col("dep").alias("artifact"), F.col("dep_version").alias("version"), F.lit(depth + 1).cast("long").alias("depth"), F.concat("place", F.array("_o")).alias("place"),
            F.array_union("excluded", F.coalesce("exclusions", F.array().cast("array<string>"))).alias("excluded"), F.concat("via", F.array("dep")).alias("via"),
        ))
        seen = front.select("artifact", "version")
        asked = seen if asked is None else asked.unionByName(seen)
    empty = roots.select("artifact", "version").limit(0)
    if chosen is None:
        chosen = front
    return chosen, (empty if asked is None else asked).unionByName(roots.select("artifact", "version"))


def nearest(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact, version, depth, via): of each artifact the version met first, by level and then in order. The walk goes on from
    chosen versions only, so cycles end. roots: (artifact, version, ord)."""
    return _walk(roots, edges, None)[0].select("artifact", "version", "depth", "via")


#: Walks until forced versions must be stable.
ROUNDS = 20


def highest(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact, version, depth, via): of each artifact the highest version that any chosen one asks for; walks again with those
    versions forced until they are stable. Raises if they are not after ROUNDS walks, rather than give versions that don't hold."""
    forced = before = None
    for _ in range(ROUNDS):
        chosen, asked = _walk(roots, edges, forced)
        if forced is not None:
            asked = asked.unionByName(forced)
        forced = cut(asked.withColumn("k", version_key(F.col("version"))).groupBy("artifact").agg(F.max_by("version", F.struct("k", "version")).alias("version")))
        if before is not None and forced.exceptAll(before).isEmpty():
            return chosen.select("artifact", "version", "depth", "via")
        before = forced
    raise RuntimeError(f"versions are not stable after {ROUNDS} walks")
