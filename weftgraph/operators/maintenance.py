"""Incremental maintenance of fact tables: what changed, what that makes stale, and the fixpoint of it."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.lineage import cut


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): ADDED, REMOVED, CHANGED or SAME of files (path, size, hash)."""
    o, n = old.select("path", F.struct("size", "hash").alias("was")), new.select("path", F.struct("size", "hash").alias("now"))
    change = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(F.col("was") != F.col("now"), "CHANGED").otherwise("SAME")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def stale_closure(changed: DataFrame, deps: DataFrame) -> DataFrame:
    """(path, round): files stale by change (round 0) or because they depend (path, dep) on one that is; ends when none is new."""
    seen = cut(changed.select("path").distinct().withColumn("round", F.lit(0).cast("long")))
    front = seen
    for k in count(1):
        hit = deps.join(front.select(F.col("path").alias("dep")), "dep").select("path").distinct()
        front = cut(hit.join(seen, "path", "left_anti").withColumn("round", F.lit(k).cast("long")))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def replace_blocks(old: DataFrame, new: DataFrame, stale: DataFrame) -> DataFrame:
    """Facts after an update: old rows of paths that are not stale, and the new rows of those that are."""
    return old.join(stale.select("path").distinct(), "path", "left_anti").unionByName(new.join(stale.select("path").distinct(), "path", "left_semi"))


def library_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(lib, change) of libraries (lib, fingerprint)."""
    both = old.select("lib", F.col("fingerprint").alias("was")).join(new.select("lib", F.col("fingerprint").alias("now")), "lib", "full_outer")
    return both.select("lib", F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(F.col("was") != F.col("now"), "CHANGED").otherwise("SAME").alias("change"))


def block_crc(rows: DataFrame) -> DataFrame:
    """(block, crc) over the lines of a block (block, pos, line) in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy("block").agg(F.crc32(F.array_join(lines, "\n")).alias("crc"))
