"""Joins on ranges and prefixes, as equi-joins on bins and on exploded prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enclosing(points: DataFrame, ranges: DataFrame, bin_lines: int = 64) -> DataFrame:
    """(file, line, method): the narrowest range (file, method, lo, hi, ord) that holds the line, both ends included, ties by ord.

    Ranges are dealt to bins of lines, so a file's points meet the ranges near them only. Ranges with hi < lo hold nothing.
    """

    def bin_of(c):
        return F.floor(c / bin_lines)

    r = ranges.where("lo <= hi").withColumn("bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi")))))
    held = points.select("file", "line", bin_of(F.col("line")).alias("bin")).join(r, ["file", "bin"]).where("line BETWEEN lo AND hi")
    return held.groupBy("file", "line").agg(F.min_by("method", F.struct(F.expr("hi - lo"), F.col("ord"))).alias("method"))


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, tag): the tag of the longest of `prefixes` (prefix, tag) that is the path or a folder above it; null if none is."""
    parts = F.split("path", "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    distinct = paths.select("path").distinct()
    hit = distinct.select("path", F.explode(own).alias("prefix")).join(prefixes, "prefix")
    return distinct.join(hit.groupBy("path").agg(F.max_by("tag", F.struct(F.length("prefix"), F.col("tag"))).alias("tag")), "path", "left")
