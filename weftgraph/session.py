"""One analysis as an object: fact tables in, lookups, trees and exports out. What a server would answer, as methods."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import graph, lookup, ranges, reports
from weftgraph.sinks import reports as sinks


@dataclass
class Engine:
    """edges: (caller, callee) keys of resolved calls; methods: (key, file, lo, hi); accesses: (file, line, owner, field, accessor, access);
    fields: (file, type, field). Tables are read when a method asks; nothing is held but their plans."""

    spark: SparkSession
    edges: DataFrame
    methods: DataFrame
    accesses: DataFrame | None = None
    fields: DataFrame | None = None
    info: dict[str, str] = field(default_factory=dict)

    def status(self) -> dict[str, int]:
        return {"methods": self.methods.count(), "edges": self.edges.count()}

    def find(self, key: str) -> tuple[str, str] | None:
        """(key, how) of a method by its key, or by type, name and number of parameters; None if there is none or several."""
        got = lookup.find(self.methods, self.spark.createDataFrame([(key,)], "wanted string")).first()
        return None if got is None else (got.key, got.how)

    def at(self, file: str, line: int) -> str | None:
        """The narrowest method around a line."""
        spans = self.methods.select("file", F.col("key").alias("method"), "lo", "hi", F.col("lo").alias("ord"))
        got = ranges.enclosing(self.spark.createDataFrame([(file, line)], "file string, line long"), spans).first()
        return None if got is None else got.method

    def field_at(self, file: str, line: int, name: str) -> tuple[str, list[str]] | None:
        """(how, keys) of the fields that a name at a line can be."""
        if line < 1:
            raise ValueError(f"not a line: {line}")
        spans = self.methods.select("file", "lo", "hi")
        got = lookup.field_at(self.accesses, self.fields, spans, self.spark.createDataFrame([(file, line, name)], "file string, line long, name string")).first()
        return None if got is None else (got.how, list(got["keys"]))

    def tree(self, key: str, depth: int = 3, up: bool = False) -> DataFrame:
        """(path, depth, node, recursive, truncated) of callees, or callers with `up`. Fails for an unknown method."""
        found = self.find(key)
        if found is None:
            raise KeyError(key)
        return graph.tree(self.edges, found[0], depth, up)

    def field_tree(self, owner: str, name: str) -> DataFrame:
        """(field, accessor, access, caller): who touches a field, and who calls those."""
        own = self.accesses.where((F.col("owner") == owner) & (F.col("field") == name)).select(F.concat_ws("#", "owner", "field").alias("field"), "accessor", "access")
        return reports.field_tree(own, self.edges)

    def export(self, key: str, path: str, depth: int = 3, up: bool = False) -> None:
        """The tree of a method as CSV under `path`: depth, method, file, line, reason, note."""
        t = self.tree(key, depth, up).withColumnRenamed("node", "key").join(self.methods.select("key", "file", F.col("lo").alias("line")), "key", "left").withColumn("reason", F.lit(""))
        rows = sinks.tree_export(t.orderBy("path"))
        sinks.write_lines(sinks.csv_lines(rows), path, header=",".join(rows.columns), one_file=True, bom=True)
