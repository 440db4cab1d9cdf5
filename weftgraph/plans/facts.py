"""Facts as selections from the driver's tables whose expressions both engines read alike: one text for Spark and for the oracle.

Only facts share text; what operators do with them has SQL of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Fact:
    """Rows of a table: expressions by name, a condition, distinct or not."""

    table: str
    columns: dict[str, str]
    where: str = "true"
    distinct: bool = False

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").where(self.where).selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])
        return out.distinct() if self.distinct else out

    @property
    def sql(self) -> str:
        return f"(SELECT {'DISTINCT ' * self.distinct}{', '.join(f'{e} AS {n}' for n, e in self.columns.items())} FROM {self.table} WHERE {self.where})"


def div(a: str, b: int) -> str:
    return f"cast(floor(({a}) / {b}) AS BIGINT)"


_MODS = "CASE s_suppkey % 9 WHEN 0 THEN 'private' WHEN 1 THEN 'static' WHEN 2 THEN 'protected' WHEN 3 THEN '' WHEN 4 THEN 'public final' ELSE 'public' END"
#: Suppliers as classes, four below each; nations as interfaces, five below each.
CLASSES = Fact("supplier", {"type": "'S' || s_suppkey", "pkg": "'p' || (s_suppkey % 3)"})
PARENTS = Fact("supplier", {"sub": "'S' || s_suppkey", "sup": f"'S' || {div('s_suppkey', 4)}"}, "s_suppkey >= 4")
IMPLEMENTS = Fact("supplier", {"sub": "'S' || s_suppkey", "sup": "'I' || s_nationkey"})
FACES = Fact("nation", {"type": "'I' || n_nationkey", "pkg": "'p' || (n_nationkey % 3)"})
EXTENDS = Fact("nation", {"sub": "'I' || n_nationkey", "sup": f"'I' || {div('n_nationkey', 5)}"}, "n_nationkey >= 5")


def class_decls(j: int) -> Fact:
    return Fact("supplier", {"type": "'S' || s_suppkey", "sig": f"'m' || ((s_suppkey + {j}) % 4) || '()'", "has_body": "s_suppkey % 5 <> 0", "mods": f"split({_MODS}, ' ')", "pkg": "'p' || (s_suppkey % 3)"})


def face_decls(j: int) -> Fact:
    return Fact("nation", {"type": "'I' || n_nationkey", "sig": f"'m{j}()'", "has_body": f"(n_nationkey + {j}) % 3 = 0", "mods": "split('public', ' ')", "pkg": "'p' || (n_nationkey % 3)"})


DECLS = [class_decls(0), class_decls(1)] + [face_decls(j) for j in range(4)]
#: Calls of interface methods on classes, and of the class above on those below.
WANTED = [Fact("supplier", {"type": "'S' || s_suppkey", "callee_type": "'I' || s_nationkey", "sig": f"'m{j}()'"}) for j in range(4)] + [
    Fact("supplier", {"type": "'S' || s_suppkey", "callee_type": f"'S' || {div('s_suppkey', 4)}", "sig": f"'m' || ({div('s_suppkey', 4)} % 4) || '()'"}, "s_suppkey >= 4")
]
_SITE_MODS = "CASE WHEN o_orderkey % 13 = 0 THEN 'super public' WHEN o_orderkey % 17 = 0 THEN 'finalclass' WHEN o_orderpriority LIKE '1%' THEN 'static' WHEN o_orderpriority LIKE '2%' THEN 'private' WHEN o_orderpriority LIKE '3%' THEN 'final public' ELSE 'public' END"
#: Orders as calls of interface methods.
SITES = Fact("orders", {
    "edge_id": "o_orderkey", "caller": "'C' || o_custkey", "decl_type": "'I' || (o_custkey % 25)", "from_type": "'I' || (o_custkey % 25)", "sig": "CASE WHEN o_orderkey % 19 = 0 THEN '<init>' ELSE 'm' || (o_orderkey % 4) || '()' END",
    "mods": f"split({_SITE_MODS}, ' ')", "guessed": "o_orderkey % 23 = 0", "line": "o_orderkey % 200", "k": "o_orderkey % 31",
})


def union(facts: list[Fact], spark: SparkSession, sf_dir: str) -> DataFrame:
    out = facts[0].df(spark, sf_dir)
    for f in facts[1:]:
        out = out.unionByName(f.df(spark, sf_dir))
    return out


def union_sql(facts: list[Fact]) -> str:
    return "(" + " UNION ALL ".join(f"SELECT * FROM {f.sql}" for f in facts) + ")"
