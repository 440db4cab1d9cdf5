from pyspark.sql import functions as F

from weftgraph.functions import names
from weftgraph.operators import graph, hierarchy, maintenance


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "caller long, callee long")


def roots(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long")


def test_diamond_repeats_by_path(spark):
    got = graph.paths(edges(spark, (1, 2), (1, 3), (2, 4), (3, 4)), roots(spark, 1), 5).collect()
    assert sorted(tuple(r.path) for r in got) == [(1, 2), (1, 2, 4), (1, 3), (1, 3, 4)]


def test_cycles_are_kept_and_not_expanded(spark):
    got = {tuple(r.path): r.note for r in graph.paths(edges(spark, (1, 2), (2, 1), (3, 3)), roots(spark, 1, 3), 5).collect()}
    assert got == {(1, 2): "", (1, 2, 1): "CYCLE", (3, 3): "CYCLE"}


def test_depth_note(spark):
    got = {tuple(r.path): r.note for r in graph.paths(edges(spark, (1, 2), (2, 3), (1, 4)), roots(spark, 1), 1).collect()}
    assert got == {(1, 2): "DEPTH", (1, 4): ""}


def test_self_call_shows_under_the_root_only(spark):
    got = sorted(tuple(r.path) for r in graph.tree(edges(spark, (1, 1), (1, 2), (2, 2)), 1, 4).collect())
    assert got == [(1, 1), (1, 2)]


def test_reachable_ends_on_cycles(spark):
    assert {r.node for r in graph.reachable(edges(spark, (1, 2), (2, 1), (2, 3)), roots(spark, 1)).collect()} == {1, 2, 3}


def test_splice_through_a_cycle_of_excluded_nodes(spark):
    e = edges(spark, (1, 10), (10, 11), (11, 10), (11, 2), (2, 3))
    assert {tuple(r) for r in graph.splice(e, roots(spark, 10, 11)).collect()} == {(1, 2), (2, 3)}


def test_factories_fold_and_cycles_stay_undecided(spark):
    rows = [("a", "T", "X"), ("a", "T", "X"), ("b", "M", "a"), ("c", "M", "d"), ("d", "M", "c"), ("e", "T", "X"), ("e", "T", "Y"), ("f", "U", None)]
    got = {r.method: r.value for r in hierarchy.factory_fold(spark.createDataFrame(rows, "method string, kind string, value string")).collect()}
    assert got == {"a": "X", "b": "X"}


def test_private_bodies_are_not_inherited(spark):
    up = hierarchy.closure(spark.createDataFrame([("B", "A"), ("C", "B")], "sub string, sup string"))
    decls = spark.createDataFrame([("A", "m", True, False), ("B", "m", True, True)], "type string, sig string, has_body boolean, private boolean")
    assert {(r.type, r.impl) for r in hierarchy.chosen_bodies(up, decls).collect()} == {("A", "A"), ("B", "B"), ("C", "A")}


def test_globs(spark):
    table = {"a.b.**": (["a.b.C", "a.b.c.D"], ["a.C", "ab.b.C"]), "a.b.*": (["a.b.C", "a.b.C$D"], ["a.b.c.D"]), "a.*Impl": (["a.XImpl"], ["a.b.XImpl", "a.Impl2"]), "**": ([], ["a.B"]), "a.**.c.*": (["a.c.X", "a.b.c.X"], ["a.b.X"])}
    for pattern, (yes, no) in table.items():
        df = spark.createDataFrame([(x,) for x in yes + no], "n string")
        assert {r.n for r in df.where(names.glob_match(F.col("n"), pattern)).collect()} == set(yes), pattern


def test_update_equals_full(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 5), ("d", 4)], "path string, v int")
    stale = spark.createDataFrame([("b",), ("c",), ("d",)], "path string")
    assert sorted(map(tuple, maintenance.replace_blocks(old, new, stale).collect())) == sorted(map(tuple, new.collect()))


def test_closure_and_fold_of_long_chains(spark):
    up = hierarchy.closure(spark.createDataFrame([(f"T{i + 1}", f"T{i}") for i in range(20)], "sub string, sup string")).collect()
    assert {(r["sub"], r["sup"]): r.depth for r in up} == {(f"T{i}", f"T{j}"): i - j for i in range(21) for j in range(i)}
    rows = [("f0", "T", "X")] + [(f"f{i + 1}", "M", f"f{i}") for i in range(36)]
    got = hierarchy.factory_fold(spark.createDataFrame(rows, "method string, kind string, value string")).collect()
    assert {r.method: r.value for r in got} == {f"f{i}": "X" for i in range(37)}


def test_stale_closure_of_a_long_chain(spark):
    changed = spark.createDataFrame([("p0",)], "path string")
    deps = spark.createDataFrame([(f"p{i + 1}", f"p{i}") for i in range(105)], "path string, dep string")
    assert {(r.path, r.round) for r in maintenance.stale_closure(changed, deps).collect()} == {(f"p{i}", i) for i in range(106)}
