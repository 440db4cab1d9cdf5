import pytest
from pyspark.sql import functions as F

from weftgraph.functions import names
from weftgraph.operators import dependencies, dispatch, hierarchy, ranges, reports
from weftgraph.plans import more
from weftgraph.sources import store
from weftgraph.streaming import maintain as live

DATA = "/root/testdata/sf0.001"


def test_guards_prune_only_what_is_known_to_be_violated(spark):
    rows = [(1, "EQ", "a", ["a"]), (2, "EQ", "b", ["a"]), (3, "EQ", None, ["a"]), (4, "NE", "a", ["a"]), (5, "IN", "c", ["a", "b"]), (6, "NI", "a", ["a", "b"]), (7, "??", "a", ["b"]), (8, "EQ", "a", ["a"]), (8, "NE", "x", ["x"])]
    got = dispatch.pruned_by_guards(spark.createDataFrame(rows, "edge_id long, op string, subject string, values array<string>"))
    assert sorted(r.edge_id for r in got.collect()) == [2, 4, 5, 6, 8]


def test_enclosing_is_narrowest_then_first(spark):
    r = spark.createDataFrame([("f", "outer", 1, 500, 0), ("f", "inner", 100, 110, 1), ("f", "twin", 100, 110, 2), ("f", "none", 9, 3, 3)], "file string, method string, lo long, hi long, ord int")
    p = spark.createDataFrame([("f", 1), ("f", 100), ("f", 110), ("f", 111), ("f", 500), ("f", 501), ("g", 5)], "file string, line long")
    assert {r.line: r.method for r in ranges.enclosing(p, r).collect()} == {1: "outer", 100: "inner", 110: "inner", 111: "outer", 500: "outer"}


def test_longest_prefix_ends_at_folders(spark):
    p = spark.createDataFrame([("a/b/c",), ("a/bc",), ("x",)], "path string")
    f = spark.createDataFrame([("a", "1"), ("a/b", "2")], "prefix string, tag string")
    assert {r.path: r.tag for r in ranges.longest_prefix(p, f).collect()} == {"a/b/c": "2", "a/bc": "1", "x": None}


def test_versions(spark):
    order = ["1.0-alpha", "1.0-beta2", "1.0-rc", "1.0", "1.0.1", "1.2", "1.10", "2"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r.v for r in df.orderBy(dependencies.version_key(F.col("v"))).collect()] == order
    assert [r.v for r in df.where(dependencies.in_range(F.col("v"), "1.0", "1.10")).orderBy(dependencies.version_key(F.col("v"))).collect()] == ["1.0", "1.0.1", "1.2"]
    assert df.select(dependencies.version_key(F.lit("1.0.0")) == dependencies.version_key(F.lit("1"))).first()[0]


EDGES = "artifact string, version string, dep string, dep_version string, ord long, exclusions array<string>"


def test_nearest_and_highest(spark):
    edges = spark.createDataFrame(
        [("r", "1", "a", "1", 0, []), ("r", "1", "b", "1", 1, ["z"]), ("a", "1", "c", "1", 0, []), ("b", "1", "c", "2", 0, []), ("b", "1", "z", "1", 1, []), ("c", "1", "a", "1", 0, []), ("c", "2", "d", "1", 0, []), ("c", "1", "b", "3", 1, [])], EDGES
    )
    root = spark.createDataFrame([("r", "1", 0)], "artifact string, version string, ord long")
    assert {r.artifact: r.version for r in dependencies.nearest(root, edges).collect()} == {"r": "1", "a": "1", "b": "1", "c": "1"}
    # versions only go up: b 3 stays forced though only c 1 asked for it, and c 2 though only b 1 did
    assert {r.artifact: r.version for r in dependencies.highest(root, edges).collect()} == {"r": "1", "a": "1", "b": "3", "c": "2", "d": "1"}


def test_nearest_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"a{i}", "1", f"a{i + 1}", "1", 0, []) for i in range(67)], EDGES)
    got = dependencies.nearest(spark.createDataFrame([("a0", "1", 0)], "artifact string, version string, ord long"), edges).collect()
    assert {r.artifact: r.depth for r in got} == {f"a{i}": i for i in range(68)}


def test_nearest_equals_a_walk(spark):
    _, edges = more._dependencies(spark, DATA)
    of = {}
    for r in edges.orderBy("ord").collect():
        of.setdefault((r.artifact, r.version), []).append((r.dep, r.dep_version))
    chosen, front = {}, [("A0", "1.0")]
    while front:
        after = []
        for a, v in front:
            if a not in chosen:
                chosen[a] = v
                after += of.get((a, v), [])
        front = after
    assert {r.artifact: r.version for r in more.dependency_nearest(spark, DATA).collect()} == chosen


def test_injection_is_unique_or_nothing(spark):
    up = hierarchy.closure(spark.createDataFrame([("A", "I"), ("B", "I"), ("C", "J"), ("D", "K")], "sub string, sup string"))
    beans = spark.createDataFrame([("A", "a", False), ("B", "b", False), ("C", "c", False), ("D", "d", True)], "type string, name string, undetermined boolean")
    points = spark.createDataFrame([(1, "I", None), (2, "I", "b"), (3, "J", None), (4, "J", "x"), (5, "K", None), (6, "M", None)], "point int, type string, qualifier string")
    assert {r.point: (r.label, r.impl) for r in dispatch.injected(points, beans, up).collect()} == {2: ("SPRING_DI_QUALIFIER", "B"), 3: ("SPRING_DI", "C")}


def test_narrowing_never_empties(spark):
    c = spark.createDataFrame([(1, ["b", "a"]), (2, ["a"]), (3, ["x", "y"])], "edge_id int, targets array<string>")
    b = spark.createDataFrame([(1, ["a", "z"]), (2, ["q"])], "edge_id int, allowed array<string>")
    assert {r.edge_id: (r.targets, r.narrowed) for r in dispatch.narrowed(c, b).collect()} == {1: (["a"], True), 2: (["a"], False), 3: (["x", "y"], False)}


def test_linkage_stops_at_abstract(spark):
    up = hierarchy.closure(spark.createDataFrame([("C", "B"), ("B", "A")], "sub string, sup string"))
    decls = spark.createDataFrame([("A", "m", True, False), ("B", "m", False, False)], "type string, sig string, has_body boolean, private boolean")
    assert {(r.type, r.decl, r.has_body) for r in dispatch.linked_declarations(up, decls).collect()} == {("A", "A", True), ("B", "B", False), ("C", "B", False)}


def test_absent_cause_takes_the_largest(spark):
    n = spark.createDataFrame([(i,) for i in range(4)], "node long")
    causes = spark.createDataFrame([(1, "PRUNED"), (1, "EXCLUDED"), (1, "CHA"), (2, "CYCLE")], "node long, cause string")
    assert {r.node: r.cause for r in reports.absent_cause(n, n.where("node = 0"), causes).collect()} == {1: "EXCLUDED", 2: "CYCLE", 3: "NOT_REACHED"}


def test_locations(spark):
    rows = [("p.Outer$Inner", "run", "src/p/Outer.java", 7), ("p.X", "lambda$go$3", "p/X.java", 1), ("q.Y", "m", None, 2)]
    df = spark.createDataFrame(rows, "t string, m string, f string, l int")
    got = [r[0] for r in df.select(names.location(F.col("t"), F.col("m"), F.col("f"), F.col("l"))).collect()]
    assert got == ["at p.Outer$Inner.run(Outer.java:7)", "at p.X.go(X.java:1)", "at q.Y.m(Unknown Source)"]


def test_store_round_trip_and_last_version(spark, tmp_path):
    rows = [("a\tb", 1, None), ("back\\slash\nline", None, True), ("", 3, False), ("\\N", 4, None), (None, 5, True)]
    df = spark.createDataFrame(rows, "path string, n int, ok boolean")
    root = str(tmp_path)
    store.write_store({"F": df.limit(1), "X": df.select("n")}, root, 1)
    store.write_store({"F": df, "X": df.select("n")}, root, 2)
    key = lambda r: repr(tuple(r))
    assert sorted(store.read_store(spark, root, "F", "path string, n int, ok boolean").collect(), key=key) == sorted(df.collect(), key=key)
    assert store.read_store(spark, root, "F", "path string, n int, ok boolean", 1).count() == 1
    with pytest.raises(Exception, match="does not have 2 columns"):
        store.read_store(spark, root, "F", "path string, n int").collect()


def test_maintenance_of_a_stream(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "path string, v long"
    stream = "path string, v long, deleted boolean, at long"
    for i, rows in enumerate([[("a", 1, False, 1), ("b", 1, False, 1), ("a", 2, False, 2), ("a", 3, False, 2)], [("b", 9, True, 3), ("c", 5, False, 3)]]):
        spark.createDataFrame(rows, stream).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.maintain(spark.readStream.schema(stream).parquet(str(tmp_path / "in")), root, schema, str(tmp_path / "c")).awaitTermination()
        got = sorted(map(tuple, live.current(spark, root, schema).collect()))
        assert got == [[("a", 2), ("a", 3), ("b", 1)], [("a", 2), ("a", 3), ("c", 5)]][i]
    # a batch whose pointer is written is not applied again: the same stream from another checkpoint starts at batch 0
    live.maintain(spark.readStream.schema(stream).parquet(str(tmp_path / "in")), root, schema, str(tmp_path / "c2")).awaitTermination()
    assert sorted(map(tuple, live.current(spark, root, schema).collect())) == [("a", 2), ("a", 3), ("c", 5)]


def test_unexpanded_summary_and_names(spark):
    sites = spark.createDataFrame([(1, "a", 4), (1, "a", 4), (2, "a", 9), (3, "a", 3), (4, "b", 3), (5, "c", None)], "edge_id long, callee string, n_candidates int")
    assert [tuple(r) for r in reports.unexpanded_summary(sites).collect()] == [("a", 9, 2)]
    assert reports.unexpanded_summary(sites.where("false")).count() == 0
    decls = spark.createDataFrame([(1, "T", "m", "b", 1, True), (2, "T", "m", "a", 9, True), (3, "T", "m", "a", 2, True), (4, "T", "m", "a", 1, False), (5, None, "m", "a", 1, True)], "method_id long, type string, name string, file string, line int, has_body boolean")
    assert {r.type: r.method_ids for r in reports.methods_by_name(decls).collect()} == {"T": [3, 2, 1], None: [5]}
    none = spark.createDataFrame([], "reachable boolean, role string")
    assert tuple(reports.inventory_stats(none).first()) == (0,) * 7
