"""Staleness, values, building, walks, conditions and report forms on small facts whose results are written out."""

import random

from pyspark.sql import functions as F

from weftgraph.functions import names
from weftgraph.operators import build, conditions, hierarchy, maintenance, staleness, values, walk
from weftgraph.sinks import reports as sinks


def rows(df, *cols):
    return {tuple(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in (cols or df.columns)) for r in df.collect()}


def table(spark, schema, *given):
    return spark.createDataFrame(list(given), schema)


# --- staleness ------------------------------------------------------------------------------------------------------------------


def test_stale_types_and_heads(spark):
    up = table(spark, "sub string, sup string", ("b.B", "a.A"), ("c.C", "b.B"), ("d.D", "x.X"))
    assert rows(staleness.stale_types(table(spark, "type string", ("a.A",)), up)) == {("a.A",), ("b.B",), ("c.C",)}
    got = table(spark, "n string", ("a.b.C",), ("x",), ("a.B$C",)).select("n", staleness.heads(F.col("n")).alias("d"), staleness.heads(F.col("n"), "[.$]").alias("s"))
    assert rows(got) == {("a.b.C", ("a", "a.b"), ("a", "a.b")), ("x", (), ()), ("a.B$C", ("a",), ("a", "a.B"))}
    assert rows(table(spark, "p string", ("a/b/C.java",), ("C.java",)).select(staleness.package_of_unit(F.col("p")))) == {("a.b",), ("",)}


def test_touched_files(spark):
    files = table(spark, "path string, pkg string", ("f1", "p"), ("f2", "q"), ("f3", "r"), ("f4", "s"), ("f5", None), ("f6", "p"), ("f7", "t"), ("f8", "t"))
    deps = table(spark, "path string, dep string", ("f1", "a.A"), ("f2", "a.A.Inner"), ("f3", "a.A$In"), ("f4", "b.*"), ("f5", "z.Z"), ("f6", "y.Y"), ("f7", "lib.x.T"), ("f8", "Plain"))
    a, none = table(spark, "type string", ("a.A",)), table(spark, "pkg string")
    assert rows(staleness.touched(files, deps, a, none), "path") == {("f1",), ("f2",), ("f3",)}
    assert rows(staleness.touched(files, deps, a.limit(0), table(spark, "pkg string", ("b",))), "path") == {("f4",)}
    assert rows(staleness.touched(files, deps, a.limit(0), none, moved=table(spark, "pkg string", ("y",))), "path") == {("f6",)}
    assert rows(staleness.touched(files, deps, a.limit(0), none, top_level=table(spark, "pkg string", ("p",))), "path") == {("f1",), ("f5",), ("f6",)}
    lib = staleness.touched(files, deps, a, none, libraries=table(spark, "pkg string", ("lib.x",), ("a",)))
    assert rows(lib) == {("f1", "BY_SOURCE"), ("f2", "BY_SOURCE"), ("f3", "BY_SOURCE"), ("f5", "BY_LIBRARY"), ("f7", "BY_LIBRARY")}
    assert rows(staleness.touched(files, deps, a.limit(0), none, libraries=table(spark, "pkg string", ("",))), "path") == {("f8",), ("f5",)}
    assert rows(staleness.reason_counts(lib)) == {("BY_SOURCE", 3), ("BY_LIBRARY", 2)}


def test_cascade_stops_where_declarations_stay(spark):
    files = table(spark, "path string, pkg string", *[(f"f{i}", f"p{i}") for i in range(5)])
    deps = table(spark, "path string, dep string", ("f1", "p0.T"), ("f2", "p1.T"), ("f3", "p2.T"), ("f4", "none.T"))
    declared = table(spark, "path string, type string, pkg string", *[(f"f{i}", f"p{i}.T", f"p{i}") for i in range(5)])
    edges, changed = table(spark, "sub string, sup string"), table(spark, "path string", ("f0",))
    all_ = table(spark, "path string", *[(f"f{i}",) for i in range(5)])
    assert rows(staleness.cascade(files, deps, declared, edges, changed, all_)) == {("f0", 0), ("f1", 1), ("f2", 2), ("f3", 3)}
    assert rows(staleness.cascade(files, deps, declared, edges, changed, all_.where("path <> 'f2'"))) == {("f0", 0), ("f1", 1), ("f2", 2)}


def test_new_types_packages_and_plans(spark):
    declared = table(spark, "type string, pkg string", ("p.New", "p"), ("p.New.In", "p"), ("q.Old", "q"), ("Top", ""))
    assert rows(staleness.new_top_level(declared, table(spark, "type string", ("q.Old",)))) == {("p",), ("",)}
    assert rows(staleness.packages_gone_or_new(table(spark, "pkg string", ("a",), ("b",)), table(spark, "pkg string", ("b",), ("c",)))) == {("a", "REMOVED"), ("c", "CREATED")}
    diff = table(spark, "path string, change string", ("a", "CHANGED"), ("b", "SAME"))
    bad, paths = table(spark, "path string", ("z",)), table(spark, "path string", ("a",), ("b",), ("z",))
    mode, some = staleness.plan(diff, bad, "1", "1", paths)
    assert mode == "SOME" and rows(some) == {("a",), ("z",)}
    assert staleness.plan(diff, bad, "1", "2", paths)[0] == "ALL" and staleness.plan(diff.where("path = 'b'"), bad, "1", "2", paths)[0] == "NONE"
    types = table(spark, "type string, kind string, supers array<string>", ("A", "C", ["X", "Y"]), ("B", "I", []))
    turned = table(spark, "type string, kind string, supers array<string>", ("B", "I", []), ("A", "C", ["Y", "X"]))
    assert staleness.hierarchy_digest(types) == staleness.hierarchy_digest(turned) != staleness.hierarchy_digest(types.where("type = 'A'"))
    lines = table(spark, "path string, line string", ("f", "b"), ("f", "a"), ("g", "a"), ("g", "b"), ("h", "a"))
    prints = dict(rows(staleness.declaration_fingerprint(lines)))
    assert prints["f"] == prints["g"] != prints["h"]
    seen = staleness.moved_while_read(table(spark, "path string, size long, hash string", ("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")), table(spark, "path string, size long, hash string", ("a", 1, "x"), ("b", 2, "w"), ("d", 4, "v")))
    assert rows(seen) == {("a", "x"), ("b", None), ("c", None), ("d", None)}
    old = table(spark, "lib string, ord int, pkg string", ("l1", 1, "p"), ("l2", 2, "p"), ("l3", 3, "q"), ("l4", 4, "q"))
    new = table(spark, "lib string, ord int, pkg string", ("l2", 1, "p"), ("l1", 2, "p"), ("l3", 5, "q"), ("l9", 6, "q"), ("l4", 7, "q"))
    assert rows(staleness.reordered_packages(old, new)) == {("p",)}


# --- values ---------------------------------------------------------------------------------------------------------------------


def test_values(spark):
    nodes = table(spark, "node long, kind string, value string, recv long", (1, "T", "X", None), (2, "A", "0", None), (3, "M", "f", None), (4, "M", "g", None), (5, "M", "h", None), (6, "L", "a.Y", None), (7, "F", "C#x", None),
                  (8, "O", "C#x", None), (9, "F", "C#p", None), (10, "M", "g", None), (11, "U", None, None), (12, "K", "Z", None), (13, "M", "lit", None))
    args = table(spark, "node long, pos int, arg long", (4, 0, 3), (5, 0, 6), (10, 0, 2))
    folded = table(spark, "method string, kind string, value string", ("f", "T", "FX"), ("g", "A", "0"), ("h", "C", "0"), ("lit", "L", "v"))
    fields = table(spark, "field string, kind string, value string", ("C#x", "T", "FT"), ("C#p", "A", "0"))
    known = table(spark, "type string", ("a.Y",))
    got = dict((n, (t, h)) for n, t, h in rows(values.concrete_types(nodes, args, folded, fields, known)))
    assert got == {1: ("X", "T"), 3: ("FX", "M"), 4: ("FX", "M"), 5: ("a.Y", "M"), 7: ("FT", "F"), 8: ("FT", "O")}
    env = table(spark, "ctx long, index int, tag string, value string", (100, 0, "TYPE", "P1"), (200, 0, "LITERAL", "s"))
    assert rows(values.concrete_types(nodes, args, folded, fields, known, env)) == {(100, 2, "P1", "A"), (100, 10, "P1", "M"), (100, 9, "P1", "F")}
    assert rows(values.evaluate(nodes, args, folded)) == {(6, "LITERAL", "a.Y"), (12, "CLASS", "Z"), (13, "LITERAL", "v")}
    assert rows(values.evaluate(nodes, args, folded, env)) == {(200, 2, "LITERAL", "s"), (200, 10, "LITERAL", "s")}
    calls = table(spark, "ctx long, edge_id long, args_node long", (100, 1, 20), (200, 1, 20))
    given = table(spark, "node long, pos int, arg long", (20, 0, 1), (20, 1, 12), (20, 2, 2), (20, 3, 11), (20, 4, 8))
    types = values.concrete_types(nodes, args, folded, fields, known).select("node", "type").where("node = 1")
    bounds = table(spark, "node long, type string", (11, "Up"), (1, "No"))
    assert rows(values.bind_arguments(calls, given, nodes, types, env, bounds)) == {
        (c, 1, i, t, v) for c in (100, 200) for i, t, v in ((0, "TYPE", "X"), (1, "CLASS", "Z"), (2, *(("TYPE", "P1") if c == 100 else ("LITERAL", "s"))), (3, "BOUND", "Up"))
    }
    made = table(spark, "node long, ctor string", (20, "C(a)"))
    sets = table(spark, "field string, ctor string, pos int", ("C#x", "C(a)", 0), ("C#y", "C(a)", 3))
    assert rows(values.bind_constructor(made, given, types, sets)) == {(20, "C#x", "X")}
    up = table(spark, "sub string, sup string", ("B", "A"), ("C", "B"), ("C", "A"))
    assert rows(values.narrower(table(spark, "node long, type string", (1, "A"), (1, "C"), (2, "Z"), (2, "Y")), up)) == {(1, "C"), (2, "Y")}


def test_uses_of_parameters(spark):
    nodes = table(spark, "node long, kind string, value string, recv long", (1, "A", "0", None), (2, "M", "f", 1), (3, "M", "g", None), (4, "P", "0", None), (5, "T", "X", None), (6, "M", "h", 2))
    args = table(spark, "node long, pos int, arg long", (3, 0, 6))
    calls = table(spark, "caller string, recv long, args_node long", ("a", 3, None), ("b", 5, None), ("l", 4, None), ("c", None, 1))
    assert rows(values.uses(nodes, args, calls)) == {("a",), ("c",)}
    makes = table(spark, "caller string, body string", ("b", "l"), ("d", "a"))
    assert rows(values.uses_parameters(nodes, args, calls, makes, table(spark, "caller string", ("e",)))) == {("a",), ("c",), ("b",), ("e",)}
    kinds = table(spark, "method string", ("java.lang.Class#forName(java.lang.String)",), ("java.lang.Class#newInstance()",), ("a.B#c()",), ("java.lang.reflect.Method#invoke(java.lang.Object,java.lang.Object[])",))
    assert {k for _, k in rows(values.reflection_kinds(kinds))} == {"FOR_NAME", "NEW_INSTANCE", "INVOKE"}
    assert rows(values.reachable_nodes(nodes, args, table(spark, "node long", (3,))), "node") == {(3,), (6,), (2,), (1,)}
    twins = table(spark, "file string, node long, kind string, value string, recv long", ("f", 1, "L", "a", None), ("f", 2, "L", "a", None), ("f", 3, "M", "m", None), ("f", 4, "M", "m", None), ("g", 5, "L", "a", None))
    assert rows(values.shared_nodes(twins, table(spark, "file string, node long, pos int, arg long", ("f", 3, 0, 1), ("f", 4, 0, 2)))) == {("f", 1, 1), ("f", 2, 1), ("f", 3, 3), ("f", 4, 4), ("g", 5, 5)}
    returned = values.returns_of(table(spark, "method string, node long", ("m", 1), ("m", 1), ("m", 99)), nodes)
    assert rows(returned) == {("m", "A", "0"), ("m", "U", None)}


def test_fields(spark):
    def field(n, mods="private", framework=False):
        return (f"C#{n}", "C", mods.split(), framework)

    fields = table(spark, "field string, type string, mods array<string>, framework boolean", field("init"), field("ctors"), field("one"), field("late"), field("two"), field("pub", "public"), field("fw", "private", True), field("st", "private static"), field("par"), ("D#par", "D", ["final"], False), field("unk"))
    rows_ = [("init", "<field>", "T", "X"), ("ctors", "c1", "T", "X"), ("ctors", "c2", "T", "X"), ("one", "c1", "T", "X"), ("late", "<field>", "T", "X"), ("late", "?", "T", "X"), ("two", "c1", "T", "X"), ("two", "c2", "T", "Y"),
             ("pub", "<field>", "T", "X"), ("fw", "<field>", "T", "X"), ("st", "<field>", "T", "X"), ("par", "c1", "A", "0"), ("par", "c2", "A", "0"), ("unk", "<field>", "U", None)]
    assigns = table(spark, "field string, site string, kind string, value string", *[(f"C#{f}", s, k, v) for f, s, k, v in rows_], ("D#par", "d1", "A", "0"))
    ctors = table(spark, "type string, sig string", ("C", "c1"), ("C", "c2"), ("D", "d1"))
    got = rows(values.field_values(fields, assigns, ctors, table(spark, "type string", ("D",))))
    assert got == {("C#init", "T", "X"), ("C#ctors", "T", "X"), ("C#par", "A", "0")}
    own = values.own_valued(fields, assigns.select("field", "kind"), table(spark, "field string, kind string", ("C#par", "T")))
    assert {f for (f,) in rows(own)} >= {"C#init", "C#par"} and ("D#par",) not in rows(own) and ("C#st",) not in rows(own)
    local = table(spark, "var string, node long", ("a", 1), ("a", 2), ("b", 1), ("c", 3), ("d", 1), ("d", 9), ("e", 4), ("f", 5))
    nodes = table(spark, "node long, kind string, value string", (1, "T", "X"), (2, "T", "X"), (3, "X", "a"), (4, "X", "e"), (9, "T", "Y"), (5, "X", "c"))
    assert rows(values.merged_origins(local, nodes)) == {("a", "T", "X"), ("b", "T", "X"), ("c", "T", "X"), ("d", "U", None), ("e", "U", None), ("f", "T", "X")}


# --- building -------------------------------------------------------------------------------------------------------------------


def test_build(spark):
    symbols = table(spark, "file string, sym int, type string, method string, params string, pkg string", ("f", 1, "a.A", "m", "int", "a"), ("g", 1, "b.B", "n", "", "b"))
    facts = table(spark, "file string, caller int, line int", ("f", 1, 10), ("f", 2, 11), ("g", 1, 12), ("g", None, 13))
    good, bad = build.with_symbols(facts, symbols, "caller")
    assert rows(good, "line", "caller_key") == {(10, "a.A#m(int)"), (12, "b.B#n()"), (13, None)} and rows(bad) == {("f", 2, 1)}
    assert rows(sinks.dump(facts.where("line = 10"), symbols, ["caller"]), "line", "caller_pkg", "caller_type", "caller_method", "caller_params") == {(10, "a", "a.A", "m", "int")}
    ids = build.dictionary(table(spark, "name string", *[(f"n{i % 50}",) for i in range(200)], (None,))).collect()
    assert sorted(r.id for r in ids) == list(range(50)) and len({r.name for r in ids}) == 50
    decls = table(spark, "key string, folder string, path string, line int", ("k", "s2", "a", 1), ("k", "s1", "z", 2), ("k", "s1", "b", 9), ("j", "s2", "a", 1))
    kept, doubles = build.first_declarations(decls, table(spark, "folder string, ord int", ("s1", 0), ("s2", 1)))
    assert rows(kept, "key", "path") == {("k", "b"), ("j", "a")} and rows(doubles) == {("k", "a", "b"), ("k", "z", "b")}
    kinds = build.edges(table(spark, "method string, mods array<string>", ("<init>", ["private"]), ("a", ["super", "static"]), ("b", ["finalclass"]), ("c", ["final", "finalclass"]), ("d", [])))
    assert rows(kinds, "method", "kind") == {("<init>", "C"), ("a", "U"), ("b", "L"), ("c", "F"), ("d", "V")}
    calls = table(spark, "file string, receiver string, method string, caller string", ("f", "A", "m()", "x"), ("f", "B", "m()", "x"), ("f", "C", "m()", None), ("g", "A", "m()", "x"))
    imports = table(spark, "file string, type string", ("f", "p.A"), ("f", "p.B"), ("f", "q.B"), ("f", "p.C"), ("g", "p.*"))
    guessed = build.import_guesses(calls, imports)
    edges, still = build.guessed_edges(guessed)
    assert rows(edges, "file", "receiver", "callee", "kind") == {("f", "A", "p.A#m()", "G")} and rows(still, "file", "receiver") == {("f", "B"), ("f", "C"), ("g", "A")}
    over = build.override_index(table(spark, "key string, overridden array<string>", ("b.B#m()", ["a.A#m()", "a.I#m()"])))
    assert rows(over) == {("a.A#m()", "m()", "b.B#m()"), ("a.I#m()", "m()", "b.B#m()")}
    types = spark.createDataFrame([("A", ["L"], [("L", "M")]), ("B", ["A"], [])], "type string, supers array<string>, binary array<struct<t string, sup string>>")
    assert rows(build.type_adjacency(types)) == {("A", "L", False), ("L", "M", False), ("B", "A", True)}
    guards = table(spark, "file string, guard int, pos int, op string, subject string, text string, values array<string>", ("f", 1, 1, "NE", "s", "b", ["y"]), ("f", 1, 0, "EQ", "s", "a", ["x"]))
    on = build.guards_of(table(spark, "edge_id long, file string, guard int", (1, "f", 1), (2, "f", None), (3, "g", 1)), guards).collect()
    assert [(r.edge_id, [a.text for a in r.atoms]) for r in on] == [(1, ["a", "b"])]
    assert rows(build.functional_callees(table(spark, "key string", ("a",), ("b",)), table(spark, "key string", ("a",), ("a",)))) == {("a", True), ("b", False)}
    assert rows(build.duplicate_types(table(spark, "type string, path string", ("T", "b"), ("T", "a"), ("T", "a"), ("S", "a")))) == {("T", 2, ("a", "b"))}
    both = build.stores([(table(spark, "file string, x int", ("f", 1)), ""), (table(spark, "file string, x int", ("f", 2)), "other/")])
    assert rows(both) == {("f", 1), ("other/f", 2)}
    access = table(spark, "file string, line int, caller string, owner string, field string, access string", ("f", 1, "m", "T", "x", "read"), ("f", 2, "m", "T", "y", "read"))
    assert rows(build.field_accesses(access, "T", "x")) == {("f", 1, "m", "read")}
    assert rows(build.file_totals(table(spark, "file string, errors int, syntax_errors int", ("a", 2, 1), ("b", 0, 0)), table(spark, "file string", ("a",)))) == {(2, 2, 1, 1, 1)}


def test_facts_from_facts(spark):
    up = table(spark, "sub string, sup string, depth long", ("B", "A", 1), ("C", "B", 1), ("C", "A", 2), ("C", "I", 1))
    decls = table(spark, "type string, sig string, has_body boolean, mods array<string>, pkg string", ("A", "m()", True, [], "p"), ("B", "m()", True, ["public"], "p"), ("C", "m()", True, ["public"], "q"), ("A", "s()", True, ["static"], "p"), ("B", "s()", True, ["static"], "p"),
                  ("I", "t()", False, ["public"], "p"), ("A", "t()", True, ["public"], "p"))
    assert rows(build.override_facts(up, decls)) == {("B", "m()", "A"), ("C", "m()", "B")}
    chain = table(spark, "type string, pos long, ancestor string", ("C", 0, "C"), ("C", 1, "B"), ("C", 2, "A"))
    faces = table(spark, "type string, interface string, rank long", ("C", "I", 1))
    assert rows(build.inherited_implementations(chain, faces, decls)) == {("C", "I", "t()", "A")}
    ctors = table(spark, "type string, sig string, delegates boolean", ("A", "<init>(int)", False), ("A", "<init>()", True))
    sites = table(spark, "edge_id long, type string, static boolean", (1, "A", True), (2, "A", False), (3, "B", False))
    assert rows(build.initializer_callers(sites, ctors), "edge_id", "caller") == {(1, "<clinit>()"), (2, "<init>(int)"), (3, "<init>()")}
    loops = table(spark, "loop long, type string, is_array boolean", (1, "a.L", False), (2, "x", True))
    assert rows(build.implicit_iterations(loops), "pos", "callee") == {(0, "a.L#iterator()"), (1, "java.util.Iterator#hasNext()"), (2, "java.util.Iterator#next()")}
    assert rows(build.implicit_closes(table(spark, "stmt long, ord int, type string", (1, 0, "A"), (1, 1, "B")))) == {(1, 0, "B#close()"), (1, 1, "A#close()")}
    kinds = spark.createDataFrame([("P", "C", ["public"], None), ("Q", "C", [], None), ("R", "R", ["public"], [("x", "int"), ("y", "int")]), ("E", "E", [], None)], "type string, kind string, mods array<string>, components array<struct<name string, type string>>")
    declared = table(spark, "type string, sig string", ("Q", "<init>(int)"), ("R", "x()"))
    assert rows(build.implicit_members(kinds, declared), "type", "sig") == {("P", "<init>()"), ("R", "<init>(int,int)"), ("R", "y()"), ("E", "values()"), ("E", "valueOf(java.lang.String)")}
    keys = build.functional_keys(table(spark, "impl long, type string, sig string", (1, "C", "t()")), up, decls)
    assert rows(keys) == {(1, "C#t()"), (1, "I#t()")}
    refs = table(spark, "lib string, type string, sig string", ("l", "A", "m()"), ("l", "C", "s()"), ("l", "A", "<init>()"), ("l", "Z", "m()"), ("l", "A", "gone()"))
    linked = table(spark, "type string, sig string, decl string", ("C", "s()", "B"), ("A", "m()", "A"))
    own = table(spark, "type string", ("A",), ("C",))
    assert rows(build.external_references(refs, linked, decls.select("type", "sig"), own)) == {("l", "A", "m()", "EXACT", "A"), ("l", "C", "s()", "INHERITED", "B"), ("l", "A", "<init>()", "MISSING_NOARG_CTOR", None)}


# --- walks ----------------------------------------------------------------------------------------------------------------------


def walked(spark, edges, targets, flags=(), roots=(1,), **more):
    e = table(spark, "edge_id long, caller long, ord long", *edges)
    t = table(spark, "edge_id long, label string, callee long", *targets)
    step_args = {k: more.pop(k) for k in ("pruned", "callbacks", "expand", "listed") if k in more}
    m = table(spark, "method long, hidden boolean, silent boolean", *flags)
    return walk.walk(walk.steps(e, t, **step_args), table(spark, "node long", *[(r,) for r in roots]), m, **more)


def test_walk_hides_and_silences(spark):
    edges = [(i, a, i) for i, (a, _) in enumerate([(1, 2), (2, 3), (3, 4), (1, 5), (5, 6), (4, 2)])]
    targets = [(i, "X", b) for i, (_, b) in enumerate([(1, 2), (2, 3), (3, 4), (1, 5), (5, 6), (4, 2)])]
    got = walked(spark, edges, targets, [(3, True, False), (5, False, True)])
    assert rows(got, "path", "depth", "cycle") == {((1, 2), 1, False), ((1, 2, 4), 2, False), ((1, 2, 4, 2), 3, True), ((1, 5, 6), 2, False)}
    assert [r.path for r in got.orderBy("order").collect()] == [[1, 2], [1, 2, 4], [1, 2, 4, 2], [1, 5, 6]]
    assert rows(walked(spark, edges, targets, max_depth=2), "path", "at_depth") == {((1, 2), False), ((1, 2, 3), True), ((1, 5), False), ((1, 5, 6), False)}
    assert [r.path for r in walked(spark, edges, targets, max_rows=3).collect()] == [[1, 2], [1, 2, 3], [1, 2, 3, 4]]
    # a cycle through a hidden method ends
    loop = walked(spark, [(0, 1, 0), (1, 2, 0), (2, 3, 0)], [(0, "X", 2), (1, "X", 3), (2, "X", 2)], [(2, True, False), (3, True, False)])
    assert loop.count() == 0


def test_walk_fans_out_and_prunes(spark):
    edges = [(0, 1, 0), (1, 2, 0), (2, 12, 0), (3, 1, 1), (4, 20, 0), (5, 1, 2)]
    targets = [(0, "CHA", x) for x in (10, 11, 12, 13)] + [(1, "X", 3), (2, "X", 4), (3, "CHA", 20), (3, "CHA", 21), (4, "X", 22), (5, "X", 2)]
    got = walked(spark, edges, targets, listed=3, pruned=table(spark, "edge_id long, reason string", (5, "[UNREACHABLE] x")))
    assert rows(got, "path", "n", "unreachable") == {((1, 10), 4, None), ((1, 11), 4, None), ((1, 12), 4, None), ((1, 20), 2, None), ((1, 21), 2, None), ((1, 20, 22), 1, None), ((1, 2), 1, "[UNREACHABLE] x")}
    back = walked(spark, [(0, 1, 0), (1, 9, 0)], [(0, "NO_IMPL", 2), (1, "X", 8)], callbacks=table(spark, "edge_id long, caller long, callee long", (0, 1, 9)))
    assert rows(back, "path", "label") == {((1, 2), "NO_IMPL"), ((1, 9), "CALLBACK"), ((1, 9, 8), "X")}
    spliced = walk.collapse_lambdas(table(spark, "caller long, callee long", (1, 5), (5, 6), (5, 7), (2, 1)), table(spark, "node long", (5,)))
    assert rows(spliced) == {(1, 6), (1, 7), (2, 1)}


def test_walk_against_plain_enumeration(spark):
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(20)})
    want = set()

    def go(path):
        for a, b in pairs:
            if a == path[-1] and len(path) <= 4:
                want.add((tuple(path) + (b,), b in path))
                if b not in path:
                    go(path + [b])

    go([0])
    got = walked(spark, [(i, a, i) for i, (a, _) in enumerate(pairs)], [(i, "X", b) for i, (_, b) in enumerate(pairs)], roots=(0,), max_depth=4)
    assert rows(got, "path", "cycle") == want


def test_notes_entries_and_orders(spark):
    steps = [("[UNREACHABLE] x", True, "CHA", 2, True, False, "P", False, 0), (None, True, "X", 1, True, False, "P", False, 0), (None, False, "EXTERNAL_GUESS", 1, False, False, "P", False, 0), (None, False, "CHA", 30, True, True, "F", False, 2),
             (None, False, "NO_IMPL", 0, True, False, "P", False, 0), (None, False, "NO_IMPL", 0, True, False, "P", True, 0), (None, False, "DATAFLOW_LAMBDA", 1, True, False, "P", True, 0), (None, False, "GENERATED_IMPL:doma", 0, False, False, "P", False, 0), (None, False, "REFLECTION", 2, True, False, "P", False, 0),
             (None, False, "CALLBACK", 1, True, False, "P", False, 0), (None, False, "STATIC_BOUND:CTOR", 1, True, False, "T", False, 0)]
    df = table(spark, "i int, unreachable string, cycle boolean, label string, n int, src boolean, deep boolean, recv string, fun boolean, excl int", *[(i, *s) for i, s in enumerate(steps)])
    c = F.col
    got = {r.i: r.note for r in df.select("i", walk.note(c("cycle"), c("unreachable"), c("label"), c("n"), c("src"), c("deep"), c("recv"), c("fun"), c("excl")).alias("note")).collect()}
    assert got == {
        0: "[UNREACHABLE] x / [CANDIDATE:CHA] 2 candidates: parameter (passed in from outside the method)", 1: walk.CYCLE, 2: "[EXTERNAL] type guessed from an import (unverified)",
        3: "[UNEXPANDED:DEPTH] depth limit (50) reached / [UNEXPANDED:CHA] 30 candidates: field (only the first 20 are written as rows) (2 excluded by exclude.packages and not written as rows)",
        4: walk.NO_IMPL, 5: walk.LAMBDA + " (which one runs is undetermined)", 6: "", 7: "[EXTERNAL] no source to follow / " + walk.GENERATED + "doma)",
        8: "[CANDIDATE:REFLECTION] 2 candidates: matched by name because argument types are unknown", 9: "[RESOLVED:CALLBACK]", 10: "",
    }
    why = {r.i: r.w for r in df.select("i", walk.unresolved_cause(c("label"), c("n"), c("fun"), c("recv")).alias("w")).collect()}
    assert why[3] == "[UNEXPANDED:CHA] field" and why[4] == walk.NO_IMPL and why[5] == walk.LAMBDA and why[10] is None
    methods = table(spark, "method string, has_body boolean, is_lambda boolean, in_source boolean", ("a.A#m", True, False, True), ("a.A#n", True, False, True), ("a.A#l", True, True, True), ("b.B#m", False, False, True), ("c.C#f", True, False, True), ("j.J#x", True, False, False))
    edges = table(spark, "callee string", ("a.A#n",), ("c.C#f",))
    entry = walk.select_entries(methods, edges, table(spark, "method string", ("c.C#f",)))
    assert rows(entry) == {("a.A#m", "NOT_CALLED"), ("c.C#f", "FRAMEWORK")}
    assert rows(walk.select_entries(methods, edges, edges.limit(0).withColumnRenamed("callee", "method"), F.col("method").startswith("a."))) == {("a.A#m", "PATTERN"), ("a.A#n", "PATTERN")}
    decls = table(spark, "folder string, file string, line int, ord int, key string", ("t", "a", 1, 0, "k1"), ("s", "b", 2, 0, "k2"), ("s", "a", 9, 1, "k4"), ("s", "a", 9, 0, "k3"))
    assert [r.key for r in walk.source_order(decls, table(spark, "folder string, place int", ("s", 0), ("t", 1))).collect()] == ["k3", "k4", "k2", "k1"]
    assert [r.line for r in walk.unresolved_order(table(spark, "file string, line int, ord int", ("b", 1, 0), ("a", 5, 0), ("a", 2, 0)), table(spark, "file string, rank int", ("b", 0), ("a", 1))).collect()] == [1, 2, 5]
    assert rows(walk.in_argument_order(table(spark, "node long, pos int, seq int, arg string", (1, 2, 0, "c"), (1, 0, 2, "b"), (1, 0, 1, "a")))) == {(1, ("a", "b", "c"))}
    sites = table(spark, "edge_id long, caller string, file string, line int", (1, "m", "f", 3), (2, "n", "g", 4))
    assert rows(walk.edge_sites(sites, table(spark, "edge_id long", (2,), (2,)))) == {(2, "n", "g", 4)}


def test_tree_filters(spark):
    tree = spark.createDataFrame([(["r", "a"], 1, "p.A#x", "src/A.java", False), (["r", "a", "b"], 2, "p.B#find", "src/B.java", False), (["r", "t"], 1, "p.T#y", "src/test/T.java", False), (["r", "t", "c"], 2, "p.C#find", "src/C.java", False), (["r", "g"], 1, "p.G#z", None, True)],
                                 "path array<string>, depth int, key string, file string, guessed boolean")

    def keys(**more):
        return [r.key for r in walk.tree_filters(tree, **more).collect()]

    assert keys() == ["p.A#x", "p.B#find", "p.G#z", "p.T#y", "p.C#find"]
    assert keys(tests=False) == ["p.A#x", "p.B#find", "p.G#z"] and keys(guessed=False, depth=1) == ["p.A#x", "p.T#y"]
    assert keys(text="FIND", tests=False) == ["p.A#x", "p.B#find"] and keys(exclude=F.col("key").startswith("p.A")) == ["p.G#z", "p.T#y", "p.C#find"] and keys(most=1) == ["p.A#x"]


# --- conditions, names, report forms ------------------------------------------------------------------------------------------------


def test_conditions(spark):
    assert conditions.parse_target("a.b.Outer.Inner#m") == ("a/b/Outer.java", None, "m") and conditions.parse_target("src\\X.java:12") == ("src/X.java", 12, None)
    sites = table(spark, "file string, line int, caller_method string", ("src/a/X.java", 3, "m"), ("src/a/X.java", 4, "n"), ("src/b/XX.java", 3, "m"))
    assert conditions.matching_sites(sites, "a.X#n").count() == 1 and conditions.matching_sites(sites, "X.java:3").count() == 1 and conditions.matching_sites(sites, "X.java").count() == 2
    calls = table(spark, "edge_id long", (1,), (2,), (3,))
    atoms = table(spark, "edge_id long, pos int, op string, subject_kind string, text string, values array<string>", (1, 1, "EQ", "A", "x  ==\n1", ["1"]), (1, 2, "NI", "V", "outer, y", ["a", "b"]), (2, 1, "UK", "", "?", []))
    got = conditions.conditions(calls, atoms)
    assert rows(got) == {(1, 1, True, "outer, y", "V", "∉ {a, b}"), (1, 2, True, "x == 1", "A", "= 1"), (2, 1, False, "?", "", ""), (3, None, None, None, None, None)}
    assert rows(conditions.condition_states(got)) == {(1, "decidable"), (2, "undecidable"), (3, "none")}
    at = table(spark, "edge_id long, file string, line int, caller string, callee string", (1, "f", 7, "a", "b"), (3, "f", 8, "a", "c"))
    assert rows(conditions.report_lines(at, got)) == {('f,7,a,b,1,1,"outer, y",V,"∉ {a, b}"',), ("f,7,a,b,2,1,x == 1,A,= 1",), ("f,8,a,c,,,,,",)}
    guards = table(spark, "edge_id long, op string, text string, values array<string>, subject_kind string, subject string", (1, "EQ", "k==A", ["A"], "A", "0"), (2, "IN", "c", ["x"], "V", "y"), (3, "NE", "d", ["x"], "V", "y"), (4, "ZZ", "e", ["x"], "V", "x"))
    assert rows(conditions.unreachable(guards), "edge_id") == {(2,)}
    env = table(spark, "ctx long, index int, tag string, value string", (1, 0, "LITERAL", "B"), (2, 0, "LITERAL", "A"), (3, 0, "TYPE", "B"))
    assert rows(conditions.unreachable(guards, env), "ctx", "edge_id") == {(1, 1), (1, 2), (2, 2), (3, 2)}


def test_names(spark):
    df = table(spark, "t string, p string, m string, a string", ("a.b.Out.In", "a.b", "<init>", "java.lang.String,int[]"), ("Top.In", "", "run", ""))
    c = F.col
    got = df.select(names.type_in_package(c("t"), c("p")), names.label(c("t"), c("p"), c("m")), names.label_with_params(c("t"), c("p"), c("m"), c("a"), F.lit(False)), names.full_signature(c("t"), c("p"), c("m"), c("a")), names.display_label(c("t"), c("p"), c("m"), c("a"), F.lit(False)),
                    names.param_count(c("a")), names.param_at(c("a"), 1), names.last_is_array(c("a"))).collect()
    assert tuple(got[0]) == ("Out.In", "Out.In.In", "Out.In.In(String,int[])", "a.b.Out.In.In(java.lang.String,int[])", "a.b.Out.In.In(String,int[])", 2, "int[]", True)
    assert tuple(got[1]) == ("Top.In", "Top.In.run", "Top.In.run()", "Top.In.run()", "Top.In.run()", 0, None, False)
    text = "a\\b\tc\nd\re\x01f\x7fg\x1fé日\U0001f600\\u00e9\\n"
    back = table(spark, "x string", (text,), ("",), ("\x01",)).select("x", names.escape_row(c("x")).alias("row"), names.unescape_row(names.escape_row(c("x"))).alias("back")).collect()
    assert all(r.x == r.back for r in back) and "\\u0001f\\u007f" in back[0].row and "\n" not in back[0].row
    odd = table(spark, "x string", ("\\q\\u00e9\\u12",)).select(names.unescape_row(c("x")).alias("x")).first().x
    assert odd == "\\qé\\u12"
    tokens = table(spark, "t array<string>", (["public", "q=x=y"],)).select(names.has_token(c("t"), "q"), names.has_token(c("t"), "pub"), names.token_value(c("t"), "q"), names.token_value(c("t"), "public"), names.only_among(c("t"), ["public", "q"]), names.only_among(c("t"), ["q"])).first()
    assert tuple(tokens) == (True, False, "x=y", "", True, False)
    more = table(spark, "x string", ("12",), ("a",), ("99999999999",)).select(names.parse_int_or(c("x"), -1)).collect()
    assert [r[0] for r in more] == [12, -1, -1]
    paths = table(spark, "x string", ("a.b.Outer.Inner",), ("a.b.Outer$In",), ("a.b",), ("X",)).select(names.type_to_path(c("x"))).collect()
    assert [r[0] for r in paths] == ["a/b/Outer.java", "a/b/Outer.java", "a/b.java", "X.java"]
    assert [names.pattern_problem(x) for x in ("*", "*.**", "a.b.**", "a.b.*", "a.**", "a.C.**x", "a.B#m*", "a.B*.C", "a.B#m")] == ["WILDCARD_ONLY", "WILDCARD_ONLY", None, None, None, None, "WILDCARD_IN_METHOD", "WILDCARD_OUTER_CLASS", None]
    methods = table(spark, "t string, m string", ("a.B", "m"), ("a.B", "n"), ("Top", "m"))
    assert rows(methods.where(names.method_glob_match(c("t"), c("m"), "a.B#m"))) == {("a.B", "m")} and rows(methods.where(names.method_glob_match(c("t"), c("m"), ".**"))) == {("Top", "m")}


def test_report_forms(spark, tmp_path):
    methods = table(spark, "node long, method string, type string, kind string, file string, line int, has_body boolean, sig string, is_lambda boolean, anonymous boolean", (1, "A.m(int,int)", "A", "C", "A.java", 3, True, "m(int,int)", False, False), (2, "A.A()", "A", "C", "A.java", 1, True, "<init>()", False, False), (3, "A.n()", "A", "C", "A.java", 9, False, "n()", False, False))
    degrees = table(spark, "node long, in_degree long, out_degree long", (1, 0, 2), (2, 1, 0), (3, 4, 0))
    roles = table(spark, "node long, role string", (1, "ENTRY_CANDIDATE"), (2, "LEAF"), (3, "LEAF"))
    got = sinks.methods_rows(methods, degrees, roles, table(spark, "node long", (1,)), table(spark, "caller long, n long, causes string", (1, 2, "x;y")), table(spark, "node long", (1,)), table(spark, "node long, cause string", (3, "CHA")))
    assert got.columns == sinks.METHOD_COLUMNS
    assert rows(sinks.csv_lines(got)) == {('"A.m(int,int)",A,C,A.java,3,1,0,2,ENTRY_CANDIDATE,1,2,x;y,1,',), ("A.n(),A,C,A.java,9,0,4,0,LEAF,0,0,,0,CHA",)}
    tree = table(spark, "depth int, key string, label string, file string, line int, reason string, recursive boolean, truncated boolean, guessed boolean, match boolean", (1, "k\t1", "l", "f", 3, "r", True, False, False, True), (2, "k2", "l", None, 4, None, False, True, False, False))
    assert rows(sinks.tree_protocol(tree)) == {("R\t1\tk\\t1\tl\tf\t3\tr\trecursive,match",), ("R\t2\tk2\tl\t\t4\t\ttruncated,nosource",)}
    assert rows(sinks.tree_export(tree), "method", "note") == {("k\t1", "recursive"), ("k2", "depth-limit")}
    notes = sinks.diagnostics([("double", table(spark, "a string, n int", ("x", 1))), ("bad", table(spark, "b string", ("y",)))])
    assert rows(notes) == {("double", "x 1"), ("bad", "y")}
    sinks.write_lines(table(spark, "line string", ("b,é",)), f"{tmp_path}/out", header="h", one_file=True, bom=True)
    part = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert part.read_bytes() == "﻿h\nb,é\n".encode()


def test_update_by_parts_equals_update_in_full(spark):
    """What is redone after a cascade, and what is kept, is what a full analysis gives."""
    old = table(spark, "path string, v int", ("f0", 1), ("f1", 1), ("f2", 1), ("f3", 1))
    new = table(spark, "path string, v int", ("f0", 2), ("f1", 2), ("f2", 1), ("f3", 1))
    deps, changed = table(spark, "path string, dep string", ("f1", "f0"), ("f3", "f2")), table(spark, "path string", ("f0",))
    stale = maintenance.stale_closure(changed, deps)
    assert rows(maintenance.replace_blocks(old, new, stale)) == rows(new)
    chain = hierarchy.closure(table(spark, "sub string, sup string", *[(f"T{i + 1}", f"T{i}") for i in range(40)]))
    assert chain.count() == 41 * 40 // 2
