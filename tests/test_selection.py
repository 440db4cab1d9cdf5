"""Selection of bodies, the cascade, rules: small programs whose results are written out."""

import pytest

from weftgraph.extension import Hint, TypeCandidateProvider, provided_types, provider_targets
from weftgraph.operators import hierarchy, resolve, rules, selection


def rows(df, *cols):
    return {tuple(r[c] for c in (cols or df.columns)) for r in df.collect()}


class Program:
    """A: class chain C3 > C2 > C1 (and java.lang.Object above), I2 > I1 interfaces; packages p and q."""

    def __init__(self, spark, classes, interfaces, decls, libraries=()):
        self.spark = spark
        self.parents = spark.createDataFrame([(a, b) for a, b in classes], "sub string, sup string")
        self.edges = spark.createDataFrame(list(classes) + list(interfaces), "sub string, sup string")
        self.decls = spark.createDataFrame([(t, s, b, m.split(), p) for t, s, b, m, p in decls], "type string, sig string, has_body boolean, mods array<string>, pkg string")
        names = {x for e in list(classes) + list(interfaces) for x in e} | {d[0] for d in decls}
        pkgs = {d[0]: d[4] for d in decls}
        self.types = spark.createDataFrame([(t, pkgs.get(t, "p")) for t in names if t not in libraries and t != "java.lang.Object"], "type string, pkg string")
        self.up = hierarchy.closure(self.edges)
        self.chain = selection.class_chain(self.parents, self.types)
        own = {b for _, b in interfaces}
        from weftgraph.operators.dispatch import superinterfaces

        self.interfaces = superinterfaces(self.up, spark.createDataFrame([(x,) for x in own] or [("none",)], "type string"))

    def chosen(self, *wanted, **more):
        w = self.spark.createDataFrame(list(wanted), "type string, callee_type string, sig string")
        return rows(selection.implementations(w, self.chain, self.interfaces, self.up, self.decls, self.types, **more), "type", "impl")


def test_class_chain(spark):
    got = rows(selection.class_chain(spark.createDataFrame([("C", "B"), ("B", "A"), ("A", "java.lang.Object"), ("X", "Y"), ("Y", "X")], "sub string, sup string"), spark.createDataFrame([("Z",)], "type string")))
    assert ("Z", 0, "Z") in got and {g for g in got if g[0] == "C"} == {("C", 0, "C"), ("C", 1, "B"), ("C", 2, "A")}
    assert {g for g in got if g[0] == "X"} == {("X", 0, "X"), ("X", 1, "Y")}


def test_nearest_body_in_the_chain(spark):
    p = Program(spark, [("C", "B"), ("B", "A")], [("B", "I"), ("J", "I"), ("C", "J")], [
        ("A", "m()", True, "public", "p"), ("B", "m()", False, "public abstract", "p"), ("I", "m()", True, "public", "p"),
        ("A", "s()", True, "static", "q"), ("I", "s()", True, "public", "p"), ("B", "x()", True, "private", "p"), ("I", "x()", True, "public", "p"),
        ("I", "d()", True, "public", "p"), ("J", "d()", True, "public", "p"), ("I", "e()", True, "public", "p"), ("J", "e()", False, "public abstract", "p"),
    ])
    assert p.chosen(("C", "A", "m()")) == {("C", "A")}  # abstract B is passed by, the class wins over the interface
    assert p.chosen(("C", "I", "s()")) == {("C", "I")}  # a static of another package is not inherited
    assert p.chosen(("C", "I", "x()"), ("B", "I", "x()")) == {("C", "I"), ("B", "B")}  # nor is a private one, but the type's own counts
    assert p.chosen(("C", "I", "d()")) == {("C", "J")}  # the most specific default
    assert p.chosen(("C", "I", "e()")) == set()  # which is abstract: nothing to run
    assert p.chosen(("C", "I", "none()")) == set()


def test_package_access(spark):
    p = Program(spark, [("D", "C"), ("C", "B"), ("B", "A")], [], [
        ("A", "m()", True, "", "p"), ("B", "m()", True, "public", "q"), ("A", "n()", True, "", "p"), ("B", "n()", True, "public", "p"), ("C", "n()", True, "public", "q"),
    ])
    assert p.chosen(("C", "A", "m()")) == {("C", "A")}  # q.B.m is another method
    assert p.chosen(("D", "A", "n()")) == {("D", "C")}  # q.C.n overrides p.B.n, which overrides p.A.n


def test_override_facts_and_lower_overriders(spark):
    p = Program(spark, [("C", "B"), ("B", "A")], [], [("A", "g(Object)", True, "public", "p"), ("B", "g(String)", True, "public", "p"), ("C", "g(String)", True, "public", "q")])
    facts = spark.createDataFrame([("A", "g(Object)", "B", "g(String)")], "of_type string, of_sig string, type string, sig string")
    assert p.chosen(("B", "A", "g(Object)"), overrides=facts) == {("B", "B")}
    assert p.chosen(("C", "A", "g(Object)"), overrides=facts) == {("C", "C")}
    inherited = spark.createDataFrame([("C", "I", "h()", "A", "g(Object)")], "type string, of_type string, of_sig string, by_type string, by_sig string")
    assert p.chosen(("C", "I", "h()"), inherited=inherited) == {("C", "A")}


def test_enum_methods_end_the_search(spark):
    p = Program(spark, [("E", "java.lang.Enum")], [("E", "I")], [("I", "ordinal()", True, "public", "p")], libraries=("java.lang.Enum",))
    assert p.chosen(("E", "I", "ordinal()")) == set()


def test_binary_classes_and_overriders(spark):
    p = Program(spark, [("C", "Lib"), ("Lib", "A"), ("D", "A")], [("C", "I")], [
        ("A", "m()", True, "public", "p"), ("D", "m()", True, "public", "p"), ("I", "d()", True, "public", "p"), ("A", "f()", True, "public final", "p"), ("A", "o()", True, "public", "p"),
    ], libraries=("Lib",))
    pairs = spark.createDataFrame([("C", "A", False), ("D", "A", False), ("C", "I", True)], "type string, impl string, interface boolean")
    binary = selection.passes_binary(pairs, p.chain, p.interfaces, p.types)
    assert rows(binary) == {("C", "A"), ("C", "I")}
    wanted = p.up.selectExpr("sub AS type", "sup AS callee_type").join(p.decls.selectExpr("type AS callee_type", "sig"), "callee_type")
    chosen = selection.implementations(wanted, p.chain, p.interfaces, p.up, p.decls, p.types)
    assert rows(selection.overriding(p.decls, p.up, chosen)) == {("A", "m()", "D")}
    free = p.decls.where("sig <> 'o()'").unionByName(p.decls.where("sig = 'o()'"))
    got = dict(((t, s), e) for t, s, e in rows(selection.dispatches_elsewhere(free, p.up, chosen, binary.limit(0), p.types)))
    assert got == {("A", "m()"): True, ("D", "m()"): False, ("I", "d()"): False, ("A", "f()"): False, ("A", "o()"): False}
    got = dict(((t, s), e) for t, s, e in rows(selection.dispatches_elsewhere(free, p.up, chosen, binary, p.types)))
    assert got["A", "o()"] and got["I", "d()"] and not got["A", "f()"]
    functional = spark.createDataFrame([("D", "m()")], "type string, sig string")
    assert ("D", "m()", True) in rows(selection.dispatches_elsewhere(free, p.up, chosen, binary.limit(0), p.types, functional))


def test_linkage_and_super(spark):
    p = Program(spark, [("C", "B"), ("B", "A")], [("C", "I")], [("A", "m()", True, "public", "p"), ("B", "m()", False, "private", "p"), ("I", "n()", False, "public", "p")])
    wanted = spark.createDataFrame([("C", "m()"), ("C", "n()"), ("C", "o()")], "type string, sig string")
    assert rows(selection.resolved_declarations(wanted, p.chain, p.interfaces, p.up, p.decls)) == {("C", "m()", "B", False), ("C", "n()", "I", False)}
    sites = spark.createDataFrame([(1, "B", "B", "m()"), (2, "B", "X", "z()")], "edge_id long, qualifier string, decl_type string, sig string")
    chosen = selection.implementations(sites.selectExpr("qualifier AS type", "decl_type AS callee_type", "sig"), p.chain, p.interfaces, p.up, p.decls, p.types)
    assert rows(selection.super_targets(sites, chosen)) == {(1, "A"), (2, "X")}
    assert rows(selection.signature_implementations(wanted, p.chain, p.interfaces, p.up, p.decls, p.types)) == {("C", "m()", "A")}


@pytest.fixture(scope="module")
def world(spark):
    """An interface Dao with two bodies, one of its methods with one, one with none."""
    p = Program(spark, [("Sub", "Mem")], [("Mem", "Dao"), ("Sql", "Dao")], [
        ("Dao", "find()", False, "public", "p"), ("Mem", "find()", True, "public", "p"), ("Sql", "find()", True, "public", "p"), ("Dao", "one()", False, "public", "p"), ("Sql", "one()", True, "public", "p"),
        ("Dao", "none()", False, "public", "p"), ("Mem", "own()", True, "public", "p"),
    ])
    wanted = p.up.selectExpr("sub AS type", "sup AS callee_type").join(p.decls.selectExpr("type AS callee_type", "sig").distinct(), "callee_type")
    own = p.types.selectExpr("type").crossJoin(p.decls.selectExpr("type AS callee_type", "sig").distinct())
    p.chosen_all = selection.implementations(wanted.unionByName(own).distinct(), p.chain, p.interfaces, p.up, p.decls, p.types)
    p.callees = p.decls.select("type", "sig")
    p.found = resolve.candidates(p.callees, p.decls, p.up, p.chosen_all)
    p.keys = resolve.candidate_keys(p.callees, p.found)
    return p


def test_candidates(world):
    keys = {(r["type"], r.sig): (r.n, r.label) for r in world.keys.collect()}
    assert keys["Dao", "find()"] == (2, "CHA") and keys["Dao", "one()"] == (1, "SINGLE_IMPL") and keys["Dao", "none()"] == (0, "NO_IMPL") and keys["Mem", "own()"] == (1, "NO_OVERRIDE")
    made = resolve.candidate_keys(world.callees, world.found, world.spark.createDataFrame([("Dao", "gen")], "type string, name string"))
    assert ("Dao", "none()", 0, "GENERATED_IMPL:gen") in rows(made)


def sites_of(spark, *given):
    base = [(i, "Dao", s, m.split(), "Dao", g) for i, (s, m, g) in enumerate(given, 1)]
    return spark.createDataFrame(base, "edge_id long, decl_type string, sig string, mods array<string>, from_type string, guessed boolean")


def test_cascade_takes_the_first_stage_that_decides(spark, world):
    s = sites_of(spark, ("find()", "public", False), ("find()", "public", False), ("find()", "public", False), ("find()", "private", False), ("one()", "public", False), ("none()", "", False),
                 ("find()", "", True), ("find()", "super", False), ("<init>", "", False), ("find()", "finalclass", False), ("find()", "", False), ("find()", "", False), ("find()", "", False))

    def d(*r):
        return spark.createDataFrame(list(r), "edge_id long, label string, target string")

    got = resolve.cascade(
        s, world.keys, supers=spark.createDataFrame([(8, "Body")], "edge_id long, target string"), local_new=d((2, "LOCAL_NEW", "Mem"), (5, "LOCAL_NEW", "Mem")), rule=d((2, "CALL_RULE", "Sql"), (3, "CALL_RULE", "Sql")),
        di=d((3, "SPRING_DI", "Mem"), (11, "SPRING_DI", "Mem")), dataflow=d((11, "DATAFLOW_NEW", "Sql"), (4, "DATAFLOW_NEW", "Sql")), lambda_=d((12, "DATAFLOW_LAMBDA", "L$1")), reflection=d((13, "REFLECTION", "X"), (13, "REFLECTION", "Y")),
    )
    by = {}
    for r in got.collect():
        by.setdefault(r.edge_id, []).append((r.label, r.n, r.target))
    assert by == {
        1: [("CHA", 2, None)], 2: [("LOCAL_NEW", 1, "Mem")], 3: [("CALL_RULE", 1, "Sql")], 4: [("STATIC_BOUND:PRIVATE", 1, "Dao")], 5: [("SINGLE_IMPL", 1, None)], 6: [("NO_IMPL", 0, "Dao")],
        7: [("EXTERNAL_GUESS", 1, "Dao")], 8: [("STATIC_BOUND:SUPER", 1, "Body")], 9: [("STATIC_BOUND:CTOR", 1, "Dao")], 10: [("NOT_OVERRIDABLE:FINAL_CLASS", 1, "Dao")], 11: [("DATAFLOW_NEW", 1, "Sql")],
        12: [("DATAFLOW_LAMBDA", 1, "L$1")], 13: by[13],
    }
    assert sorted(by[13]) == [("REFLECTION", 2, "X"), ("REFLECTION", 2, "Y")]
    assert {(r.edge_id, r.target) for r in resolve.targets(got.where("edge_id IN (1, 5)"), world.found).collect()} == {(1, "Mem"), (1, "Sql"), (5, "Sql")}
    degrees = {r.target: r.in_degree for r in resolve.in_degrees(got, world.found).collect()}
    assert degrees["Sql"] == 4 and degrees["Mem"] == 2 and degrees["Dao"] == 5
    prefix = {r.edge_id: r.resolved_by for r in resolve.with_prefix(got, spark.createDataFrame([("Dao", "one()")], "type string, sig string")).collect()}
    assert prefix[1] == "CANDIDATE:CHA" and prefix[5] == "UNEXPANDED:LAMBDA" and prefix[6] == "UNEXPANDED:NO_IMPL" and prefix[12] == "RESOLVED:DATAFLOW_LAMBDA" and prefix[7] == "RESOLVED:EXTERNAL_GUESS"
    assert {r.resolved_by for r in resolve.with_prefix(got, most=1).where("edge_id = 1").collect()} == {"UNEXPANDED:CHA"}


def test_paths_decide_anew(spark, world):
    s = sites_of(spark, ("find()", "public", False), ("find()", "public", False), ("find()", "public", False))

    def d(*r):
        return spark.createDataFrame(list(r), "edge_id long, label string, target string")

    now = resolve.cascade(s, world.keys, rule=d((3, "CALL_RULE", "Sql")))
    bounds = resolve.bound_by_type(now, world.found, spark.createDataFrame([(1, "Mem"), (2, "Dao")], "edge_id long, type string"))
    assert rows(bounds) == {(1, "DATAFLOW_DECLARED_TYPE", "Mem")}
    sites = spark.createDataFrame([(1, False), (2, True), (3, False)], "edge_id long, functional boolean")
    got = resolve.on_path(now, sites, dataflow=d((3, "DATAFLOW_NEW", "Mem"), (1, "DATAFLOW_NEW", "Sql")), lambda_=d((2, "DATAFLOW_LAMBDA", "L"), (1, "DATAFLOW_LAMBDA", "L")))
    assert rows(got, "edge_id", "label", "n", "target") == {(1, "DATAFLOW_NEW", 1, "Sql"), (2, "DATAFLOW_LAMBDA", 1, "L"), (3, "CALL_RULE", 1, "Sql")}


def test_bounds_meet_candidates_by_key(spark):
    """Calls times candidates go into no shuffle; counts hold with several bounds, own targets, calls that a bound doesn't cut or empties."""
    found = [("Dao", "m()", f"C{i}") for i in range(300)] + [("Mem", "m()", f"C{i}") for i in range(200)] + [("One", "m()", "C299"), ("Two", "m()", "C298"), ("All", "m()", "C0"), ("All", "m()", "C1"), ("Few", "m()", "X")]
    calls = [(e, "CHA", "Dao", None) for e in range(60)] + [(60, "SPRING_DI", "Dao", "C0"), (60, "SPRING_DI", "Dao", "C250"), (61, "CHA", "All", None), (62, "CHA", "Dao", None), (63, "CHA", "Dao", None), (64, "CALL_RULE", "Dao", "C0"), (65, "CHA", "Dao", None)]
    bounds = [(e, "Mem") for e in range(61)] + [(61, "Mem"), (62, "One"), (62, "Two"), (63, "Few"), (64, "Mem")]
    found, bounds = spark.createDataFrame(found, "type string, sig string, target string"), spark.createDataFrame(bounds, "edge_id long, type string")
    resolved = spark.createDataFrame([(e, n, t, "m()", x) for e, n, t, x in calls], "edge_id long, label string, type string, sig string, target string")
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    earlier = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        got = sorted((r.edge_id, r.target) for r in resolve.bound_by_type(resolved, found, bounds).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted([(e, f"C{i}") for e in range(60) for i in range(200)] + [(60, "C0"), (62, "C298"), (62, "C299")])
    assert sum(n for k, n in shuffled().items() if k not in earlier) < 60 * 200


def test_rule_lines(spark):
    lines = ["# a note", "", "Dao => Mem, Sql", "Dao#find => Mem", 'F#get("K") => Sql', "F#get(a.Kind.X) => Mem", "F#get(a.B.class) => B", "Dao => ", "F(\"K\") => X", "T#s() -> a0 : run()", "T#s() -> r : run()", "T#s() -> c* : run()", "T#s() -> z : run()",
             "@a.B", "super a.B#m(int)", "static go()", "main", "nonsense here"]
    table = rules.lines_of(spark, lines)
    kinds = {r.text: r.kind for r in rules.classified(table).collect()}
    assert kinds == {"Dao => Mem, Sql": "type", "Dao#find => Mem": "type", 'F#get("K") => Sql': "type", "F#get(a.Kind.X) => Mem": "type", "F#get(a.B.class) => B": "type", "Dao =>": "bad", 'F("K") => X': "bad",
                     "T#s() -> a0 : run()": "callback", "T#s() -> r : run()": "callback", "T#s() -> c* : run()": "callback", "T#s() -> z : run()": "bad",
                     "@a.B": "entry", "super a.B#m(int)": "entry", "static go()": "entry", "main": "entry", "nonsense here": "bad"}
    assert {(r["type"], r.method, r.key, r.key_kind, tuple(r.impls)) for r in rules.type_rules(table).collect()} == {
        ("Dao", "", "", "", ("Mem", "Sql")), ("Dao", "find", "", "", ("Mem",)), ("F", "get", "K", "L", ("Sql",)), ("F", "get", "a.Kind.X", "V", ("Mem",)), ("F", "get", "a.B", "K", ("B",))}
    assert rows(rules.callback_rules(table), "callee", "place", "index", "sig") == {("T#s()", "a", 0, "run()"), ("T#s()", "r", None, "run()"), ("T#s()", "c", -1, "run()")}
    assert rows(rules.entry_rules(table), "kind", "value", "sig") == {("@", "a.B", ""), ("super", "a.B", "m(int)"), ("static", "", "go()"), ("main", "", "")}
    assert rules.classified(rules.lines_of(spark, rules.JDK_CALLBACKS)).where("kind = 'callback'").count() == 49
    assert rules.classified(rules.lines_of(spark, rules.ENTRY_RULES)).where("kind = 'entry'").count() == 60


def test_rules_by_width_and_use(spark, world):
    table = rules.lines_of(spark, ["Dao => Mem", "Dao#find => Sql", 'F#get("K") => Mem', "Dao#gone => Sql", "Dao#one => Nothing"])
    r = rules.type_rules(table)
    sites = spark.createDataFrame([(1, "Dao", "find()"), (2, "Dao", "find()"), (3, "Dao", "one()"), (4, "Dao", "none()"), (5, "X", "find()")], "edge_id long, decl_type string, sig string")
    keys = spark.createDataFrame([(2, "F#get", 1, "Z", "L"), (2, "F#get", 2, "K", "L")], "edge_id long, owner string, pos int, key string, key_kind string")
    matched = rules.matching_type_rules(sites, r, keys)
    assert {(x.edge_id, x.row) for x in matched.collect()} == {(1, 1), (2, 2), (3, 4), (4, 0)}
    decided = rules.rule_targets(matched, sites, world.chosen_all)
    assert rows(decided, "edge_id", "target") == {(1, "Sql"), (2, "Mem")}
    assert rows(rules.usage(r, matched, decided)) == {(0, "REACHED"), (1, "APPLIED"), (2, "APPLIED"), (3, "UNUSED"), (4, "REACHED")}


def test_callbacks_entries_and_names(spark):
    r = rules.callback_rules(rules.lines_of(spark, rules.JDK_CALLBACKS))
    sites = spark.createDataFrame([(1, "a", "java.lang.Thread", "start()"), (2, "a", "java.util.Optional", "map(java.util.function.Function)"), (3, "b", "X", "y()")], "edge_id long, caller string, decl_type string, sig string")
    args = spark.createDataFrame([(1, "c", 0, "Job"), (1, "r", None, "Job"), (3, "a", 0, "Job")], "edge_id long, place string, index int, type string")
    bodies = spark.createDataFrame([("Job", "run()", "Job")], "type string, sig string, impl string")
    lambdas = spark.createDataFrame([(2, "a", 0, "a$lambda", "apply(java.lang.Object)")], "edge_id long, place string, index int, target string, sig string")
    assert rows(rules.callback_edges(sites, args, r, bodies, lambdas), "edge_id", "callee", "label") == {(1, "Job", "CALLBACK"), (2, "a$lambda", "CALLBACK")}
    methods = spark.createDataFrame([
        ("A", "main(java.lang.String[])", ["public", "static"], [], True), ("B", "main()", ["private"], [], True), ("C", "t()", [], ["org.junit.Test=x"], True), ("D", "run(java.lang.String[])", ["public"], [], True), ("E", "t()", [], ["org.junit.Test"], False),
        ("G", "handle(Req)", ["public"], [], True),
    ], "type string, sig string, mods array<string>, annotations array<string>, has_body boolean")
    supers = spark.createDataFrame([("D", "org.springframework.boot.CommandLineRunner")], "sub string, sup string")
    ties = spark.createDataFrame([("G", "handle(Req)", "org.quartz.Job", "execute(org.quartz.JobExecutionContext)")], "type string, sig string, of_type string, of_sig string")
    got = rows(rules.framework_entries(methods, supers, rules.entry_rules(rules.lines_of(spark, rules.ENTRY_RULES)), ties), "type", "reason")
    assert got == {("A", "static main(java.lang.String[])"), ("C", "@Test"), ("D", "CommandLineRunner#run(java.lang.String[])"), ("G", "Job#execute(org.quartz.JobExecutionContext)")}
    types = spark.createDataFrame([("a.X",), ("b.X",), ("a.Y",)], "type string")
    asked = spark.createDataFrame([("X",), ("Y",), ("Z",), ("q.W",)], "name string")
    assert rows(rules.full_names(asked, types)) == {("X", None, 2), ("Y", "a.Y", 1), ("Z", None, 0), ("q.W", "q.W", 1)}


def test_factory_keys_and_suggestions(spark):
    nodes = spark.createDataFrame([(1, "M", "F#get(java.lang.String,int)"), (2, "L", "K"), (3, "V", "Kind.A"), (4, "U", None), (5, "T", "X")], "node long, kind string, value string")
    args = spark.createDataFrame([(1, 1, 3), (1, 0, 2), (1, 2, 4)], "node long, pos int, arg long")
    got = rules.factory_keys(spark.createDataFrame([(9, 1), (8, 5)], "edge_id long, node long"), nodes, args)
    assert rows(got) == {(9, "F#get", 0, "K", "L"), (9, "F#get", 1, "Kind.A", "V")}
    calls = spark.createDataFrame([("r", "b", 2, ["X"]), ("r", "a", 9, ["Y", "X"]), ("r", "a", 9, ["X"]), ("s", "a", 1, ["Z"])], "rule string, file string, line int, candidates array<string>")
    assert [(r.rule, r.sites, r.example, r.candidates) for r in rules.suggestions(calls).collect()] == [("r", 2, "a:9", ["X", "Y"]), ("s", 1, "a:1", ["Z"])]


def test_providers(spark, world):
    class Mapped(TypeCandidateProvider):
        def __init__(self, by):
            self.by = by

        def candidates(self, decl_type, signature, hints):
            if signature == "boom()":
                raise RuntimeError("boom")
            return [t for h in hints for t in self.by.get(h.value, [])]

        def label(self):
            return "MAPPED"

    hints = [{"kind": "FACTORY_KEY", "value": "K"}]
    sites = spark.createDataFrame([(1, "Dao", "find()", hints), (2, "Dao", "find()", hints), (3, "Dao", "boom()", hints), (4, "Dao", "find()", [])], "edge_id long, decl_type string, sig string, hints array<struct<kind string, value string>>")
    got = provided_types(sites, [Mapped({"K": ["Ghost"]}), Mapped({"K": ["Mem", "Mem"]})])
    assert rows(got) == {(e, r, "MAPPED", t) for e in (1, 2) for r, t in ((0, "Ghost"), (1, "Mem"))}
    decided, unusable = provider_targets(got, sites, world.chosen_all)
    assert rows(decided) == {(1, "MAPPED", "Mem"), (2, "MAPPED", "Mem")} and rows(unusable) == {(0, "Ghost")}
    assert rows(provided_types(sites, [Mapped({"K": ["Mem"]})], static_bound=True)) == set()
    with pytest.raises(ValueError):
        Hint("OTHER", "x")


def test_decisions_from_values(spark, world):
    receivers = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 13)], "edge_id long, node long")
    types = spark.createDataFrame([(10, "Mem", "T"), (11, "Sub", "M"), (12, "Ghost", "T"), (13, "Sql", "O")], "node long, type string, how string")
    sites = spark.createDataFrame([(i, "Dao", "find()") for i in range(1, 5)], "edge_id long, decl_type string, sig string")
    got = resolve.dataflow_targets(receivers, types, sites, world.chosen_all)
    assert rows(got) == {(1, "DATAFLOW_NEW", "Mem"), (2, "DATAFLOW_FACTORY", "Mem"), (4, "DATAFLOW_FIELD", "Sql")}
    functions = spark.createDataFrame([(10, "Main$1", "run()", True), (11, "Dao", "find()", False), (12, "Dao", "one()", False)], "node long, type string, sig string, fixed boolean")
    functional = spark.createDataFrame([(1,), (2,), (3,)], "edge_id long")
    got = resolve.function_targets(receivers, functions, functional, world.keys, world.found)
    assert rows(got) == {(1, "DATAFLOW_LAMBDA", "Main$1"), (2, "CHA", "Mem"), (2, "CHA", "Sql"), (3, "DATAFLOW_LAMBDA", "Sql")}
    calls = spark.createDataFrame([(1, "INVOKE", "A", "m", None), (2, "INVOKE", "A", "m", "int"), (3, "NEW_INSTANCE", "A", None, None), (4, "CTOR_NEW_INSTANCE", "A", None, "int"), (5, "FOR_NAME", "A", None, None)], "edge_id long, kind string, type string, name string, params string")
    methods = spark.createDataFrame([("A", "m", "int"), ("A", "m", ""), ("A", "<init>", ""), ("A", "<init>", "int"), ("B", "m", "")], "type string, name string, params string")
    got = resolve.reflective_targets(calls, methods)
    assert rows(got) == {(1, "REFLECTION", "A", "m(int)"), (1, "REFLECTION", "A", "m()"), (2, "REFLECTION", "A", "m(int)"), (3, "REFLECTION_INIT", "A", "<init>()"), (4, "REFLECTION_INIT", "A", "<init>(int)")}
