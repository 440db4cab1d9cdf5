"""Queries on selection, the cascade, rules, staleness and values, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import dispatch, hierarchy, resolve, rules, selection, staleness, values
from weftgraph.plans import facts as f
from weftgraph.plans.facts import Fact, div, union, union_sql
from weftgraph.plans.queries import query
from weftgraph.sources.adapters import table

# --- selection ------------------------------------------------------------------------------------------------------------------

_WORLD_SQL = f"""te AS MATERIALIZED {union_sql([f.PARENTS, f.IMPLEMENTS, f.EXTENDS])}, dc AS MATERIALIZED {union_sql(f.DECLS)}, ty AS MATERIALIZED {union_sql([f.CLASSES, f.FACES])},
u0(sub, sup, depth) AS (SELECT sub, sup, CAST(1 AS BIGINT) FROM te UNION ALL SELECT u0.sub, te.sup, depth + 1 FROM u0 JOIN te ON te.sub = u0.sup WHERE depth < 30),
up AS MATERIALIZED (SELECT sub, sup, min(depth) AS depth FROM u0 GROUP BY sub, sup),
c0(type, pos, ancestor) AS (SELECT type, CAST(0 AS BIGINT), type FROM ty UNION ALL SELECT c0.type, pos + 1, p.sup FROM c0 JOIN {f.PARENTS.sql} p ON p.sub = c0.ancestor),
ch AS MATERIALIZED (SELECT * FROM c0), fa AS MATERIALIZED (SELECT sub AS type, sup AS interface, row_number() OVER (PARTITION BY sub ORDER BY depth, sup) AS rank FROM up WHERE sup LIKE 'I%')"""


def _impl_sql(wanted: str, callee: bool = True) -> str:
    closed = "NOT list_has_any(c.mods, ['public', 'protected', 'private'])" if callee else "false"
    return f"""w AS MATERIALIZED (SELECT DISTINCT w.type, w.callee_type, w.sig, coalesce({closed}, false) AS closed, c.pkg AS cpkg, o.pkg AS opkg FROM {wanted} w LEFT JOIN dc c ON c.type = w.callee_type AND c.sig = w.sig LEFT JOIN ty o ON o.type = w.type),
k1 AS (SELECT w.*, ch.pos, dc.type AS impl, dc.has_body, dc.mods, dc.pkg FROM w JOIN ch ON ch.type = w.type JOIN dc ON dc.type = ch.ancestor AND dc.sig = w.sig),
k2 AS (SELECT * FROM k1 WHERE has_body AND (pos = 0 OR NOT list_contains(mods, 'private') AND (NOT list_contains(mods, 'static') OR list_has_any(mods, ['public', 'protected']) OR pkg = opkg))
AND (NOT closed OR pkg = cpkg OR EXISTS (SELECT 1 FROM ch m JOIN dc d ON d.type = m.ancestor AND d.sig = k1.sig WHERE m.type = k1.impl AND m.pos > 0 AND d.pkg = k1.cpkg AND list_has_any(d.mods, ['public', 'protected'])
AND m.pos < coalesce((SELECT l.pos FROM ch l WHERE l.type = k1.impl AND l.ancestor = k1.callee_type), 1000)))),
i1 AS (SELECT w.type, w.callee_type, w.sig, fa.rank, dc.type AS impl, dc.has_body FROM w JOIN fa ON fa.type = w.type JOIN dc ON dc.type = fa.interface AND dc.sig = w.sig WHERE NOT closed OR dc.pkg = cpkg),
i2 AS (SELECT * FROM i1 a WHERE has_body AND NOT EXISTS (SELECT 1 FROM i1 b JOIN up ON up.sub = b.impl AND up.sup = a.impl WHERE b.type = a.type AND b.callee_type = a.callee_type AND b.sig = a.sig)),
im AS MATERIALIZED (SELECT type, callee_type, sig, impl FROM (SELECT type, callee_type, sig, impl, 0 AS wy, pos AS r FROM k2 UNION ALL SELECT type, callee_type, sig, impl, 1, rank FROM i2) QUALIFY row_number() OVER (PARTITION BY type, callee_type, sig ORDER BY wy, r) = 1)"""


class _World:
    def __init__(self, spark, d):
        self.decls, self.types = union(f.DECLS, spark, d), union([f.CLASSES, f.FACES], spark, d)
        self.parents = f.PARENTS.df(spark, d)
        self.up = hierarchy.closure(union([f.PARENTS, f.IMPLEMENTS, f.EXTENDS], spark, d))
        self.chain = selection.class_chain(self.parents, self.types)
        self.faces = dispatch.superinterfaces(self.up, f.FACES.df(spark, d))
        self.args = (self.chain, self.faces, self.up, self.decls, self.types)


_WANTED_SQL = union_sql(f.WANTED)


@query("class_chain_positions", f"WITH RECURSIVE {_WORLD_SQL} SELECT type, pos, ancestor FROM ch")
def class_chain_positions(spark, d):
    return _World(spark, d).chain


@query("body_selection", f"WITH RECURSIVE {_WORLD_SQL}, {_impl_sql(_WANTED_SQL)} SELECT type, callee_type, sig, impl FROM im")
def body_selection(spark, d):
    w = _World(spark, d)
    return selection.implementations(union(f.WANTED, spark, d), *w.args).select("type", "callee_type", "sig", "impl")


@query("signature_selection", f"WITH RECURSIVE {_WORLD_SQL}, {_impl_sql(f'(SELECT DISTINCT type, chr(0) AS callee_type, sig FROM {_WANTED_SQL} x)', False)} SELECT type, sig, impl FROM im")
def signature_selection(spark, d):
    return selection.signature_implementations(union(f.WANTED, spark, d), *_World(spark, d).args)


_ALL_SQL = "(SELECT up.sub AS type, dc.type AS callee_type, dc.sig FROM up JOIN dc ON dc.type = up.sup)"


def _all(w):
    return selection.implementations(w.up.select(F.col("sub").alias("type"), F.col("sup").alias("callee_type")).join(w.decls.select(F.col("type").alias("callee_type"), "sig"), "callee_type"), *w.args)


@query("overriding_bodies", f"WITH RECURSIVE {_WORLD_SQL}, {_impl_sql(_ALL_SQL)} SELECT DISTINCT callee_type AS type, sig, impl FROM im WHERE impl <> callee_type")
def overriding_bodies(spark, d):
    w = _World(spark, d)
    return selection.overriding(w.decls, w.up, _all(w))


_SEEN = "cast(substring(type, 2) AS BIGINT) % 7 <> 0"
_GAPS_SQL = f"""gp AS MATERIALIZED (SELECT im.type, im.callee_type, im.impl FROM im WHERE EXISTS (SELECT 1 FROM ch c WHERE c.type = im.type AND cast(substring(c.ancestor, 2) AS BIGINT) % 7 = 0 AND c.pos < coalesce((SELECT l.pos FROM ch l WHERE l.type = im.type AND l.ancestor = im.impl), 1000))
OR im.impl LIKE 'I%' AND EXISTS (SELECT 1 FROM fa WHERE fa.type = im.type AND cast(substring(fa.interface, 2) AS BIGINT) % 7 = 0))"""


@query("binary_gaps", f"WITH RECURSIVE {_WORLD_SQL}, {_impl_sql(_WANTED_SQL)}, {_GAPS_SQL} SELECT DISTINCT type, impl FROM gp")
def binary_gaps(spark, d):
    w = _World(spark, d)
    pairs = selection.implementations(union(f.WANTED, spark, d), *w.args).select("type", "impl", F.col("impl").startswith("I").alias("interface")).distinct()
    return selection.passes_binary(pairs, w.chain, w.faces, w.types.where(_SEEN))


@query("dispatches_elsewhere", f"""WITH RECURSIVE {_WORLD_SQL}, {_impl_sql(_ALL_SQL)}, el AS (SELECT DISTINCT up.sup AS type, dc.sig FROM dc JOIN up ON up.sup = dc.type LEFT JOIN im ON im.type = up.sub AND im.callee_type = dc.type AND im.sig = dc.sig WHERE im.impl IS NULL OR im.impl <> dc.type)
SELECT dc.type, dc.sig, NOT list_has_any(mods, ['static', 'private', 'final']) AND EXISTS (SELECT 1 FROM el WHERE el.type = dc.type AND el.sig = dc.sig) AS elsewhere FROM dc""")
def dispatches_elsewhere(spark, d):
    w = _World(spark, d)
    none = w.types.limit(0).select("type", F.col("type").alias("impl"))
    return selection.dispatches_elsewhere(w.decls, w.up, _all(w), none, w.types)


@query("linked_by_chain", f"""WITH RECURSIVE {_WORLD_SQL}, w AS (SELECT DISTINCT type, sig FROM {_WANTED_SQL} x), a AS (SELECT w.type, w.sig, 0 AS wy, 0 AS nb, ch.pos AS r, dc.type AS decl, has_body FROM w JOIN ch ON ch.type = w.type JOIN dc ON dc.type = ch.ancestor AND dc.sig = w.sig),
b AS (SELECT w.type, w.sig, fa.rank, dc.type AS decl, has_body FROM w JOIN fa ON fa.type = w.type JOIN dc ON dc.type = fa.interface AND dc.sig = w.sig),
s AS (SELECT * FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y JOIN up ON up.sub = y.decl AND up.sup = x.decl WHERE y.type = x.type AND y.sig = x.sig))
SELECT type, sig, decl, has_body FROM (SELECT * FROM a UNION ALL SELECT type, sig, 1, CASE WHEN has_body THEN 0 ELSE 1 END, rank, decl, has_body FROM s) QUALIFY row_number() OVER (PARTITION BY type, sig ORDER BY wy, nb, r) = 1""")
def linked_by_chain(spark, d):
    w = _World(spark, d)
    return selection.resolved_declarations(union(f.WANTED, spark, d), w.chain, w.faces, w.up, w.decls)


_SUPER = Fact("orders", {"edge_id": "o_orderkey", "qualifier": "'S' || (1 + o_orderkey % 9)", "decl_type": "'I' || (o_custkey % 25)", "sig": "'m' || (o_orderkey % 4) || '()'"}, "o_orderkey % 13 = 0")


@query("super_calls", f"WITH RECURSIVE {_WORLD_SQL}, s AS {_SUPER.sql}, {_impl_sql('(SELECT qualifier AS type, decl_type AS callee_type, sig FROM s)')} SELECT edge_id, coalesce(impl, decl_type) AS target FROM s LEFT JOIN im ON im.type = s.qualifier AND im.callee_type = s.decl_type AND im.sig = s.sig")
def super_calls(spark, d):
    w, s = _World(spark, d), _SUPER.df(spark, d)
    return selection.super_targets(s, selection.implementations(s.select(F.col("qualifier").alias("type"), F.col("decl_type").alias("callee_type"), "sig"), *w.args))


# --- the cascade ------------------------------------------------------------------------------------------------------------------

_CAND_SQL = f"""{_WORLD_SQL}, {_impl_sql("(SELECT up.sub AS type, dc.type AS callee_type, dc.sig FROM up JOIN dc ON dc.type = up.sup AND dc.type LIKE 'I%')")},
cs AS MATERIALIZED (SELECT type, sig FROM dc WHERE type LIKE 'I%'), fo AS MATERIALIZED (SELECT cs.type, cs.sig, cs.type AS target FROM cs JOIN dc USING (type, sig) WHERE has_body UNION SELECT callee_type, sig, impl FROM im),
ck AS MATERIALIZED (SELECT cs.type, cs.sig, count(target) AS n, CASE count(target) WHEN 0 THEN 'NO_IMPL' WHEN 1 THEN CASE WHEN min(target) = cs.type THEN 'NO_OVERRIDE' ELSE 'SINGLE_IMPL' END ELSE 'CHA' END AS label FROM cs LEFT JOIN fo USING (type, sig) GROUP BY cs.type, cs.sig)"""


def _candidates(spark, d):
    w = _World(spark, d)
    callees = w.decls.where("type LIKE 'I%'").select("type", "sig")
    wanted = w.up.select(F.col("sub").alias("type"), F.col("sup").alias("callee_type")).join(callees.withColumnRenamed("type", "callee_type"), "callee_type")
    found = resolve.candidates(callees, w.decls, w.up, selection.implementations(wanted, *w.args))
    return w, callees, found, resolve.candidate_keys(callees, found)


@query("candidate_rows", f"WITH RECURSIVE {_CAND_SQL} SELECT type, sig, target FROM fo")
def candidate_rows(spark, d):
    return _candidates(spark, d)[2]


@query("candidate_keys", f"WITH RECURSIVE {_CAND_SQL} SELECT type, sig, n, label FROM ck")
def candidate_keys(spark, d):
    return _candidates(spark, d)[3]


def _stage(where: str, label: str, target: str) -> Fact:
    return Fact("orders", {"edge_id": "o_orderkey", "label": f"'{label}'", "target": target}, where)


_STAGES = {
    "reflection": _stage("o_orderkey % 101 = 0", "REFLECTION", "'R' || (o_orderkey % 5)"), "lambda_": _stage("o_orderkey % 53 = 0", "DATAFLOW_LAMBDA", "'L' || (o_orderkey % 3)"),
    "local_new": _stage("o_orderkey % 5 = 0", "LOCAL_NEW", "'S' || (o_orderkey % 7)"), "rule": _stage("o_orderkey % 7 = 0", "CALL_RULE", "'S' || (o_orderkey % 11)"), "provider": _stage("o_orderkey % 11 = 0", "MAPPED", "'S1'"),
    "dataflow": _stage("o_orderkey % 29 = 0", "DATAFLOW_NEW", "'S2'"), "di": _stage("o_orderkey % 31 = 0", "SPRING_DI", "'S3'"),
}
_KIND = "CASE WHEN guessed THEN 'G' WHEN sig = '<init>' THEN 'C' WHEN list_contains(mods, 'super') THEN 'U' WHEN list_contains(mods, 'private') THEN 'P' WHEN list_contains(mods, 'static') THEN 'T' WHEN list_contains(mods, 'final') THEN 'F' WHEN list_contains(mods, 'finalclass') THEN 'L' ELSE 'V' END"
_LABEL = "CASE kind WHEN 'G' THEN 'EXTERNAL_GUESS' WHEN 'C' THEN 'STATIC_BOUND:CTOR' WHEN 'U' THEN 'STATIC_BOUND:SUPER' WHEN 'P' THEN 'STATIC_BOUND:PRIVATE' WHEN 'T' THEN 'STATIC_BOUND:STATIC' WHEN 'F' THEN 'NOT_OVERRIDABLE:FINAL_METHOD' WHEN 'L' THEN 'NOT_OVERRIDABLE:FINAL_CLASS' END"


def _stages_sql() -> str:
    ranked = [f"SELECT edge_id, {resolve.STAGES.index(n.strip('_').upper())} AS st, label, target FROM {x.sql}" + ("" if n in ("reflection", "lambda_") else " WHERE edge_id IN (SELECT edge_id FROM si WHERE kind = 'V' AND by_key = 'CHA')") for n, x in _STAGES.items()]
    return f"""{_CAND_SQL}, s0 AS (SELECT *, {_KIND} AS kind FROM {f.SITES.sql} x), si AS MATERIALIZED (SELECT s0.*, coalesce(ck.label, 'NO_IMPL') AS by_key, ck.n AS by_n FROM s0 LEFT JOIN ck ON ck.type = s0.from_type AND ck.sig = s0.sig),
sb AS (SELECT qualifier, s.edge_id FROM {_SUPER.sql} s),
al AS (SELECT edge_id, CASE kind WHEN 'G' THEN 1 ELSE 2 END AS st, {_LABEL} AS label, CASE WHEN kind = 'U' THEN 'body' || (edge_id % 4) ELSE decl_type END AS target FROM si WHERE kind <> 'V'
UNION ALL SELECT edge_id, CASE by_key WHEN 'CHA' THEN 10 ELSE 4 END, by_key, CASE WHEN by_key IN ('CHA', 'SINGLE_IMPL') THEN NULL ELSE decl_type END FROM si WHERE kind = 'V' UNION ALL {' UNION ALL '.join(ranked)}),
fi AS MATERIALIZED (SELECT al.* FROM al JOIN (SELECT edge_id, min(st) AS st FROM al GROUP BY edge_id) m USING (edge_id, st)),
rs AS MATERIALIZED (SELECT fi.edge_id, fi.label, si.from_type AS type, si.sig, fi.target, CAST(CASE WHEN fi.target IS NULL THEN si.by_n WHEN fi.label = 'NO_IMPL' THEN 0 ELSE 1 END AS BIGINT) AS n FROM fi JOIN si USING (edge_id))"""


def _resolved(spark, d):
    w, callees, found, keys = _candidates(spark, d)
    s = f.SITES.df(spark, d)
    supers = s.where(F.array_contains("mods", "super")).select("edge_id", F.concat(F.lit("body"), F.col("edge_id") % 4).alias("target"))
    return resolve.cascade(s, keys, supers=supers, **{n: x.df(spark, d) for n, x in _STAGES.items()}), found


@query("cascade_stages", f"WITH RECURSIVE {_stages_sql()} SELECT edge_id, label, n, type, sig, coalesce(target, '*') AS target FROM rs")
def cascade_stages(spark, d):
    return _resolved(spark, d)[0].select("edge_id", "label", "n", "type", "sig", F.coalesce("target", F.lit("*")).alias("target"))


@query("in_degree_rows", f"WITH RECURSIVE {_stages_sql()}, t AS (SELECT target FROM rs WHERE target IS NOT NULL UNION ALL SELECT fo.target FROM rs JOIN fo ON fo.type = rs.type AND fo.sig = rs.sig WHERE rs.target IS NULL) SELECT target, count(*) AS in_degree FROM t GROUP BY target")
def in_degree_rows(spark, d):
    return resolve.in_degrees(*_resolved(spark, d))


@query("resolved_by_prefix", f"""WITH RECURSIVE {_stages_sql()} SELECT edge_id, CASE WHEN n > 1 THEN CASE WHEN n <= 3 THEN 'CANDIDATE:' ELSE 'UNEXPANDED:' END || label WHEN label = 'DATAFLOW_LAMBDA' THEN 'RESOLVED:' || label WHEN sig = 'm1()' THEN 'UNEXPANDED:LAMBDA' WHEN label = 'NO_IMPL' THEN 'UNEXPANDED:NO_IMPL' ELSE 'RESOLVED:' || label END AS resolved_by FROM rs""")
def resolved_by_prefix(spark, d):
    resolved, _ = _resolved(spark, d)
    functional = resolved.where("sig = 'm1()'").select("type", "sig").distinct()
    return resolve.with_prefix(resolved, functional).select("edge_id", "resolved_by")


_BOUNDS = Fact("orders", {"edge_id": "o_orderkey", "type": "'I' || (5 + o_custkey % 20)"}, "o_orderkey % 3 = 0")


@query("declared_type_bounds", f"""WITH RECURSIVE {_stages_sql()}, b AS {_BOUNDS.sql}, o AS (SELECT edge_id, rs.sig, coalesce(rs.target, fo.target) AS target FROM rs LEFT JOIN fo ON rs.target IS NULL AND fo.type = rs.type AND fo.sig = rs.sig WHERE label = 'CHA' OR label LIKE 'SPRING_DI%'),
a AS (SELECT o.edge_id, o.target FROM o JOIN b USING (edge_id) JOIN fo ON fo.type = b.type AND fo.sig = o.sig AND fo.target = o.target), n AS (SELECT edge_id, count(*) AS n FROM o GROUP BY edge_id), m AS (SELECT edge_id, count(*) AS m FROM a GROUP BY edge_id)
SELECT edge_id, 'DATAFLOW_DECLARED_TYPE' AS label, target FROM a WHERE edge_id IN (SELECT edge_id FROM n JOIN m USING (edge_id) WHERE m < n)""")
def declared_type_bounds(spark, d):
    return resolve.bound_by_type(*_resolved(spark, d), _BOUNDS.df(spark, d))


# --- rules ------------------------------------------------------------------------------------------------------------------------

_LINES = ["# rules", "I1 => S1, S2", "I1#m1 => S3", "I4 => S4", 'F#get("K1") => S5', "I9#gone => S6", "bad => "]


@query("rules_by_width", f"""WITH s AS {f.SITES.sql}, r(row, type, method, impls) AS (VALUES (1, 'I1', '', 'S1,S2'), (2, 'I1', 'm1', 'S3'), (3, 'I4', '', 'S4'), (5, 'I9', 'gone', 'S6')), x AS (SELECT edge_id, 0 AS w, 4 AS row, 'S5' AS impls FROM s WHERE k = 1 UNION ALL
SELECT edge_id, CASE WHEN method = '' THEN 2 ELSE 1 END, row, impls FROM s JOIN r ON r.type = s.decl_type AND (method = '' OR method = string_split(sig, '(')[1])) SELECT edge_id, CAST(row AS BIGINT) AS row, impls FROM x QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY w, row) = 1""")
def rules_by_width(spark, d):
    s = f.SITES.df(spark, d)
    keys = s.where("k < 3").selectExpr("edge_id", "'F#get' AS owner", "0 AS pos", "'K' || k AS key", "'L' AS key_kind")
    return rules.matching_type_rules(s, rules.type_rules(rules.lines_of(spark, _LINES)), keys).withColumn("impls", F.array_join("impls", ","))


_CALLS = Fact("orders", {"edge_id": "o_orderkey", "caller": "'C' || o_custkey", "decl_type": "CASE o_orderkey % 4 WHEN 0 THEN 'java.lang.Thread' WHEN 1 THEN 'java.util.Optional' WHEN 2 THEN 'java.util.List' ELSE 'X' END",
                         "sig": "CASE o_orderkey % 4 WHEN 0 THEN 'start()' WHEN 1 THEN 'ifPresentOrElse(java.util.function.Consumer,java.lang.Runnable)' WHEN 2 THEN 'sort(java.util.Comparator)' ELSE 'y()' END"})
_GIVEN = Fact("orders", {"edge_id": "o_orderkey", "place": "CASE WHEN o_orderkey % 3 = 0 THEN 'c' ELSE 'a' END", "index": "cast(o_orderkey % 2 AS INT)", "type": "'T' || (o_custkey % 6)"})


@query("callback_rows", f"""WITH s AS {_CALLS.sql}, v AS {_GIVEN.sql}, r(callee, place, i, back) AS (VALUES ('java.lang.Thread#start()', 'c', -1, 'run()'), ('java.util.Optional#ifPresentOrElse(java.util.function.Consumer,java.lang.Runnable)', 'a', 0, 'accept(java.lang.Object)'),
('java.util.Optional#ifPresentOrElse(java.util.function.Consumer,java.lang.Runnable)', 'a', 1, 'run()'), ('java.util.List#sort(java.util.Comparator)', 'a', 0, 'compare(java.lang.Object,java.lang.Object)')), b(type, back, impl) AS (VALUES ('T1', 'run()', 'B1'), ('T2', 'run()', 'B1'), ('T3', 'accept(java.lang.Object)', 'B3'), ('T4', 'compare(java.lang.Object,java.lang.Object)', 'B4'))
SELECT DISTINCT s.edge_id, s.caller, b.impl AS callee, 'CALLBACK' AS label FROM s JOIN r ON r.callee = decl_type || '#' || sig JOIN v ON v.edge_id = s.edge_id AND v.place = r.place AND (r.i = -1 OR r.i = v.index) JOIN b ON b.type = v.type AND b.back = r.back""")
def callback_rows(spark, d):
    bodies = spark.createDataFrame([("T1", "run()", "B1"), ("T2", "run()", "B1"), ("T3", "accept(java.lang.Object)", "B3"), ("T4", "compare(java.lang.Object,java.lang.Object)", "B4")], "type string, sig string, impl string")
    return rules.callback_edges(_CALLS.df(spark, d), _GIVEN.df(spark, d), rules.callback_rules(rules.lines_of(spark, rules.JDK_CALLBACKS)), bodies).select("edge_id", "caller", "callee", "label")


_ENTRY_METHODS = Fact("part", {
    "type": "'T' || p_partkey", "sig": "CASE p_partkey % 5 WHEN 0 THEN 'main(java.lang.String[])' WHEN 1 THEN 'run(java.lang.String[])' WHEN 2 THEN 'doGet(javax.servlet.http.HttpServletRequest,javax.servlet.http.HttpServletResponse)' ELSE 'm()' END",
    "mods": "split(CASE p_partkey % 3 WHEN 0 THEN 'public static' WHEN 1 THEN 'private' ELSE 'public' END, ' ')", "annotations": "split(CASE p_partkey % 7 WHEN 0 THEN 'org.junit.Test=x' WHEN 1 THEN 'a.B' ELSE '' END, ' ')", "has_body": "p_size > 5",
})
_ENTRY_SUPERS = Fact("part", {"sub": "'T' || p_partkey", "sup": "CASE p_partkey % 2 WHEN 0 THEN 'org.springframework.boot.CommandLineRunner' ELSE 'javax.servlet.http.HttpServlet' END"}, "p_partkey % 4 < 3")


@query("framework_entry_rules", f"""WITH m AS {_ENTRY_METHODS.sql}, s AS {_ENTRY_SUPERS.sql}, x AS (SELECT type, sig, CASE WHEN list_contains(mods, 'static') THEN 'static ' ELSE '' END || sig AS reason, 0 AS r FROM m WHERE has_body AND sig = 'main(java.lang.String[])' AND NOT list_contains(mods, 'private')
UNION ALL SELECT type, sig, 'HttpServlet#' || sig, 1 FROM m JOIN s ON sub = type AND sup LIKE 'javax%' WHERE has_body AND sig LIKE 'doGet%' UNION ALL SELECT type, sig, 'CommandLineRunner#' || sig, 2 FROM m JOIN s ON sub = type AND sup LIKE 'org%' WHERE has_body AND sig LIKE 'run%'
UNION ALL SELECT type, sig, '@Test', 3 FROM m WHERE has_body AND list_contains(annotations, 'org.junit.Test=x')) SELECT type, sig, reason FROM x QUALIFY row_number() OVER (PARTITION BY type, sig ORDER BY r) = 1""")
def framework_entry_rules(spark, d):
    return rules.framework_entries(_ENTRY_METHODS.df(spark, d), _ENTRY_SUPERS.df(spark, d), rules.entry_rules(rules.lines_of(spark, rules.ENTRY_RULES))).select("type", "sig", "reason")


_NAMED = Fact("customer", {"type": f"'p' || {div('c_custkey', 10)} || '.T' || (c_custkey % 97)"})


@query("full_names", f"WITH t AS (SELECT DISTINCT type FROM {_NAMED.sql} x), k AS (SELECT string_split(type, '.')[2] AS name, count(*) AS n, min(type) AS type FROM t GROUP BY 1), a AS (SELECT 'T' || n_nationkey * 5 AS name FROM nation) SELECT name, coalesce(CASE WHEN n = 1 THEN type END, '') AS type, coalesce(n, 0) AS n FROM a LEFT JOIN k USING (name)")
def full_names(spark, d):
    asked = table(spark, d, "nation").selectExpr("'T' || n_nationkey * 5 AS name")
    return rules.full_names(asked, _NAMED.df(spark, d)).withColumn("type", F.coalesce("type", F.lit("")))


_NODES = Fact("lineitem", {"node": "l_orderkey * 10 + l_linenumber", "kind": "CASE l_linenumber % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'M' WHEN 2 THEN 'V' WHEN 3 THEN 'A' ELSE 'T' END", "value": "CASE l_linenumber % 5 WHEN 1 THEN 'F' || (l_orderkey % 7) || '(x)' WHEN 3 THEN '0' ELSE 'v' || (l_orderkey % 13) END", "recv": "cast(NULL AS BIGINT)"}, distinct=True)
_ARGS = Fact("lineitem", {"node": "l_orderkey * 10 + 1", "pos": "cast(l_linenumber AS INT)", "arg": "l_orderkey * 10 + l_linenumber"}, "l_linenumber > 1", distinct=True)


@query("factory_keys", f"WITH n AS {_NODES.sql}, a AS {_ARGS.sql} SELECT n.node AS edge_id, string_split(n.value, '(')[1] AS owner, a.pos, g.value AS key, g.kind AS key_kind FROM n JOIN a USING (node) JOIN n g ON g.node = a.arg AND g.kind IN ('L', 'V', 'K') WHERE n.kind = 'M'")
def factory_keys(spark, d):
    n = _NODES.df(spark, d)
    return rules.factory_keys(n.select(F.col("node").alias("edge_id"), "node"), n, _ARGS.df(spark, d))


@query("rule_suggestions", "SELECT 'R' || (l_partkey % 40) AS rule, count(DISTINCT (l_suppkey, l_linenumber)) AS sites, min_by(l_suppkey || ':' || l_linenumber, l_suppkey * 100 + l_linenumber) AS example, array_to_string(list_sort(list(DISTINCT 'S' || (l_orderkey % 3))), ',') AS candidates FROM lineitem GROUP BY 1")
def rule_suggestions(spark, d):
    calls = table(spark, d, "lineitem").selectExpr("'R' || (l_partkey % 40) AS rule", "l_suppkey AS file", "l_linenumber AS line", "array('S' || (l_orderkey % 3)) AS candidates")
    return rules.suggestions(calls).withColumn("candidates", F.array_join("candidates", ","))


# --- staleness --------------------------------------------------------------------------------------------------------------------

_CHANGED = Fact("supplier", {"type": "'S' || s_suppkey"}, "s_suppkey % 11 = 3")


@query("stale_types", f"WITH RECURSIVE te AS {union_sql([f.PARENTS, f.IMPLEMENTS])}, s(type) AS (SELECT type FROM {_CHANGED.sql} c UNION SELECT te.sub FROM s JOIN te ON te.sup = s.type) SELECT type FROM s")
def stale_types(spark, d):
    return staleness.stale_types(_CHANGED.df(spark, d), union([f.PARENTS, f.IMPLEMENTS], spark, d))


_UNITS = Fact("documents", {"path": "'f' || doc_id", "pkg": "CASE WHEN doc_id % 50 = 7 THEN NULL ELSE 'q' || (doc_id % 40) END"}, "doc_id IS NOT NULL")
_DEPS = Fact("documents", {"path": "'f' || doc_id", "dep": "CASE doc_id % 6 WHEN 0 THEN 'q' || (doc_id % 37) || '.*' WHEN 1 THEN 'q' || (doc_id % 41) || '.T' || (doc_id % 5) || '.In' WHEN 2 THEN 'q' || (doc_id % 43) || '.T' || (doc_id % 5) || '$In' WHEN 3 THEN 'lib.x' || (doc_id % 9) || '.C' WHEN 4 THEN 'Plain' ELSE 'q' || (doc_id % 39) || '.T' || (doc_id % 5) END"}, "doc_id % 10 <> 0")
_ST, _PK, _GONE, _TOP, _LIB = ["q3.T1", "q4.T2", "q20.T4"], ["q3", "q5"], ["q11"], ["q6"], ["lib.x2", "q13"]


def _list(xs):
    return ", ".join(f"'{x}'" for x in xs)


@query("touched_files", f"""WITH fi AS {_UNITS.sql}, dp AS {_DEPS.sql}, x AS (SELECT path, dep, dep LIKE '%.*' AS wide, regexp_replace(dep, '\\.\\*$', '') AS name FROM dp), h AS (SELECT path, wide, name, list_transform(list_filter(range(2, len(name) + 1), lambda i: name[i] IN ('.', '$')), lambda i: name[:i - 1]) AS hs, list_transform(list_filter(range(2, len(name) + 1), lambda i: name[i] = '.'), lambda i: name[:i - 1]) AS hd FROM x),
s AS (SELECT path FROM h WHERE name IN ({_list(_ST)}) OR list_has_any(hs, [{_list(_ST)}]) OR name IN ({_list(_GONE)}) OR list_has_any(hd, [{_list(_GONE)}]) OR wide AND name IN ({_list(_PK + _TOP)}) UNION SELECT path FROM fi WHERE (pkg IN ({_list(_TOP)}) OR pkg IS NULL) AND path IN (SELECT path FROM dp)),
l AS (SELECT path FROM h WHERE list_has_any(hd, [{_list(_LIB)}]) OR name IN ({_list(_LIB + ['lib'])}) UNION SELECT path FROM fi WHERE (pkg IN ({_list(_LIB)}) OR pkg IS NULL) AND path IN (SELECT path FROM dp))
SELECT path, CASE WHEN path IN (SELECT path FROM s) THEN 'BY_SOURCE' ELSE 'BY_LIBRARY' END AS reason FROM (SELECT path FROM s UNION SELECT path FROM l)""")
def touched_files(spark, d):
    def t(xs, c):
        return spark.createDataFrame([(x,) for x in xs], f"{c} string")

    return staleness.touched(_UNITS.df(spark, d), _DEPS.df(spark, d), t(_ST, "type"), t(_PK, "pkg"), t(_GONE, "pkg"), t(_TOP, "pkg"), t(_LIB, "pkg"))


_OLD_PKG, _NEW_PKG = Fact("documents", {"pkg": "source || (doc_id % 30)"}, "doc_id % 3 <> 0"), Fact("documents", {"pkg": "source || (doc_id % 31)"}, "doc_id % 4 <> 0")


@query("package_changes", f"WITH o AS (SELECT DISTINCT pkg FROM {_OLD_PKG.sql} a), n AS (SELECT DISTINCT pkg FROM {_NEW_PKG.sql} b) SELECT pkg, 'REMOVED' AS change FROM o WHERE pkg NOT IN (SELECT pkg FROM n WHERE pkg IS NOT NULL) UNION ALL SELECT pkg, 'CREATED' FROM n WHERE pkg NOT IN (SELECT pkg FROM o WHERE pkg IS NOT NULL)")
def package_changes(spark, d):
    return staleness.packages_gone_or_new(_OLD_PKG.df(spark, d), _NEW_PKG.df(spark, d))


_DECLARED = Fact("customer", {"type": "CASE c_custkey % 4 WHEN 0 THEN 'a.T' || c_custkey WHEN 1 THEN 'a.T' || c_custkey || '.In' WHEN 2 THEN 'b' || (c_custkey % 9) || '.T' || c_custkey ELSE 'T' || c_custkey END", "pkg": "CASE c_custkey % 4 WHEN 2 THEN 'b' || (c_custkey % 9) WHEN 3 THEN '' ELSE 'a' END"})


@query("new_top_level_packages", f"SELECT DISTINCT pkg FROM {_DECLARED.sql} d WHERE NOT (type LIKE 'a.T%' OR type LIKE 'b1.%') AND (pkg = '' AND type NOT LIKE '%.%' OR pkg <> '' AND starts_with(type, pkg || '.') AND substring(type, length(pkg) + 2) NOT LIKE '%.%')")
def new_top_level_packages(spark, d):
    types = _DECLARED.df(spark, d)
    return staleness.new_top_level(types, types.where("type LIKE 'a.T%' OR type LIKE 'b1.%'"))


_LINES_OF = Fact("lineitem", {"path": "'f' || l_suppkey", "line": "l_returnflag || l_linestatus || (l_partkey % 50)"})


@query("declaration_fingerprints", f"SELECT path, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT DISTINCT path, line FROM {_LINES_OF.sql} x) GROUP BY path")
def declaration_fingerprints(spark, d):
    return staleness.declaration_fingerprint(_LINES_OF.df(spark, d))


@query("reanalysis_reasons", f"WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'BY_LIBRARY' ELSE 'BY_SOURCE' END AS reason FROM documents) SELECT reason, count(DISTINCT doc_id) AS n FROM x GROUP BY reason")
def reanalysis_reasons(spark, d):
    return staleness.reason_counts(table(spark, d, "documents").selectExpr("doc_id AS path", "CASE WHEN doc_id % 3 = 0 THEN 'BY_LIBRARY' ELSE 'BY_SOURCE' END AS reason"))


_LIBS = Fact("supplier", {"lib": "'l' || s_suppkey", "ord": "s_suppkey", "pkg": "'p' || s_nationkey"})
_LIBS_NEW = Fact("supplier", {"lib": "'l' || s_suppkey", "ord": "CASE WHEN s_nationkey % 3 = 0 THEN -s_suppkey ELSE s_suppkey END", "pkg": "'p' || s_nationkey"}, "s_suppkey % 7 <> 0")


@query("reordered_libraries", "SELECT 'p' || s_nationkey AS pkg FROM supplier WHERE s_suppkey % 7 <> 0 AND s_nationkey % 3 = 0 GROUP BY 1 HAVING count(*) > 1")
def reordered_libraries(spark, d):
    return staleness.reordered_packages(_LIBS.df(spark, d), _LIBS_NEW.df(spark, d))


_SNAP = Fact("documents", {"path": "'f' || doc_id", "size": "n_chars", "hash": "lang"}, "doc_id % 9 <> 0")
_SNAP2 = Fact("documents", {"path": "'f' || doc_id", "size": "n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END", "hash": "lang"}, "doc_id % 8 <> 0")


@query("moved_while_read", f"SELECT coalesce(a.path, b.path) AS path, coalesce(CASE WHEN a.size = b.size AND a.hash = b.hash THEN a.hash END, '') AS hash FROM {_SNAP.sql} a FULL JOIN {_SNAP2.sql} b ON a.path = b.path")
def moved_while_read(spark, d):
    return staleness.moved_while_read(_SNAP.df(spark, d), _SNAP2.df(spark, d)).withColumn("hash", F.coalesce("hash", F.lit("")))


# --- values -----------------------------------------------------------------------------------------------------------------------

_FOLDED_SQL = "fo(method, kind, value) AS (VALUES ('F0(x)', 'T', 'X0'), ('F1(x)', 'A', '5'), ('F2(x)', 'A', '4'), ('F3(x)', 'L', 'lit'), ('F4(x)', 'T', 'X4'))"


def _folded(spark):
    return spark.createDataFrame([("F0(x)", "T", "X0"), ("F1(x)", "A", "5"), ("F2(x)", "A", "4"), ("F3(x)", "L", "lit"), ("F4(x)", "T", "X4")], "method string, kind string, value string")


@query("value_types", f"""WITH n AS {_NODES.sql}, a AS {_ARGS.sql}, {_FOLDED_SQL}, t AS (SELECT node, value AS type, 'T' AS how FROM n WHERE kind = 'T' UNION ALL SELECT node, fo.value, 'M' FROM n JOIN fo ON fo.method = n.value AND fo.kind = 'T' WHERE n.kind = 'M')
SELECT * FROM t UNION ALL SELECT n.node, t.type, 'M' FROM n JOIN fo ON fo.method = n.value AND fo.kind = 'A' JOIN a ON a.node = n.node AND CAST(a.pos AS VARCHAR) = fo.value JOIN t ON t.node = a.arg WHERE n.kind = 'M'""")
def value_types(spark, d):
    empty = spark.createDataFrame([], "field string, kind string, value string")
    return values.concrete_types(_NODES.df(spark, d), _ARGS.df(spark, d), _folded(spark), empty, spark.createDataFrame([], "type string"))


@query("known_values", f"""WITH n AS {_NODES.sql}, a AS {_ARGS.sql}, {_FOLDED_SQL}, t AS (SELECT node, CASE kind WHEN 'L' THEN 'LITERAL' ELSE 'CONST' END AS tag, value FROM n WHERE kind IN ('L', 'V') UNION ALL SELECT node, 'LITERAL', fo.value FROM n JOIN fo ON fo.method = n.value AND fo.kind = 'L' WHERE n.kind = 'M')
SELECT * FROM t UNION ALL SELECT n.node, t.tag, t.value FROM n JOIN fo ON fo.method = n.value AND fo.kind = 'A' JOIN a ON a.node = n.node AND CAST(a.pos AS VARCHAR) = fo.value JOIN t ON t.node = a.arg WHERE n.kind = 'M'""")
def known_values(spark, d):
    return values.evaluate(_NODES.df(spark, d), _ARGS.df(spark, d), _folded(spark))


_ENV = Fact("lineitem", {"ctx": "l_orderkey", "index": "0", "tag": "CASE WHEN l_orderkey % 2 = 0 THEN 'TYPE' ELSE 'LITERAL' END", "value": "'e' || (l_orderkey % 5)"}, "l_linenumber = 1", distinct=True)


@query("bound_arguments", f"""WITH n AS {_NODES.sql}, a AS {_ARGS.sql}, e AS {_ENV.sql}, c AS (SELECT DISTINCT ctx, ctx * 10 + 1 AS node FROM e) SELECT c.ctx, c.node AS edge_id, a.pos AS index, CASE n.kind WHEN 'T' THEN 'TYPE' WHEN 'L' THEN 'LITERAL' WHEN 'V' THEN 'CONST' WHEN 'A' THEN e.tag END AS tag,
CASE n.kind WHEN 'A' THEN e.value ELSE n.value END AS value FROM c JOIN a USING (node) JOIN n ON n.node = a.arg LEFT JOIN e ON e.ctx = c.ctx WHERE n.kind <> 'M'""")
def bound_arguments(spark, d):
    n, env = _NODES.df(spark, d), _ENV.df(spark, d)
    calls = env.selectExpr("ctx", "ctx * 10 + 1 AS edge_id", "ctx * 10 + 1 AS args_node").distinct()
    return values.bind_arguments(calls, _ARGS.df(spark, d), n, n.where("kind = 'T'").select("node", F.col("value").alias("type")), env)


@query("parameter_users", f"WITH n AS {_NODES.sql}, a AS {_ARGS.sql} SELECT DISTINCT CAST(a.node AS VARCHAR) AS caller FROM a JOIN n ON n.node = a.arg AND n.kind = 'A'")
def parameter_users(spark, d):
    a = _ARGS.df(spark, d)
    calls = a.select(F.col("node").cast("string").alias("caller"), F.lit(None).cast("long").alias("recv"), F.col("node").alias("args_node")).distinct()
    return values.uses(_NODES.df(spark, d), a, calls)


_FIELDS = Fact("part", {"field": "'C' || (p_partkey % 60) || '#f' || (p_partkey % 9)", "type": "'C' || (p_partkey % 60)", "mods": "split(CASE (p_partkey % 9) % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'final' WHEN 2 THEN 'private static' ELSE 'public' END, ' ')", "framework": "p_partkey % 9 = 8"}, distinct=True)
_ASSIGNS = Fact("part", {"field": "'C' || (p_partkey % 60) || '#f' || (p_partkey % 9)", "site": "CASE p_size % 5 WHEN 0 THEN '<field>' WHEN 1 THEN 'c1' WHEN 2 THEN 'c2' WHEN 3 THEN 'c1' ELSE CASE WHEN p_size % 10 = 9 THEN '?' ELSE 'c2' END END", "kind": "CASE WHEN p_partkey % 13 = 0 THEN 'U' WHEN p_partkey % 9 = 1 THEN 'A' ELSE 'T' END", "value": "'v' || (p_partkey % 9)"})
_CTORS = [Fact("part", {"type": "'C' || (p_partkey % 60)", "sig": f"'c{k}'"}, distinct=True) for k in (1, 2)]


@query("field_must_values", f"""WITH fd AS {_FIELDS.sql}, a AS {_ASSIGNS.sql}, o AS (SELECT field, type FROM fd WHERE NOT framework AND NOT list_contains(mods, 'static') AND list_has_any(mods, ['private', 'final']))
SELECT field, min(kind) AS kind, min(value) AS value FROM a JOIN o USING (field) GROUP BY field, type HAVING bool_and(site <> '?') AND (bool_or(site = '<field>') OR count(DISTINCT site) >= 2) AND bool_and(kind <> 'U') AND min(kind || value) = max(kind || value) AND (min(kind) <> 'A' OR type NOT IN ('C1', 'C2', 'C3', 'C10'))""")
def field_must_values(spark, d):
    chained = spark.createDataFrame([("C1",), ("C2",), ("C3",), ("C10",)], "type string")
    return values.field_values(_FIELDS.df(spark, d), _ASSIGNS.df(spark, d), union(_CTORS, spark, d), chained)


@query("fields_with_own_values", f"WITH fd AS {_FIELDS.sql}, a AS {_ASSIGNS.sql} SELECT DISTINCT field FROM fd WHERE NOT list_contains(mods, 'static') AND (field IN (SELECT field FROM a WHERE kind <> 'A') OR field LIKE '%#f1' AND type IN ('C1', 'C19'))")
def fields_with_own_values(spark, d):
    foreign = _FIELDS.df(spark, d).where("field LIKE '%#f1' AND type IN ('C1', 'C19')").select("field", F.lit("T").alias("kind"))
    return values.own_valued(_FIELDS.df(spark, d), _ASSIGNS.df(spark, d), foreign)


_RET = Fact("lineitem", {"method": "'m' || (l_partkey % 300)", "node": "l_orderkey * 10 + l_linenumber + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END"})


@query("method_returns", f"SELECT DISTINCT method, coalesce(kind, 'U') AS kind, coalesce(value, '') AS value FROM {_RET.sql} r LEFT JOIN {_NODES.sql} n USING (node)")
def method_returns(spark, d):
    return values.returns_of(_RET.df(spark, d), _NODES.df(spark, d)).withColumn("value", F.coalesce("value", F.lit("")))


_REFLECT = Fact("part", {"method": "CASE p_partkey % 5 WHEN 0 THEN 'java.lang.Class#forName(java.lang.String)' WHEN 1 THEN 'java.lang.Class#newInstance()' WHEN 2 THEN 'java.lang.reflect.Method#invoke(java.lang.Object,java.lang.Object[])' WHEN 3 THEN 'java.lang.reflect.Constructor#newInstance(java.lang.Object[])' ELSE 'a.B#c' || p_partkey || '()' END"})


@query("reflection_calls", f"SELECT method, CASE WHEN method LIKE '%forName(%' THEN 'FOR_NAME' WHEN method LIKE '%Method#invoke%' THEN 'INVOKE' WHEN method LIKE '%Constructor#%' THEN 'CTOR_NEW_INSTANCE' ELSE 'NEW_INSTANCE' END AS kind FROM {_REFLECT.sql} x WHERE method LIKE 'java%'")
def reflection_calls(spark, d):
    return values.reflection_kinds(_REFLECT.df(spark, d))


_SHARE = Fact("lineitem", {"file": "'f' || l_suppkey", "node": "l_orderkey * 10 + l_linenumber", "kind": "l_returnflag", "value": "'v' || (l_partkey % 5)", "recv": "cast(NULL AS BIGINT)"}, distinct=True)


@query("shared_value_nodes", f"SELECT file, node, min(node) OVER (PARTITION BY file, kind, value) AS shared FROM {_SHARE.sql} x")
def shared_value_nodes(spark, d):
    return values.shared_nodes(_SHARE.df(spark, d), spark.createDataFrame([], "file string, node long, pos int, arg long"))


@query("narrowest_bounds", f"WITH RECURSIVE te AS {union_sql([f.PARENTS, f.IMPLEMENTS, f.EXTENDS])}, u(sub, sup) AS (SELECT sub, sup FROM te UNION SELECT u.sub, te.sup FROM u JOIN te ON te.sub = u.sup), b AS (SELECT DISTINCT l_orderkey AS node, CASE WHEN l_linenumber % 2 = 0 THEN 'S' || l_suppkey ELSE 'I' || (l_suppkey % 25) END AS type FROM lineitem) SELECT node, min(type) AS type FROM b WHERE NOT EXISTS (SELECT 1 FROM b x JOIN u ON u.sub = x.type AND u.sup = b.type WHERE x.node = b.node) GROUP BY node")
def narrowest_bounds(spark, d):
    b = table(spark, d, "lineitem").selectExpr("l_orderkey AS node", "CASE WHEN l_linenumber % 2 = 0 THEN 'S' || l_suppkey ELSE 'I' || (l_suppkey % 25) END AS type").distinct()
    return values.narrower(b, hierarchy.closure(union([f.PARENTS, f.IMPLEMENTS, f.EXTENDS], spark, d)))
