"""Queries over the driver's tables by name, each with the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import names
from weftgraph.operators import dispatch, graph, hierarchy, maintenance
from weftgraph.sources import adapters as ad
from weftgraph.sources.adapters import ALL_CALLS_SQL, CLOSURE_SQL, DECLS_SQL, EDGES_SQL, SITES_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("caller").alias("node")).unionByName(e.select(F.col("callee").alias("node"))).distinct()


_NODES_SQL = "v AS (SELECT caller AS node FROM e UNION SELECT callee FROM e)"
_DEG_TAIL = "d AS (SELECT node, (SELECT count(*) FROM e WHERE callee = node) AS in_degree, (SELECT count(*) FROM e WHERE caller = node) AS out_degree FROM v)"
_DEG_SQL = f"WITH {EDGES_SQL}, {_NODES_SQL}, {_DEG_TAIL}"
_ALL_DEG_SQL = f"WITH {ALL_CALLS_SQL}, {_NODES_SQL}, {_DEG_TAIL}"


def _paths_sql(depth: int, tail: str) -> str:
    return f"""WITH RECURSIVE {EDGES_SQL},
p(path, depth, note) AS (SELECT [caller, callee], CAST(1 AS BIGINT), CASE WHEN caller = callee THEN 'CYCLE' ELSE '' END FROM e
UNION ALL SELECT list_append(path, callee), depth + 1, CASE WHEN list_contains(path, callee) THEN 'CYCLE' WHEN depth + 1 = {depth} AND callee IN (SELECT caller FROM e) THEN 'DEPTH' ELSE '' END
FROM p JOIN e ON caller = path[-1] WHERE note = '' AND depth < {depth})
{tail}"""


def _all_paths(spark, d, depth):
    e = ad.call_edges(spark, d)
    return graph.paths(e, e.select(F.col("caller").alias("node")).distinct(), depth)


@query("path_enumeration", _paths_sql(4, "SELECT array_to_string(path, '>') AS path, depth, note FROM p"))
def path_enumeration(spark, d):
    return _all_paths(spark, d, 4).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth", "note")


@query("cycle_notes", _paths_sql(3, "SELECT path[-1] AS node, count(*) AS n FROM p WHERE note = 'CYCLE' GROUP BY 1"))
def cycle_notes(spark, d):
    return _all_paths(spark, d, 3).where("note = 'CYCLE'").groupBy(F.element_at("path", -1).alias("node")).agg(F.count("*").alias("n"))


@query("depth_limit_notes", _paths_sql(3, "SELECT path[1] AS root, count(*) AS n FROM p WHERE note = 'DEPTH' GROUP BY 1"))
def depth_limit_notes(spark, d):
    return _all_paths(spark, d, 3).where("note = 'DEPTH'").groupBy(F.element_at("path", 1).alias("root")).agg(F.count("*").alias("n"))


def _tree_sql(up: bool) -> str:
    edges = "SELECT callee AS caller, caller AS callee FROM e" if up else "SELECT caller, callee FROM e"
    return f"""WITH RECURSIVE {ALL_CALLS_SQL}, t AS MATERIALIZED ({edges}),
m AS (SELECT DISTINCT caller FROM t WHERE caller <> callee), r0 AS (SELECT min(caller) AS root FROM e),
p(path, depth, node, recursive) AS (SELECT [root], CAST(0 AS BIGINT), root, false FROM r0
UNION ALL SELECT list_append(path, callee), depth + 1, callee, list_contains(path, callee) FROM p JOIN t ON caller = node WHERE NOT recursive AND depth < 3 AND (caller <> callee OR depth = 0))
SELECT array_to_string(path, '>') AS path, depth, node, recursive, depth = 3 AND NOT recursive AND node IN (SELECT caller FROM m) AS truncated FROM p WHERE depth > 0"""


def _tree(spark, d, up):
    e = ad.all_calls(spark, d)
    root = e.agg(F.min("caller")).first()[0]
    return graph.tree(e, root, 3, up).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query("callees_tree", _tree_sql(False))
def callees_tree(spark, d):
    return _tree(spark, d, False)


@query("callers_tree", _tree_sql(True))
def callers_tree(spark, d):
    return _tree(spark, d, True)


@query("reachable_from_roots", f"""WITH RECURSIVE {ALL_CALLS_SQL}, r(node) AS (SELECT 0 UNION SELECT callee FROM r JOIN e ON caller = node) SELECT CAST(node AS BIGINT) AS node FROM r""")
def reachable_from_roots(spark, d):
    return graph.reachable(ad.all_calls(spark, d), spark.range(1).select(F.col("id").alias("node"))).select("node")


@query("in_degree", f"{_ALL_DEG_SQL} SELECT node, in_degree FROM d")
def in_degree(spark, d):
    e = ad.all_calls(spark, d)
    return graph.degrees(e, _nodes(e)).select("node", "in_degree")


@query("out_degree", f"{_ALL_DEG_SQL} SELECT node, out_degree FROM d")
def out_degree(spark, d):
    e = ad.all_calls(spark, d)
    return graph.degrees(e, _nodes(e)).select("node", "out_degree")


@query("role_inventory", f"""{_ALL_DEG_SQL} SELECT node, CASE WHEN node % 17 = 0 THEN 'FRAMEWORK_ENTRY' WHEN in_degree = 0 AND out_degree = 0 THEN 'ISOLATED' WHEN in_degree = 0 THEN 'ENTRY_CANDIDATE' WHEN out_degree = 0 THEN 'LEAF' ELSE 'NORMAL' END AS role FROM d""")
def role_inventory(spark, d):
    e = ad.all_calls(spark, d)
    v = _nodes(e)
    return graph.roles(graph.degrees(e, v), v.where("node % 17 = 0"))


@query("entry_auto", f"{_DEG_SQL} SELECT node FROM d WHERE in_degree = 0 OR node % 17 = 0")
def entry_auto(spark, d):
    e = ad.call_edges(spark, d)
    v = _nodes(e)
    return v.join(e.select(F.col("callee").alias("node")), "node", "left_anti").unionByName(v.where("node % 17 = 0")).distinct()


@query("exclude_splice", f"""WITH RECURSIVE {EDGES_SQL}, s(caller, callee) AS (SELECT caller, callee FROM e WHERE caller % 10 <> 3 UNION SELECT s.caller, e.callee FROM s JOIN e ON e.caller = s.callee WHERE s.callee % 10 = 3)
SELECT caller, callee FROM s WHERE callee % 10 <> 3""")
def exclude_splice(spark, d):
    e = ad.call_edges(spark, d)
    return graph.splice(e, _nodes(e).where("node % 10 = 3"))


@query("text_keepset", f"""WITH RECURSIVE {ALL_CALLS_SQL}, r(node) AS (SELECT DISTINCT callee FROM e WHERE CAST(callee AS VARCHAR) LIKE '%7' UNION SELECT caller FROM r JOIN e ON callee = node) SELECT node FROM r""")
def text_keepset(spark, d):
    e = ad.all_calls(spark, d)
    back = e.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    return graph.reachable(back, e.where("cast(callee AS string) LIKE '%7'").select(F.col("callee").alias("node"))).select("node")


@query("inbound_index", f"WITH {ALL_CALLS_SQL} SELECT callee, string_agg(CAST(caller AS VARCHAR), ',' ORDER BY caller) AS callers FROM e GROUP BY callee")
def inbound_index(spark, d):
    return ad.all_calls(spark, d).groupBy("callee").agg(F.array_join(F.transform(F.array_sort(F.collect_list("caller")), lambda x: x.cast("string")), ",").alias("callers"))


# --- types ----------------------------------------------------------------------------------------------------------------------


@query("subtypes_closure", f"WITH RECURSIVE {CLOSURE_SQL} SELECT sub, sup, min(depth) AS depth FROM tc GROUP BY sub, sup")
def subtypes_closure(spark, d):
    return hierarchy.closure(ad.type_edges(spark, d))


@query("class_chain", f"WITH RECURSIVE {CLOSURE_SQL} SELECT sub AS type, string_agg(sup, '>' ORDER BY depth) AS chain FROM tc WHERE sub LIKE 'S%' GROUP BY sub")
def class_chain(spark, d):
    up = hierarchy.closure(ad.type_edges(spark, d)).where("sub LIKE 'S%'")
    return up.groupBy(F.col("sub").alias("type")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "sup"))), lambda x: x["sup"]), ">").alias("chain"))


@query("most_specific", f"""WITH RECURSIVE {CLOSURE_SQL}, g AS (SELECT DISTINCT 'P' || (l_partkey % 50) AS grp, 'S' || l_suppkey AS type FROM lineitem UNION SELECT DISTINCT 'P' || (l_partkey % 50), 'N' || (l_orderkey % 25) FROM lineitem)
SELECT grp, type FROM g WHERE NOT EXISTS (SELECT 1 FROM g x JOIN tc ON tc.sub = x.type WHERE x.grp = g.grp AND tc.sup = g.type)""")
def most_specific(spark, d):
    li = table(spark, d, "lineitem")
    g = li.select(F.expr("'P' || (l_partkey % 50) AS grp"), F.expr("'S' || l_suppkey AS type")).unionByName(li.select(F.expr("'P' || (l_partkey % 50) AS grp"), F.expr("'N' || (l_orderkey % 25) AS type"))).distinct()
    return hierarchy.most_specific(g, hierarchy.closure(ad.type_edges(spark, d)))


_BODY_SQL = f"""{CLOSURE_SQL}, {DECLS_SQL},
c AS (SELECT type, sig, type AS impl, CAST(0 AS BIGINT) AS depth FROM md WHERE has_body UNION ALL SELECT tc.sub, sig, tc.sup, tc.depth FROM tc JOIN md ON md.type = tc.sup WHERE has_body AND NOT private),
b AS MATERIALIZED (SELECT type, sig, impl FROM c QUALIFY row_number() OVER (PARTITION BY type, sig ORDER BY depth, impl) = 1)"""


@query("impl_selection", f"WITH RECURSIVE {_BODY_SQL} SELECT type, sig, impl FROM b")
def impl_selection(spark, d):
    return hierarchy.chosen_bodies(hierarchy.closure(ad.type_edges(spark, d)), ad.method_decls(spark, d))


_VIRTUAL_SQL = f"""{_BODY_SQL}, q AS (SELECT type, sig FROM md WHERE type LIKE 'N%'),
t AS (SELECT q.type, q.sig, md.type AS impl FROM q JOIN md ON md.type = q.type AND md.sig = q.sig AND has_body UNION SELECT q.type, q.sig, b.impl FROM q JOIN tc ON tc.sup = q.type JOIN b ON b.type = tc.sub AND b.sig = q.sig),
vc AS MATERIALIZED (SELECT q.type, q.sig, count(impl) AS n, coalesce(string_agg(impl, ',' ORDER BY impl), '') AS targets, count(*) FILTER (impl = q.type) AS own FROM q LEFT JOIN t USING (type, sig) GROUP BY q.type, q.sig),
vl AS MATERIALIZED (SELECT type, sig, n, CASE WHEN n = 0 THEN 'NO_IMPL' WHEN n = 1 AND own = 1 THEN 'NO_OVERRIDE' WHEN n = 1 THEN 'SINGLE_IMPL' ELSE 'CHA' END AS label, targets FROM vc)"""


def _virtual(spark, d):
    decls = ad.method_decls(spark, d)
    return hierarchy.virtual_candidates(hierarchy.closure(ad.type_edges(spark, d)), decls, decls.where("type LIKE 'N%'").select("type", "sig"))


@query("virtual_candidates", f"WITH RECURSIVE {_VIRTUAL_SQL} SELECT type, sig, n, label, targets FROM vl")
def virtual_candidates(spark, d):
    return _virtual(spark, d)


_KIND_SQL = "CASE WHEN list_contains(mods, 'private') THEN 'P' WHEN list_contains(mods, 'static') THEN 'T' WHEN list_contains(mods, 'final') THEN 'F' ELSE 'V' END"


@query("bind_kind", f"WITH {SITES_SQL} SELECT edge_id, {_KIND_SQL} AS kind FROM cs")
def bind_kind(spark, d):
    return ad.call_sites(spark, d).select("edge_id", hierarchy.bind_kind(F.col("sig"), F.col("mods")).alias("kind"))


def _rules(spark):
    return spark.createDataFrame([("N1", "m1", "S1"), ("N1", None, "S2"), ("N4", None, "S4"), ("N7", "m2", "S7"), ("N9", None, "S9")], "decl_type string, sig string, impl string")


_RULES_SQL = "ru(decl_type, sig, impl) AS (VALUES ('N1', 'm1', 'S1'), ('N1', NULL, 'S2'), ('N4', NULL, 'S4'), ('N7', 'm2', 'S7'), ('N9', NULL, 'S9'))"
_CASCADE_SQL = f"""{_VIRTUAL_SQL}, {SITES_SQL}, {_RULES_SQL},
k AS (SELECT cs.*, {_KIND_SQL} AS kind, vl.n, vl.label, vl.targets, coalesce(x.impl, y.impl) AS rule FROM cs LEFT JOIN vl ON vl.type = cs.decl_type AND vl.sig = cs.sig
LEFT JOIN ru x ON x.decl_type = cs.decl_type AND x.sig = cs.sig LEFT JOIN ru y ON y.decl_type = cs.decl_type AND y.sig IS NULL),
re AS MATERIALIZED (SELECT edge_id, CASE kind WHEN 'P' THEN 'STATIC_BOUND:PRIVATE' WHEN 'T' THEN 'STATIC_BOUND:STATIC' WHEN 'F' THEN 'NOT_OVERRIDABLE:FINAL_METHOD' ELSE CASE WHEN label = 'CHA' AND rule IS NOT NULL THEN 'CALL_RULE' ELSE coalesce(label, 'NO_IMPL') END END AS label,
CAST(CASE WHEN kind <> 'V' OR label = 'CHA' AND rule IS NOT NULL THEN 1 ELSE coalesce(n, 0) END AS BIGINT) AS n,
CASE WHEN kind <> 'V' THEN decl_type WHEN label = 'CHA' AND rule IS NOT NULL THEN rule ELSE coalesce(nullif(targets, ''), decl_type) END AS targets FROM k)"""


def _resolved(spark, d):
    return hierarchy.cascade(ad.call_sites(spark, d), _virtual(spark, d), _rules(spark))


@query("resolution_cascade", f"WITH RECURSIVE {_CASCADE_SQL} SELECT edge_id, label, n, targets FROM re")
def resolution_cascade(spark, d):
    return _resolved(spark, d)


@query("label_histogram", f"WITH RECURSIVE {_CASCADE_SQL} SELECT label, count(*) AS n FROM re GROUP BY label")
def label_histogram(spark, d):
    return _resolved(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query("in_degree_resolved", f"WITH RECURSIVE {_CASCADE_SQL}, x AS (SELECT unnest(string_split(targets, ',')) AS target FROM re) SELECT target, count(*) AS in_degree FROM x GROUP BY target")
def in_degree_resolved(spark, d):
    by = _resolved(spark, d).groupBy("targets").agg(F.count("*").alias("n"))  # calls of one list are counted before it is dealt out
    return by.select(F.explode(F.split("targets", ",")).alias("target"), "n").groupBy("target").agg(F.sum("n").alias("in_degree"))


@query("candidate_fanout", f"WITH RECURSIVE {_CASCADE_SQL} SELECT edge_id, CASE WHEN n <= 1 THEN 'RESOLVED' WHEN n <= 3 THEN 'CANDIDATE' ELSE 'UNEXPANDED' END AS state, array_to_string(string_split(targets, ',')[1:20], ',') AS listed FROM re")
def candidate_fanout(spark, d):
    r = _resolved(spark, d)
    state = F.when(F.col("n") <= 1, "RESOLVED").when(F.col("n") <= 3, "CANDIDATE").otherwise("UNEXPANDED")
    return r.select("edge_id", state.alias("state"), F.array_join(F.slice(F.split("targets", ","), 1, 20), ",").alias("listed"))


@query("qualified_candidates", f"""WITH RECURSIVE {CLOSURE_SQL}, {SITES_SQL} SELECT edge_id, CASE WHEN EXISTS (SELECT 1 FROM tc WHERE tc.sub = cs.qualifier AND tc.sup = cs.decl_type) THEN qualifier ELSE decl_type END AS from_type FROM cs""")
def qualified_candidates(spark, d):
    up = hierarchy.closure(ad.type_edges(spark, d)).select(F.col("sub").alias("qualifier"), F.col("sup").alias("decl_type"), F.lit(True).alias("narrower"))
    return ad.call_sites(spark, d).join(up, ["qualifier", "decl_type"], "left").select("edge_id", F.when(F.col("narrower"), F.col("qualifier")).otherwise(F.col("decl_type")).alias("from_type"))


@query("rule_usage", f"""WITH RECURSIVE {_CASCADE_SQL}, u AS (SELECT cs.decl_type, cs.sig, re.label FROM re JOIN cs USING (edge_id))
SELECT decl_type, coalesce(sig, '') AS sig, CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.decl_type = ru.decl_type AND (ru.sig IS NULL OR u.sig = ru.sig) AND label = 'CALL_RULE') THEN 'APPLIED' WHEN EXISTS (SELECT 1 FROM u WHERE u.decl_type = ru.decl_type AND (ru.sig IS NULL OR u.sig = ru.sig)) THEN 'REACHED' ELSE 'UNUSED' END AS usage FROM ru""")
def rule_usage(spark, d):
    u = _resolved(spark, d).select("edge_id", "label").join(ad.call_sites(spark, d).select("edge_id", F.col("decl_type").alias("t"), F.col("sig").alias("s")), "edge_id")
    u = u.groupBy("t", "s").agg(F.max(F.col("label") == "CALL_RULE").alias("hit"))
    r = _rules(spark)
    j = r.join(u, (F.col("t") == F.col("decl_type")) & (F.col("sig").isNull() | (F.col("s") == F.col("sig"))), "left").groupBy("decl_type", "sig").agg(F.max("hit").alias("hit"))
    return j.select("decl_type", F.coalesce("sig", F.lit("")).alias("sig"), F.when(F.col("hit"), "APPLIED").when(F.col("hit").isNotNull(), "REACHED").otherwise("UNUSED").alias("usage"))


@query("suggestions_topk", f"""WITH RECURSIVE {_CASCADE_SQL} SELECT cs.decl_type || '#' || cs.sig AS rule, count(DISTINCT cs.line) AS sites, max(re.n) AS candidates FROM re JOIN cs USING (edge_id) WHERE re.label = 'CHA' GROUP BY 1 ORDER BY sites DESC, rule LIMIT 20""")
def suggestions_topk(spark, d):
    j = _resolved(spark, d).where("label = 'CHA'").join(ad.call_sites(spark, d), "edge_id")
    return j.groupBy(F.concat("decl_type", F.lit("#"), "sig").alias("rule")).agg(F.countDistinct("line").alias("sites"), F.max("n").alias("candidates")).orderBy(F.desc("sites"), "rule").limit(20)


@query("call_rule_priority", f"WITH {SITES_SQL}, {_RULES_SQL} SELECT edge_id, impl FROM cs JOIN ru ON ru.decl_type = cs.decl_type AND (ru.sig IS NULL OR ru.sig = cs.sig) QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY CASE WHEN ru.sig IS NULL THEN 1 ELSE 0 END, impl) = 1")
def call_rule_priority(spark, d):
    r = _rules(spark).select(F.col("decl_type").alias("t"), F.col("sig").alias("s"), "impl")
    j = ad.call_sites(spark, d).join(F.broadcast(r), (F.col("t") == F.col("decl_type")) & (F.col("s").isNull() | (F.col("s") == F.col("sig"))))
    return j.groupBy("edge_id").agg(F.min_by("impl", F.struct(F.col("s").isNull(), F.col("impl"))).alias("impl"))


@query("callback_edges", f"WITH {SITES_SQL}, cb(sig, target) AS (VALUES ('m1', 'run'), ('m1', 'call'), ('m3', 'accept')) SELECT edge_id, caller, decl_type || '#' || target AS callee FROM cs JOIN cb USING (sig)")
def callback_edges(spark, d):
    rules = spark.createDataFrame([("m1", "run"), ("m1", "call"), ("m3", "accept")], "sig string, target string")
    return ad.call_sites(spark, d).join(F.broadcast(rules), "sig").select("edge_id", "caller", F.concat("decl_type", F.lit("#"), "target").alias("callee"))


@query("framework_entries", f"WITH RECURSIVE {CLOSURE_SQL}, {DECLS_SQL} SELECT DISTINCT type, sig FROM md WHERE sig = 'm0' AND has_body OR sig = 'm2' AND EXISTS (SELECT 1 FROM tc WHERE tc.sub = md.type AND tc.sup = 'R1')")
def framework_entries(spark, d):
    up = hierarchy.closure(ad.type_edges(spark, d)).where("sup = 'R1'").select(F.col("sub").alias("type"))
    m = ad.method_decls(spark, d)
    return m.where("sig = 'm0' AND has_body").select("type", "sig").unionByName(m.where("sig = 'm2'").join(up, "type", "left_semi").select("type", "sig")).distinct()


@query("bean_unique", """WITH b AS (SELECT 'N' || s_nationkey AS type, count(*) AS n, min('S' || s_suppkey) AS impl FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) SELECT type, n, CASE WHEN n = 1 THEN impl ELSE '' END AS impl FROM b""")
def bean_unique(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.expr("'N' || s_nationkey").alias("type"))
    return s.agg(F.count("*").alias("n"), F.min(F.expr("'S' || s_suppkey")).alias("impl")).select("type", "n", F.when(F.col("n") == 1, F.col("impl")).otherwise("").alias("impl"))


@query("unique_simple_name", "WITH t AS (SELECT split_part(c_name, '#', 2) AS simple, c_custkey FROM customer), u AS (SELECT right(simple, 3) AS simple, count(*) AS n, min(c_custkey) AS id FROM t GROUP BY 1) SELECT simple, n, CASE WHEN n = 1 THEN id ELSE -1 END AS id FROM u")
def unique_simple_name(spark, d):
    t = table(spark, d, "customer").select(F.expr("right(split_part(c_name, '#', 2), 3)").alias("simple"), "c_custkey")
    return t.groupBy("simple").agg(F.count("*").alias("n"), F.min("c_custkey").alias("id")).select("simple", "n", F.when(F.col("n") == 1, F.col("id")).otherwise(F.lit(-1).cast("long")).alias("id"))


# --- dataflow -------------------------------------------------------------------------------------------------------------------

_RETURNS_SQL = """rt AS MATERIALIZED (SELECT 'f' || (p_partkey % 400) AS method, CASE WHEN p_partkey % 400 % 3 = 0 THEN 'M' ELSE 'T' END AS kind, CASE WHEN p_partkey % 400 % 3 = 0 THEN 'f' || (p_partkey * 7 % 400) ELSE 'T' || (p_partkey % 400 % 40) END AS value FROM part)"""


def _returns(spark, d):
    return table(spark, d, "part").select(F.expr("'f' || (p_partkey % 400) AS method"), F.expr("CASE WHEN p_partkey % 400 % 3 = 0 THEN 'M' ELSE 'T' END AS kind"), F.expr("CASE WHEN p_partkey % 400 % 3 = 0 THEN 'f' || (p_partkey * 7 % 400) ELSE 'T' || (p_partkey % 400 % 40) END AS value"))


def _fold_sql() -> str:
    ctes = ["k0 AS MATERIALIZED (SELECT method, min(value) AS value FROM rt GROUP BY method HAVING count(*) = count(*) FILTER (kind = 'T') AND min(value) = max(value))"]
    for i in range(1, 9):
        ctes.append(f"""k{i} AS MATERIALIZED (SELECT rt.method, min(CASE WHEN rt.kind = 'T' THEN rt.value ELSE k.value END) AS value FROM rt LEFT JOIN k{i - 1} k ON rt.kind = 'M' AND k.method = rt.value GROUP BY rt.method
HAVING count(*) = count(CASE WHEN rt.kind = 'T' THEN rt.value ELSE k.value END) AND min(CASE WHEN rt.kind = 'T' THEN rt.value ELSE k.value END) = max(CASE WHEN rt.kind = 'T' THEN rt.value ELSE k.value END))""")
    return f"WITH {_RETURNS_SQL}, {', '.join(ctes)} SELECT method, value FROM k8"


@query("factory_fold", _fold_sql())
def factory_fold(spark, d):
    return hierarchy.factory_fold(_returns(spark, d))


@query("field_agreement", "SELECT 'F' || (p_partkey * 3 % 1400) AS field, count(*) AS assigns, min(p_type) AS value FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1 AND bool_and(p_size > 5)")
def field_agreement(spark, d):
    g = table(spark, d, "part").groupBy(F.expr("'F' || (p_partkey * 3 % 1400)").alias("field")).agg(F.count("*").alias("assigns"), F.min("p_type").alias("value"), F.max("p_type").alias("hi"), F.bool_and(F.col("p_size") > 5).alias("ok"))
    return g.where("value = hi AND ok").select("field", "assigns", "value")


@query("own_valued_fields", "SELECT p_brand AS field, bool_or(p_size % 7 <> 0) AS own FROM part GROUP BY p_brand")
def own_valued_fields(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("field")).agg(F.bool_or(F.col("p_size") % 7 != 0).alias("own"))


@query("narrow_by_bound", f"WITH RECURSIVE {_VIRTUAL_SQL} SELECT vl.type, vl.sig, coalesce(string_agg(x, ',' ORDER BY x) FILTER (x LIKE 'S%'), vl.targets) AS targets FROM vl, unnest(string_split(vl.targets, ',')) AS u(x) GROUP BY vl.type, vl.sig, vl.targets")
def narrow_by_bound(spark, d):
    v = _virtual(spark, d).select(F.concat_ws("#", "type", "sig").alias("edge_id"), "type", "sig", F.split("targets", ",").alias("targets"))
    bound = v.select("edge_id", F.filter("targets", lambda x: x.startswith("S")).alias("allowed"))
    return dispatch.narrowed(v, bound).join(v.select("edge_id", "type", "sig"), "edge_id").select("type", "sig", F.array_join("targets", ",").alias("targets"))


# --- predicates and names ---------------------------------------------------------------------------------------------------------

_GUARD_SQL = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END"


@query("guard_pruned_calls", f"SELECT event_id, coalesce({_GUARD_SQL} <> 'click', true) AND coalesce(value > 20 OR event_id % 3 = 0, true) AS kept FROM events")
def guard_pruned_calls(spark, d):
    ev = table(spark, d, "events").withColumn("kind", F.when(F.col("event_id") % 5 != 0, F.col("event_type"))).withColumn("large", F.when(F.col("value").isNotNull(), ((F.col("value") > 20) | (F.col("event_id") % 3 == 0)).cast("string")))
    atoms = F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(c).alias("subject"), F.array(F.lit(v)).alias("values")) for op, c, v in (("NE", "kind", "click"), ("EQ", "large", "true"))])).alias("a")
    cut = dispatch.pruned_by_guards(ev.select(F.col("event_id").alias("edge_id"), atoms).select("edge_id", "a.*")).withColumnRenamed("edge_id", "event_id").withColumn("cut", F.lit(True))
    return ev.join(cut, "event_id", "left").select("event_id", F.col("cut").isNull().alias("kept"))


_PKG_SQL = "array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]+)', 1), '.')), '.')"


def _packages(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.reverse(F.split(F.regexp_extract("url", "://([^/?#]+)", 1), "\\.")), ".").alias("name"))


@query("glob_match", f"WITH t AS (SELECT page_id, {_PKG_SQL} AS name FROM pages) SELECT page_id, name, regexp_matches(name, '^net\\.(?:[^.$]+\\.)*.+$') AND name LIKE 'net.%' AS below_net, regexp_matches(name, '^com\\.example\\.[^.]+$') AS in_example, regexp_matches(name, '^com\\.example\\.[^.$]*tion[^.$]*$') AS tion FROM t")
def glob_match(spark, d):
    n = F.col("name")
    return _packages(spark, d).select("page_id", "name", names.glob_match(n, "net.**").alias("below_net"), names.glob_match(n, "com.example.*").alias("in_example"), names.glob_match(n, "com.example.*tion*").alias("tion"))


@query("short_labels", f"WITH t AS (SELECT page_id, {_PKG_SQL} AS name FROM pages) SELECT page_id, regexp_replace(name, '^.*[.$]', '') AS simple, regexp_extract(name, '^(.*)\\.[^.]*$', 1) AS package, lower(regexp_replace(name, '^.*[.$]', '')[1]) || regexp_replace(name, '^.*[.$]', '')[2:] AS bean FROM t")
def short_labels(spark, d):
    n = F.col("name")
    return _packages(spark, d).select("page_id", names.simple_type(n).alias("simple"), names.package_of(n).alias("package"), names.bean_name(names.simple_type(n)).alias("bean"))


@query("param_short", "SELECT p_partkey, array_to_string(list_transform(string_split('java.lang.' || p_type || ',a.b.' || p_brand || '[]', ','), lambda x: regexp_replace(x, '^.*\\.', '')), ',') AS params FROM part")
def param_short(spark, d):
    return table(spark, d, "part").select("p_partkey", names.short_params(F.expr("'java.lang.' || p_type || ',a.b.' || p_brand || '[]'")).alias("params"))


@query("csv_escape", """SELECT doc_id, CASE WHEN regexp_matches(text, '[,\\t"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def csv_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", names.csv_field(F.col("text")).alias("field"))


@query("row_codec", r"SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS row, text AS back FROM documents")
def row_codec(spark, d):
    row = names.escape_row(F.col("text"))
    return table(spark, d, "documents").select("doc_id", row.alias("row"), names.unescape_row(row).alias("back"))


@query("test_source_filter", "SELECT doc_id FROM documents WHERE NOT list_has_any(list_transform(string_split(source || '/' || CASE WHEN doc_id % 4 = 0 THEN 'Test' ELSE 'main' END || '/' || lang, '/'), lambda x: lower(x)), ['test', 'tests'])")
def test_source_filter(spark, d):
    path = F.expr("source || '/' || CASE WHEN doc_id % 4 = 0 THEN 'Test' ELSE 'main' END || '/' || lang")
    return table(spark, d, "documents").where(~names.is_test_path(path)).select("doc_id")


@query("find_loose", f"WITH {DECLS_SQL}, g AS (SELECT sig, count(*) AS n, min(type) AS type FROM md WHERE has_body GROUP BY sig, type[1:2]) SELECT sig, type, n FROM g WHERE n = 1")
def find_loose(spark, d):
    g = ad.method_decls(spark, d).where("has_body").groupBy("sig", F.substring("type", 1, 2).alias("k")).agg(F.count("*").alias("n"), F.min("type").alias("type"))
    return g.where("n = 1").select("sig", "type", "n")


@query("field_accessors", "SELECT 'P' || (l_partkey % 100) AS field, 'S' || l_suppkey AS accessor, count(*) AS n, bool_or(l_returnflag = 'R') AS writes, bool_or(l_returnflag <> 'R') AS reads FROM lineitem GROUP BY 1, 2")
def field_accessors(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.expr("'P' || (l_partkey % 100)").alias("field"), F.expr("'S' || l_suppkey").alias("accessor"))
    return g.agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("writes"), F.bool_or(F.col("l_returnflag") != "R").alias("reads"))


@query("conditions_inventory", "SELECT event_type AS subject, CASE WHEN value IS NULL THEN 'none' WHEN event_id % 3 = 0 THEN 'undecidable' ELSE 'decidable' END AS state, count(*) AS n FROM events GROUP BY 1, 2")
def conditions_inventory(spark, d):
    state = F.when(F.col("value").isNull(), "none").when(F.col("event_id") % 3 == 0, "undecidable").otherwise("decidable")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("subject"), state.alias("state")).agg(F.count("*").alias("n"))


# --- facts and maintenance ----------------------------------------------------------------------------------------------------------


@query("symbol_join_badrefs", "SELECT o_orderkey AS edge_id, c_name AS caller, c_custkey IS NULL AS bad FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0")
def symbol_join_badrefs(spark, d):
    c = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("caller"), F.lit(True).alias("found"))
    return table(spark, d, "orders").join(c, "o_custkey", "left").select(F.col("o_orderkey").alias("edge_id"), "caller", F.col("found").isNull().alias("bad"))


@query("decl_dedup", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1")
def decl_dedup(spark, d):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("duplicate_types", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_types(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("unresolved_list", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents WHERE lang <> 'en' GROUP BY source, lang")
def unresolved_list(spark, d):
    return table(spark, d, "documents").where("lang <> 'en'").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"))


def _files(spark, d):
    doc = table(spark, d, "documents").select(F.expr("source || '/' || doc_id AS path"), "doc_id", F.col("n_chars").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    old = doc.where("doc_id % 10 <> 0").select("path", F.expr("size - CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS size"), "hash")
    return old, doc.where("doc_id % 11 <> 0").select("path", "size", "hash")


_DIFF_SQL = """o AS (SELECT source || '/' || doc_id AS path, doc_id FROM documents WHERE doc_id % 10 <> 0), w AS (SELECT source || '/' || doc_id AS path, doc_id FROM documents WHERE doc_id % 11 <> 0),
df AS MATERIALIZED (SELECT coalesce(o.path, w.path) AS path, CASE WHEN o.path IS NULL THEN 'ADDED' WHEN w.path IS NULL THEN 'REMOVED' WHEN o.doc_id % 9 = 0 THEN 'CHANGED' ELSE 'SAME' END AS change FROM o FULL JOIN w ON o.path = w.path)"""


@query("file_diff", f"WITH {_DIFF_SQL} SELECT path, change FROM df")
def file_diff(spark, d):
    return maintenance.file_diff(*_files(spark, d))


_DEPS_SQL = "dp AS MATERIALIZED (SELECT source || '/' || doc_id AS path, source || '/' || (doc_id - 20 * (1 + doc_id % 3)) AS dep, doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 200 >= 60)"


def _deps(spark, d):
    return table(spark, d, "documents").where("doc_id % 5 <> 0 AND doc_id % 200 >= 60").select(F.expr("source || '/' || doc_id AS path"), F.expr("source || '/' || (doc_id - 20 * (1 + doc_id % 3)) AS dep"))


@query("stale_dependents", f"WITH {_DIFF_SQL}, {_DEPS_SQL} SELECT DISTINCT dp.path FROM dp JOIN df ON df.path = dp.dep AND change <> 'SAME'")
def stale_dependents(spark, d):
    return _deps(spark, d).join(file_diff(spark, d).where("change <> 'SAME'").select(F.col("path").alias("dep")), "dep").select("path").distinct()


@query("cascade_fixpoint", f"WITH RECURSIVE {_DIFF_SQL}, {_DEPS_SQL}, s(path) AS (SELECT path FROM df WHERE change = 'CHANGED' UNION SELECT dp.path FROM dp JOIN s ON s.path = dp.dep) SELECT path FROM s")
def cascade_fixpoint(spark, d):
    return maintenance.stale_closure(file_diff(spark, d).where("change = 'CHANGED'"), _deps(spark, d)).select("path")


@query("valid_block_copy", f"WITH {_DIFF_SQL} SELECT o.path FROM o ANTI JOIN (SELECT path FROM df WHERE change <> 'SAME') x ON x.path = o.path UNION ALL SELECT w.path FROM w SEMI JOIN (SELECT path FROM df WHERE change <> 'SAME') x ON x.path = w.path")
def valid_block_copy(spark, d):
    old, new = _files(spark, d)
    return maintenance.replace_blocks(old.select("path"), new.select("path"), maintenance.file_diff(old, new).where("change <> 'SAME'"))


@query("library_diff", "SELECT coalesce(a.lib, b.lib) AS lib, CASE WHEN a.lib IS NULL THEN 'ADDED' WHEN b.lib IS NULL THEN 'REMOVED' WHEN a.f <> b.f THEN 'CHANGED' ELSE 'SAME' END AS change FROM (SELECT s_suppkey AS lib, s_nationkey AS f FROM supplier WHERE s_suppkey % 7 <> 0) a FULL JOIN (SELECT s_suppkey AS lib, CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS f FROM supplier WHERE s_suppkey % 8 <> 0) b ON a.lib = b.lib")
def library_diff(spark, d):
    s = table(spark, d, "supplier")
    old = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("lib"), F.col("s_nationkey").alias("fingerprint"))
    new = s.where("s_suppkey % 8 <> 0").select(F.col("s_suppkey").alias("lib"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS fingerprint"))
    return maintenance.library_diff(old, new)


@query("reordered_packages", "WITH a AS (SELECT s_nationkey AS pkg, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS o, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey % 3, s_suppkey) AS n FROM supplier GROUP BY 1) SELECT pkg FROM a WHERE o <> n")
def reordered_packages(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("pkg"))
    a = s.agg(F.array_sort(F.collect_list("s_suppkey")).alias("o"), F.transform(F.array_sort(F.collect_list(F.struct(F.expr("s_suppkey % 3 AS k"), "s_suppkey"))), lambda x: x["s_suppkey"]).alias("n"))
    return a.where("o <> n").select("pkg")


def block_checksums(spark, d):
    c = table(spark, d, "conversations")
    return maintenance.block_crc(c.select(F.col("conv_id").alias("block"), F.col("turn").alias("pos"), F.concat_ws("\t", "role", "text").alias("line")))


QUERIES["block_checksums"] = block_checksums  # DuckDB has no crc32: tests hold it against Python's
