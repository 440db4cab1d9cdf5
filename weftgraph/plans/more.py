"""More queries: hierarchy scopes, guards, injection, linkage, ranges, reports, dependencies and the text codec."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import names
from weftgraph.operators import dependencies, dispatch, graph, hierarchy, ranges, reports
from weftgraph.plans.queries import _BODY_SQL, _DEG_SQL, _KIND_SQL, _NODES_SQL, _PKG_SQL, QUERIES, SQL, _nodes, _packages, query
from weftgraph.sources import adapters as ad
from weftgraph.sources.adapters import ALL_CALLS_SQL, CLOSURE_SQL, DECLS_SQL, EDGES_SQL, SITES_SQL, table


@query("entry_by_pattern", f"WITH t AS (SELECT page_id, {_PKG_SQL} AS name FROM pages) SELECT page_id, name FROM t WHERE regexp_matches(name, '^com\\.(?:[^.$]+\\.)*.+$')")
def entry_by_pattern(spark, d):
    return _packages(spark, d).where(names.glob_match(F.col("name"), "com.**"))


def _mains(e):
    return e.groupBy(F.col("callee").alias("node")).agg(F.count("*").alias("n")).where("n >= 5").select("node")


_MAINS_SQL = "mn AS (SELECT callee AS node FROM e GROUP BY callee HAVING count(*) >= 5)"


@query("workspace_scope", f"WITH RECURSIVE {EDGES_SQL}, {_MAINS_SQL}, r(node) AS (SELECT node FROM mn UNION SELECT caller FROM r JOIN e ON callee = node) SELECT node FROM r")
def workspace_scope(spark, d):
    e = ad.call_edges(spark, d)
    return graph.reachable(e.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")), _mains(e)).select("node")


_CUT = "(caller + callee) % 3 = 0"
_PRUNED_SQL = f"""{EDGES_SQL}, {_MAINS_SQL}, k AS (SELECT * FROM e WHERE NOT {_CUT}), em(node) AS (SELECT node FROM mn UNION SELECT callee FROM em JOIN k ON caller = node),
pt(node) AS (SELECT callee FROM e JOIN em ON caller = node WHERE {_CUT} UNION SELECT callee FROM pt JOIN e ON caller = node), ps AS (SELECT node FROM pt EXCEPT SELECT node FROM em)"""


def _pruned(spark, d):
    e = ad.call_edges(spark, d)
    kept, pruned = e.where(f"NOT {_CUT}"), e.where(_CUT)
    return e, kept, reports.pruned_subtree(kept, pruned, _mains(e))


@query("pruned_subtree", f"WITH RECURSIVE {_PRUNED_SQL} SELECT node FROM ps")
def pruned_subtree(spark, d):
    return _pruned(spark, d)[2]


@query("absent_cause", f"""WITH RECURSIVE {_PRUNED_SQL}, {_NODES_SQL}, c AS (SELECT node, 1 AS code FROM ps UNION ALL SELECT caller, 2 FROM e WHERE caller > callee UNION ALL SELECT callee, 4 FROM e WHERE callee % 10 = 3),
m AS (SELECT node, max(code) AS code FROM c GROUP BY node) SELECT v.node, CASE code WHEN 1 THEN 'PRUNED' WHEN 2 THEN 'CYCLE' WHEN 4 THEN 'EXCLUDED' ELSE 'NOT_REACHED' END AS cause FROM v LEFT JOIN m USING (node) WHERE v.node NOT IN (SELECT node FROM em)""")
def absent_cause(spark, d):
    e, kept, below = _pruned(spark, d)
    causes = below.withColumn("cause", F.lit("PRUNED"))
    causes = causes.unionByName(e.where("caller > callee").select(F.col("caller").alias("node"), F.lit("CYCLE").alias("cause"))).unionByName(e.where("callee % 10 = 3").select(F.col("callee").alias("node"), F.lit("EXCLUDED").alias("cause")))
    return reports.absent_cause(_nodes(e), graph.reachable(kept, _mains(e)), causes)


@query("methods_inventory", f"""{_DEG_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_MAINS_SQL}, r(node) AS (SELECT node FROM mn UNION SELECT callee FROM r JOIN e ON caller = node)
SELECT node, in_degree, out_degree, CASE WHEN node IN (SELECT node FROM mn) THEN 'FRAMEWORK_ENTRY' WHEN in_degree = 0 AND out_degree = 0 THEN 'ISOLATED' WHEN in_degree = 0 THEN 'ENTRY_CANDIDATE' WHEN out_degree = 0 THEN 'LEAF' ELSE 'NORMAL' END AS role, node IN (SELECT node FROM r) AS reachable FROM d""")
def methods_inventory(spark, d):
    e = ad.call_edges(spark, d)
    return reports.methods_inventory(_nodes(e), e, _mains(e), graph.reachable(e, _mains(e)))


# --- types ----------------------------------------------------------------------------------------------------------------------


@query("superinterfaces", f"WITH RECURSIVE {CLOSURE_SQL} SELECT sub AS type, sup AS interface, row_number() OVER (PARTITION BY sub ORDER BY depth, sup) AS rank FROM tc")
def superinterfaces(spark, d):
    up = hierarchy.closure(ad.type_edges(spark, d))
    return dispatch.superinterfaces(up, up.select(F.col("sup").alias("type")))


@query("linked_declarations", f"""WITH RECURSIVE {CLOSURE_SQL}, {DECLS_SQL}, x AS (SELECT type, sig, type AS decl, has_body, CAST(0 AS BIGINT) AS depth FROM md UNION ALL SELECT tc.sub, sig, tc.sup, has_body, tc.depth FROM tc JOIN md ON md.type = tc.sup)
SELECT type, sig, decl, has_body FROM x QUALIFY row_number() OVER (PARTITION BY type, sig ORDER BY depth, decl) = 1""")
def linked_declarations(spark, d):
    return dispatch.linked_declarations(hierarchy.closure(ad.type_edges(spark, d)), ad.method_decls(spark, d))


@query("local_new", f"""WITH RECURSIVE {_BODY_SQL}, {SITES_SQL}, h AS (SELECT edge_id, sig, unnest([decl_type, qualifier]) AS type FROM cs WHERE qualifier IS NOT NULL),
g AS (SELECT edge_id, count(*) AS n, count(impl) AS c, count(DISTINCT impl) AS u, string_agg(DISTINCT impl, ',' ORDER BY impl) AS targets FROM h LEFT JOIN b USING (type, sig) GROUP BY edge_id)
SELECT edge_id, CASE WHEN u = 1 THEN 'LOCAL_NEW' ELSE 'LOCAL_NEW_MULTI' END AS label, targets FROM g WHERE n = c""")
def local_new(spark, d):
    bodies = hierarchy.chosen_bodies(hierarchy.closure(ad.type_edges(spark, d)), ad.method_decls(spark, d))
    sites = ad.call_sites(spark, d).where("qualifier IS NOT NULL").select("edge_id", "sig", F.array("decl_type", "qualifier").alias("hints"))
    return dispatch.local_new(sites, bodies)


@query("injection", f"""WITH RECURSIVE {CLOSURE_SQL}, p AS (SELECT c_custkey AS point, 'N' || c_nationkey AS type, CASE WHEN c_mktsegment < 'F' THEN 'q' || (c_custkey % 9) END AS qualifier FROM customer),
bn AS (SELECT 'S' || s_suppkey AS impl, 'q' || (s_suppkey % 9) AS name, s_acctbal > 9900 AS unsure FROM supplier WHERE s_acctbal > 4000),
w AS (SELECT DISTINCT type FROM p), f AS (SELECT w.type, bn.* FROM w JOIN tc ON tc.sup = w.type JOIN bn ON bn.impl = tc.sub),
s AS (SELECT type FROM f GROUP BY type HAVING NOT bool_or(unsure))
SELECT point, CASE WHEN any_value(qualifier) IS NULL THEN 'SPRING_DI' ELSE 'SPRING_DI_QUALIFIER' END AS label, min(impl) AS impl FROM p JOIN s USING (type) JOIN f ON f.type = p.type AND (qualifier IS NULL OR name = qualifier) GROUP BY point HAVING count(DISTINCT impl) = 1""")
def injection(spark, d):
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("point"), F.expr("'N' || c_nationkey AS type"), F.expr("CASE WHEN c_mktsegment < 'F' THEN 'q' || (c_custkey % 9) END AS qualifier"))
    beans = table(spark, d, "supplier").where("s_acctbal > 4000").select(F.expr("'S' || s_suppkey AS type"), F.expr("'q' || (s_suppkey % 9) AS name"), F.expr("s_acctbal > 9900 AS undetermined"))
    return dispatch.injected(points, beans, hierarchy.closure(ad.type_edges(spark, d)))


@query("mapping_provider", f"""WITH {SITES_SQL}, mp(key, impl, pos) AS (VALUES ('HINT@S4', 'X1', 0), ('N3#m2', 'X2', 1), ('N3', 'X3', 2), ('N8', 'X4', 2))
SELECT edge_id, impl FROM cs JOIN mp ON key = 'HINT@' || qualifier OR key = decl_type || '#' || sig OR key = decl_type QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY pos) = 1""")
def mapping_provider(spark, d):
    mapping = spark.createDataFrame([("HINT@S4", "X1"), ("N3#m2", "X2"), ("N3", "X3"), ("N8", "X4")], "key string, impl string")
    return dispatch.mapped(ad.call_sites(spark, d).select("edge_id", "decl_type", "sig", F.col("qualifier").alias("hint")), mapping)


@query("guard_atoms", """WITH g AS (SELECT event_id, event_type AS subject, 'EQ' AS op, ['click'] AS vals FROM events UNION ALL SELECT event_id, CASE WHEN value > 10 THEN event_type END, 'NI', ['error', 'view'] FROM events)
SELECT DISTINCT event_id AS edge_id FROM g WHERE subject IS NOT NULL AND (op = 'EQ' AND NOT list_contains(vals, subject) OR op = 'NI' AND list_contains(vals, subject))""")
def guard_atoms(spark, d):
    ev = table(spark, d, "events")
    eq = ev.select(F.col("event_id").alias("edge_id"), F.lit("EQ").alias("op"), F.col("event_type").alias("subject"), F.array(F.lit("click")).alias("values"))
    ni = ev.select(F.col("event_id").alias("edge_id"), F.lit("NI").alias("op"), F.expr("CASE WHEN value > 10 THEN event_type END AS subject"), F.array(F.lit("error"), F.lit("view")).alias("values"))
    return dispatch.pruned_by_guards(eq.unionByName(ni))


# --- ranges, names and reports ----------------------------------------------------------------------------------------------------


@query("enclosing_method", """WITH r AS (SELECT p_partkey // 40 AS file, p_partkey AS method, p_size * 4 AS lo, p_size * 4 + p_partkey % 60 AS hi FROM part), q AS (SELECT DISTINCT l_partkey // 40 AS file, l_orderkey % 260 AS line FROM lineitem)
SELECT q.file, q.line, arg_min(method, (hi - lo) * 1000000000 + method) AS method FROM q JOIN r ON r.file = q.file AND line BETWEEN lo AND hi GROUP BY q.file, q.line""")
def enclosing_method(spark, d):
    r = table(spark, d, "part").select(F.expr("p_partkey div 40 AS file"), F.col("p_partkey").alias("method"), F.expr("p_size * 4 AS lo"), F.expr("p_size * 4 + p_partkey % 60 AS hi"), F.col("p_partkey").alias("ord"))
    q = table(spark, d, "lineitem").select(F.expr("l_partkey div 40 AS file"), F.expr("l_orderkey % 260 AS line")).distinct()
    return ranges.enclosing(q, r)


_PATH = "source || '/' || lang || '/' || doc_id"


@query("source_folder_tags", f"""WITH t AS (SELECT DISTINCT {_PATH} AS path FROM documents), f AS (SELECT DISTINCT source AS prefix, source AS tag FROM documents UNION ALL SELECT DISTINCT source || '/' || lang, upper(lang) FROM documents WHERE lang < 'f')
SELECT path, coalesce(arg_max(tag, length(prefix)), '') AS tag FROM t LEFT JOIN f ON path = prefix OR starts_with(path, prefix || '/') GROUP BY path""")
def source_folder_tags(spark, d):
    doc = table(spark, d, "documents")
    folders = doc.select(F.col("source").alias("prefix"), F.col("source").alias("tag")).distinct().unionByName(doc.where("lang < 'f'").select(F.expr("source || '/' || lang AS prefix"), F.expr("upper(lang) AS tag")).distinct())
    return ranges.longest_prefix(doc.select(F.expr(f"{_PATH} AS path")), folders).select("path", F.coalesce("tag", F.lit("")).alias("tag"))


@query("name_prefixes", f"WITH t AS (SELECT page_id, string_split({_PKG_SQL}, '.') AS p FROM pages) SELECT page_id, array_to_string(p[1:i], '.') AS prefix FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM t)")
def name_prefixes(spark, d):
    return _packages(spark, d).select("page_id", F.explode(names.prefixes(F.col("name"))).alias("prefix"))


@query("location_format", f"WITH {SITES_SQL} SELECT edge_id, 'at a.b.' || decl_type || '.' || sig || CASE WHEN qualifier IS NULL THEN '(Unknown Source)' ELSE '(' || decl_type || '.java:' || line || ')' END AS location FROM cs")
def location_format(spark, d):
    file = F.expr("CASE WHEN qualifier IS NOT NULL THEN 'src/a/b/' || decl_type || '.java' END")
    return ad.call_sites(spark, d).select("edge_id", names.location(F.concat(F.lit("a.b."), "decl_type"), F.col("sig"), file, F.col("line")).alias("location"))


@query("path_csv", f"WITH {SITES_SQL} SELECT caller || ',' || decl_type || '.' || sig || ',' || {_KIND_SQL} || ',1,' || caller || ',\"' || decl_type || ',' || sig || '\"' || CASE WHEN qualifier IS NULL THEN '' ELSE ',' || qualifier END AS line FROM cs")
def path_csv(spark, d):
    s = ad.call_sites(spark, d).select("caller", F.concat("decl_type", F.lit("."), "sig").alias("callee"), hierarchy.bind_kind(F.col("sig"), F.col("mods")).alias("resolved_by"), F.lit(1).alias("depth"), F.array("caller", F.concat("decl_type", F.lit(","), "sig")).alias("path"), F.col("qualifier").alias("note"))
    return reports.path_lines(s)


@query("unresolved_causes", "WITH c AS (SELECT o_custkey AS caller, o_orderpriority AS cause, count(*) AS n, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2) SELECT caller, CAST(sum(n) AS BIGINT) AS n, string_agg(cause, ';' ORDER BY first_at) AS causes FROM c GROUP BY caller")
def unresolved_causes(spark, d):
    u = table(spark, d, "orders").select(F.col("o_custkey").alias("caller"), F.col("o_orderkey").alias("line"), F.lit(0).alias("ord"), F.col("o_orderpriority").alias("cause"))
    return reports.unresolved_causes(u)


@query("field_tree", f"""WITH {ALL_CALLS_SQL}, a AS (SELECT event_type AS field, user_id AS accessor, bool_or(value >= 50) AS w, bool_or(value < 50) AS r FROM events GROUP BY 1, 2)
SELECT field, accessor, CASE WHEN w AND r THEN 'readwrite' WHEN w THEN 'write' ELSE 'read' END AS access, coalesce(caller, -1) AS caller FROM a LEFT JOIN e ON callee = accessor""")
def field_tree(spark, d):
    a = table(spark, d, "events").select(F.col("event_type").alias("field"), F.col("user_id").alias("accessor"), F.expr("CASE WHEN value >= 50 THEN 'write' ELSE 'read' END AS access"))
    return reports.field_tree(a, ad.all_calls(spark, d)).withColumn("caller", F.coalesce("caller", F.lit(-1).cast("long")))


@query("expectations", """WITH t AS (SELECT event_id, event_id % 4 AS k, event_type AS v FROM events) SELECT event_id, CASE k WHEN 0 THEN '= ' || v WHEN 1 THEN '≠ ' || v WHEN 2 THEN '∈ {' || v || ', x}' ELSE '∉ {' || v || ', x}' END AS expectation FROM t""")
def expectations(spark, d):
    op = F.get(F.array(*[F.lit(x) for x in ("EQ", "NE", "IN", "NI")]), (F.col("event_id") % 4).cast("int"))
    values = F.when(F.col("event_id") % 4 < 2, F.array("event_type")).otherwise(F.array(F.col("event_type"), F.lit("x")))
    return table(spark, d, "events").select("event_id", names.expectation(op, values).alias("expectation"))


@query("ambiguous_labels", "SELECT right(c_name, 2) AS label, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def ambiguous_labels(spark, d):
    return reports.ambiguous_labels(table(spark, d, "customer").select(F.col("c_custkey").alias("method"), F.expr("right(c_name, 2)").alias("label")))


# --- dependencies -----------------------------------------------------------------------------------------------------------------


def _dependencies(spark, d):
    """Parts by forty as artifacts, their sizes as versions; a part asks for the artifact of seven times its key."""
    part = table(spark, d, "part")
    n = part.agg((F.max("p_partkey") + 1).alias("n"))
    p = part.join(F.broadcast(n)).select(F.expr("'A' || (p_partkey div 40) AS artifact"), F.expr("'A' || (p_partkey * 7 % n div 40) AS dep"), F.expr("'1.' || (p_size % 3) AS dep_version"), F.col("p_partkey").alias("ord"))
    edges = p.withColumn("version", F.explode(F.array(F.lit("1.0"), F.lit("1.1"), F.lit("1.2")))).withColumn("exclusions", F.array().cast("array<string>"))
    return spark.createDataFrame([("A0", "1.0", 0)], "artifact string, version string, ord long"), edges


def dependency_nearest(spark, d):
    return dependencies.nearest(*_dependencies(spark, d)).withColumn("via", F.array_join("via", ">"))


def dependency_highest(spark, d):
    return dependencies.highest(*_dependencies(spark, d)).withColumn("via", F.array_join("via", ">"))


# Mediation keeps what earlier levels chose, which SQL's recursion can't: tests hold it against small cases and a walk in Python.
QUERIES["dependency_nearest"] = dependency_nearest
QUERIES["dependency_highest"] = dependency_highest


@query("unexpanded_summary", "SELECT l_suppkey AS callee, max(l_linenumber) AS max_candidates, count(DISTINCT l_orderkey) AS n_sites FROM lineitem WHERE l_linenumber > 3 GROUP BY l_suppkey")
def unexpanded_summary(spark, d):
    return reports.unexpanded_summary(table(spark, d, "lineitem").selectExpr("l_orderkey AS edge_id", "l_suppkey AS callee", "l_linenumber AS n_candidates"))


@query("methods_by_name", "SELECT p_brand AS type, 'm' || p_size AS name, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_type, p_partkey % 100, p_partkey) AS method_ids FROM part WHERE p_partkey % 4 <> 0 GROUP BY p_brand, p_size")
def methods_by_name(spark, d):
    decls = table(spark, d, "part").selectExpr("p_partkey AS method_id", "p_brand AS type", "'m' || p_size AS name", "p_type AS file", "p_partkey % 100 AS line", "p_partkey % 4 <> 0 AS has_body")
    return reports.methods_by_name(decls).withColumn("method_ids", F.array_join("method_ids", ","))


@query("inventory_stats", f"""SELECT count(*) AS n_methods, count(*) FILTER (reachable) AS n_reachable, count(*) FILTER (role = 'FRAMEWORK_ENTRY') AS n_framework_entry, count(*) FILTER (role = 'ENTRY_CANDIDATE') AS n_entry_candidate,
count(*) FILTER (role = 'ISOLATED') AS n_isolated, count(*) FILTER (role = 'LEAF') AS n_leaf, count(*) FILTER (role = 'NORMAL') AS n_normal FROM ({SQL['methods_inventory']}) AS i""")
def inventory_stats(spark, d):
    return reports.inventory_stats(methods_inventory(spark, d))
