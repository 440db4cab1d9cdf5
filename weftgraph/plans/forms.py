"""Queries on building, walks, conditions, names and report forms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import names
from weftgraph.operators import build, conditions, graph, selection, walk
from weftgraph.plans import facts as f
from weftgraph.plans.facts import Fact
from weftgraph.plans.program import _WORLD_SQL, _World
from weftgraph.plans.queries import _PKG_SQL, _packages, query
from weftgraph.sinks import reports as sinks
from weftgraph.sources import adapters as ad
from weftgraph.sources.adapters import EDGES_SQL, table

# --- building ---------------------------------------------------------------------------------------------------------------------

_SYMBOLS = Fact("customer", {"file": "'f' || (c_custkey % 10)", "sym": "c_custkey", "pkg": "'a'", "type": "'a.T' || c_nationkey", "method": "'m' || (c_custkey % 7)", "params": "CASE WHEN c_custkey % 2 = 0 THEN 'int' ELSE '' END"}, "c_custkey % 8 <> 0")
_REFS = Fact("orders", {"file": "'f' || (o_custkey % 10)", "caller": "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END", "edge_id": "o_orderkey"})


@query("symbol_keys", f"SELECT r.edge_id, coalesce(type || '#' || method || '(' || params || ')', '') AS key FROM {_REFS.sql} r LEFT JOIN {_SYMBOLS.sql} s ON s.file = r.file AND s.sym = r.caller WHERE s.sym IS NOT NULL OR r.caller IS NULL")
def symbol_keys(spark, d):
    good, _ = build.with_symbols(_REFS.df(spark, d), _SYMBOLS.df(spark, d), "caller")
    return good.select("edge_id", F.coalesce("caller_key", F.lit("")).alias("key"))


@query("bad_references", f"SELECT r.file, r.caller AS sym, count(*) AS n FROM {_REFS.sql} r LEFT JOIN {_SYMBOLS.sql} s ON s.file = r.file AND s.sym = r.caller WHERE s.sym IS NULL AND r.caller IS NOT NULL GROUP BY 1, 2")
def bad_references(spark, d):
    return build.with_symbols(_REFS.df(spark, d), _SYMBOLS.df(spark, d), "caller")[1]


@query("name_dictionary", "SELECT count(DISTINCT text) AS names, count(DISTINCT text) AS ids, count(DISTINCT text) - 1 AS last FROM documents")
def name_dictionary(spark, d):
    ids = build.dictionary(table(spark, d, "documents").select(F.col("text").alias("name")))
    return ids.agg(F.countDistinct("name").alias("names"), F.countDistinct("id").alias("ids"), F.max("id").alias("last"))


_DECL_ROWS = Fact("lineitem", {"key": "'k' || (l_partkey % 500)", "folder": "l_returnflag", "path": "'p' || l_suppkey", "line": "l_linenumber"}, distinct=True)
_FOLDERS_SQL = "(VALUES ('R', 0), ('A', 1), ('N', 2)) AS o(folder, ord)"


@query("first_declarations", f"SELECT key, folder, path, line FROM {_DECL_ROWS.sql} d JOIN {_FOLDERS_SQL} USING (folder) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord, path, line) = 1")
def first_declarations(spark, d):
    return build.first_declarations(_DECL_ROWS.df(spark, d), spark.createDataFrame([("R", 0), ("A", 1), ("N", 2)], "folder string, ord int"))[0].select("key", "folder", "path", "line")


_OPEN = Fact("orders", {"file": "'f' || (o_custkey % 50)", "receiver": "'T' || (o_orderkey % 12)", "method": "'m' || (o_orderkey % 5) || '()'", "caller": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'C' || o_custkey END", "edge_id": "o_orderkey"})
_IMPORTS = Fact("customer", {"file": "'f' || (c_custkey % 50)", "type": "CASE WHEN c_custkey % 11 = 0 THEN 'p' || c_nationkey || '.*' ELSE 'p' || (c_custkey % 4) || '.T' || (c_nationkey % 12) END"})
_GUESS_SQL = f"i AS (SELECT file, string_split(type, '.')[2] AS receiver, min(type) AS type FROM {_IMPORTS.sql} x WHERE type NOT LIKE '%.*' GROUP BY 1, 2 HAVING count(DISTINCT type) = 1), g AS (SELECT o.*, i.type || '#' || method AS candidate FROM {_OPEN.sql} o LEFT JOIN i USING (file, receiver))"


@query("guessed_edges", f"WITH {_GUESS_SQL} SELECT edge_id, candidate AS callee, 'G' AS kind FROM g WHERE candidate IS NOT NULL AND caller IS NOT NULL")
def guessed_edges(spark, d):
    return build.guessed_edges(build.import_guesses(_OPEN.df(spark, d), _IMPORTS.df(spark, d)))[0].select("edge_id", "callee", "kind")


@query("open_calls", f"WITH {_GUESS_SQL} SELECT edge_id FROM g WHERE candidate IS NULL OR caller IS NULL")
def open_calls(spark, d):
    return build.guessed_edges(build.import_guesses(_OPEN.df(spark, d), _IMPORTS.df(spark, d)))[1].select("edge_id")


@query("bound_edges", f"SELECT edge_id, CASE WHEN sig = '<init>' THEN 'C' WHEN list_contains(mods, 'super') THEN 'U' WHEN list_contains(mods, 'private') THEN 'P' WHEN list_contains(mods, 'static') THEN 'T' WHEN list_contains(mods, 'final') THEN 'F' WHEN list_contains(mods, 'finalclass') THEN 'L' ELSE 'V' END AS kind FROM {f.SITES.sql} s")
def bound_edges(spark, d):
    return build.edges(f.SITES.df(spark, d).withColumnRenamed("sig", "method")).select("edge_id", "kind")


@query("override_index", "SELECT DISTINCT 'T' || (l_suppkey % 40) || '#m' || (l_linenumber % 3) AS of_key, 'm' || (l_linenumber % 3) AS of_sig, 'S' || l_partkey || '#m' || (l_linenumber % 3) AS key FROM lineitem")
def override_index(spark, d):
    li = table(spark, d, "lineitem").selectExpr("'S' || l_partkey || '#m' || (l_linenumber % 3) AS key", "'T' || (l_suppkey % 40) || '#m' || (l_linenumber % 3) AS o")
    return build.override_index(li.groupBy("key").agg(F.collect_list("o").alias("overridden")))


@query("type_adjacency", f"WITH t AS (SELECT * FROM {f.PARENTS.sql} a UNION SELECT * FROM {f.IMPLEMENTS.sql} b UNION SELECT 'I' || n_nationkey, 'L' || (n_nationkey % 3) FROM nation) SELECT sub, sup, sup LIKE 'S%' AND sup IN (SELECT type FROM {f.CLASSES.sql} c) AS known FROM t")
def type_adjacency(spark, d):
    up = f.PARENTS.df(spark, d).unionByName(f.IMPLEMENTS.df(spark, d)).groupBy(F.col("sub").alias("type")).agg(F.collect_list("sup").alias("supers"))
    far = table(spark, d, "nation").select(F.lit("S1").alias("type"), F.struct(F.expr("'I' || n_nationkey AS t"), F.expr("'L' || (n_nationkey % 3) AS sup")).alias("b")).groupBy("type").agg(F.collect_list("b").alias("binary"))
    types = f.CLASSES.df(spark, d).select("type").join(up, "type", "left").join(far, "type", "left")
    return build.type_adjacency(types)


_GUARDS = Fact("lineitem", {"file": "'f' || l_orderkey", "guard": "cast(l_linenumber % 3 AS INT)", "pos": "cast(l_linenumber AS INT)", "op": "CASE WHEN l_linenumber % 2 = 0 THEN 'EQ' ELSE 'NI' END", "subject": "l_returnflag", "text": "'x == ' || l_linestatus", "values": "split(l_linestatus, ' ')"}, distinct=True)


@query("guard_atoms_in_order", f"WITH g AS {_GUARDS.sql.replace('AS values', 'AS vals')} SELECT o.o_orderkey AS edge_id, string_agg(op || subject || text, ';' ORDER BY pos, op, subject, text) AS atoms FROM orders o JOIN g ON g.file = 'f' || o.o_orderkey AND g.guard = o.o_orderkey % 3 GROUP BY 1")
def guard_atoms_in_order(spark, d):
    calls = table(spark, d, "orders").selectExpr("o_orderkey AS edge_id", "'f' || o_orderkey AS file", "cast(o_orderkey % 3 AS INT) AS guard")
    return build.guards_of(calls, _GUARDS.df(spark, d)).select("edge_id", F.array_join(F.transform("atoms", lambda a: F.concat(a["op"], a["subject"], a["text"])), ";").alias("atoms"))


@query("functional_callees", "SELECT 'T' || p_partkey AS key, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 6) AS functional FROM part")
def functional_callees(spark, d):
    return build.functional_callees(table(spark, d, "part").selectExpr("'T' || p_partkey AS key"), table(spark, d, "lineitem").where("l_linenumber = 6").selectExpr("'T' || l_partkey AS key"))


@query("types_in_several_files", "SELECT 'T' || (l_partkey % 900) AS type, count(DISTINCT l_suppkey) AS n, array_to_string(list_sort(list(DISTINCT 'f' || l_suppkey)), ',') AS paths FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def types_in_several_files(spark, d):
    return build.duplicate_types(table(spark, d, "lineitem").selectExpr("'T' || (l_partkey % 900) AS type", "'f' || l_suppkey AS path")).withColumn("paths", F.array_join("paths", ","))


@query("union_of_stores", "SELECT 'f' || s_suppkey AS file, s_nationkey AS n FROM supplier UNION ALL SELECT 'other/f' || c_custkey, c_nationkey FROM customer")
def union_of_stores(spark, d):
    return build.stores([(table(spark, d, "supplier").selectExpr("'f' || s_suppkey AS file", "s_nationkey AS n"), ""), (table(spark, d, "customer").selectExpr("'f' || c_custkey AS file", "c_nationkey AS n"), "other")])


@query("one_fields_accesses", "SELECT 'f' || l_suppkey AS file, l_linenumber AS line, 'C' || l_orderkey AS caller, CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END AS access FROM lineitem WHERE l_partkey % 20 = 3 AND l_linenumber % 4 = 1")
def one_fields_accesses(spark, d):
    store = table(spark, d, "lineitem").selectExpr("'f' || l_suppkey AS file", "l_linenumber AS line", "'C' || l_orderkey AS caller", "'T' || (l_partkey % 20) AS owner", "'x' || (l_linenumber % 4) AS field", "CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END AS access")
    return build.field_accesses(store, "T3", "x1")


_EXT = Fact("customer", {"lib": "'l' || c_nationkey", "type": "'S' || (c_custkey % 30)", "sig": "CASE WHEN c_custkey % 9 = 0 THEN '<init>()' ELSE 'm' || (c_custkey % 4) || '()' END"})


@query("external_references", f"""WITH RECURSIVE {_WORLD_SQL}, r AS (SELECT DISTINCT * FROM {_EXT.sql} x WHERE type IN (SELECT type FROM {f.CLASSES.sql} c)), l AS (SELECT r.type, r.sig, dc.type AS decl FROM (SELECT DISTINCT type, sig FROM r) r JOIN ch ON ch.type = r.type JOIN dc ON dc.type = ch.ancestor AND dc.sig = r.sig QUALIFY row_number() OVER (PARTITION BY r.type, r.sig ORDER BY pos) = 1)
SELECT lib, r.type, r.sig, CASE WHEN l.decl = r.type THEN 'EXACT' WHEN r.sig = '<init>()' THEN 'MISSING_NOARG_CTOR' ELSE 'INHERITED' END AS kind, coalesce(l.decl, '') AS decl FROM r LEFT JOIN l USING (type, sig) WHERE l.decl IS NOT NULL OR r.sig = '<init>()'""")
def external_references(spark, d):
    w, refs = _World(spark, d), _EXT.df(spark, d)
    own = w.decls.where("type LIKE 'S%'")
    none = w.faces.limit(0)
    linked = selection.resolved_declarations(refs, w.chain, none, w.up, own)
    return build.external_references(refs, linked, own, f.CLASSES.df(spark, d)).withColumn("decl", F.coalesce("decl", F.lit("")))


@query("override_facts", f"WITH RECURSIVE {_WORLD_SQL}, o AS (SELECT * FROM dc WHERE NOT list_has_any(mods, ['private', 'static'])) SELECT DISTINCT a.type, a.sig, b.type AS of_type FROM o a JOIN up ON up.sub = a.type JOIN o b ON b.type = up.sup AND b.sig = a.sig WHERE list_has_any(b.mods, ['public', 'protected']) OR a.pkg = b.pkg")
def override_facts(spark, d):
    w = _World(spark, d)
    return build.override_facts(w.up, w.decls)


@query("inherited_implementations", f"""WITH RECURSIVE {_WORLD_SQL}, w AS (SELECT fa.type, dc.type AS of_type, dc.sig FROM fa JOIN dc ON dc.type = fa.interface WHERE NOT list_has_any(mods, ['private', 'static'])), n AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM dc WHERE dc.type = w.type AND dc.sig = w.sig))
SELECT n.type, n.of_type, n.sig, arg_min(ch.ancestor, ch.pos) AS by_type FROM n JOIN ch ON ch.type = n.type AND pos > 0 JOIN dc ON dc.type = ch.ancestor AND dc.sig = n.sig AND has_body AND list_contains(mods, 'public') AND NOT list_contains(mods, 'static')
WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.type = ch.ancestor AND fa.interface = n.of_type) GROUP BY 1, 2, 3""")
def inherited_implementations(spark, d):
    w = _World(spark, d)
    return build.inherited_implementations(w.chain, w.faces, w.decls)


_INITS = Fact("orders", {"edge_id": "o_orderkey", "type": "'T' || (o_custkey % 80)", "static": "o_orderkey % 5 = 0"})
_NEW = Fact("customer", {"type": "'T' || (c_custkey % 60)", "sig": "'<init>(' || (c_custkey % 3) || ')'", "delegates": "c_custkey % 3 = 2"}, distinct=True)


@query("initializer_callers", f"SELECT i.edge_id, i.type, CASE WHEN static THEN '<clinit>()' ELSE coalesce(n.sig, '<init>()') END AS caller FROM {_INITS.sql} i LEFT JOIN {_NEW.sql} n ON n.type = i.type AND NOT i.static AND NOT n.delegates")
def initializer_callers(spark, d):
    return build.initializer_callers(_INITS.df(spark, d), _NEW.df(spark, d))


@query("implicit_iterations", "SELECT o_orderkey AS loop, pos, CASE pos WHEN 0 THEN 'a.L' || (o_custkey % 9) || '#iterator()' WHEN 1 THEN 'java.util.Iterator#hasNext()' ELSE 'java.util.Iterator#next()' END AS callee FROM orders, (VALUES (0), (1), (2)) p(pos) WHERE o_orderkey % 4 <> 0")
def implicit_iterations(spark, d):
    return build.implicit_iterations(table(spark, d, "orders").selectExpr("o_orderkey AS loop", "'a.L' || (o_custkey % 9) AS type", "o_orderkey % 4 = 0 AS is_array"))


@query("implicit_closes", "SELECT DISTINCT stmt, row_number() OVER (PARTITION BY stmt ORDER BY ord DESC) - 1 AS pos, 'R' || ord || '#close()' AS callee FROM (SELECT DISTINCT l_orderkey AS stmt, l_linenumber AS ord FROM lineitem)")
def implicit_closes(spark, d):
    return build.implicit_closes(table(spark, d, "lineitem").selectExpr("l_orderkey AS stmt", "l_linenumber AS ord", "'R' || l_linenumber AS type").distinct()).withColumn("pos", F.col("pos").cast("long"))


_KINDS = Fact("part", {"type": "'T' || p_partkey", "kind": "CASE p_partkey % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'I' ELSE 'C' END", "mods": "split('public final', ' ')"})


@query("implicit_members", f"""WITH k AS {_KINDS.sql}, d AS (SELECT 'T' || p_partkey AS type, CASE WHEN p_partkey % 4 = 0 THEN 'values()' ELSE '<init>(int)' END AS sig FROM part WHERE p_size % 3 = 0)
SELECT type, '<init>()' AS sig, 'public' AS mods FROM k WHERE kind = 'C' AND type NOT IN (SELECT type FROM d) UNION ALL SELECT k.type, m.sig, 'public static' FROM k, (VALUES ('values()'), ('valueOf(java.lang.String)')) m(sig) WHERE kind = 'E' AND NOT EXISTS (SELECT 1 FROM d WHERE d.type = k.type AND d.sig = m.sig)""")
def implicit_members(spark, d):
    kinds = _KINDS.df(spark, d).withColumn("components", F.lit(None).cast("array<struct<name:string,type:string>>"))
    declared = table(spark, d, "part").where("p_size % 3 = 0").selectExpr("'T' || p_partkey AS type", "CASE WHEN p_partkey % 4 = 0 THEN 'values()' ELSE '<init>(int)' END AS sig")
    return build.implicit_members(kinds, declared).withColumn("mods", F.array_join("mods", " "))


_IMPLS = Fact("orders", {"impl": "o_orderkey", "type": "'I' || (o_custkey % 25)", "sig": "'m' || (o_orderkey % 4) || '()'"})


@query("functional_keys", f"WITH RECURSIVE {_WORLD_SQL}, i AS {_IMPLS.sql} SELECT impl, type || '#' || sig AS key FROM i UNION SELECT impl, dc.type || '#' || i.sig FROM i JOIN up ON up.sub = i.type JOIN dc ON dc.type = up.sup AND dc.sig = i.sig AND NOT has_body")
def functional_keys(spark, d):
    w = _World(spark, d)
    return build.functional_keys(_IMPLS.df(spark, d), w.up, w.decls)


@query("file_totals", "SELECT count(*) AS files, CAST(sum(doc_id % 5) AS BIGINT) AS errors, CAST(sum(doc_id % 2) AS BIGINT) AS syntax_errors, count(*) FILTER (doc_id % 5 > 0) AS files_with_errors, (SELECT count(*) FROM events WHERE event_type = 'error') AS unresolved FROM documents")
def file_totals(spark, d):
    return build.file_totals(table(spark, d, "documents").selectExpr("doc_id AS file", "doc_id % 5 AS errors", "doc_id % 2 AS syntax_errors"), table(spark, d, "events").where("event_type = 'error'").selectExpr("user_id AS file"))


# --- walks ------------------------------------------------------------------------------------------------------------------------

#: Calls of the graph: one target by label, methods hidden or silent by number; calls by number ruled out.
_STEP_SQL = f"""{EDGES_SQL}, s AS MATERIALIZED (SELECT caller, callee, caller * 100000 + callee AS edge_id FROM e)"""


def _edge_facts(spark, d):
    e = ad.call_edges(spark, d).withColumn("edge_id", F.col("caller") * 100_000 + F.col("callee"))
    return e.select("edge_id", "caller", F.col("callee").alias("ord")), e.select("edge_id", F.lit("X").alias("label"), "callee")


def _text(path):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


@query("walk_hidden_silent", f"""WITH RECURSIVE {_STEP_SQL}, p(path, unseen, here, depth, callee, shown, cycle) AS (SELECT [node], []::BIGINT[], node, 0, node, false, false FROM (SELECT DISTINCT caller AS node FROM e WHERE caller % 6 = 1)
UNION ALL SELECT CASE WHEN s.callee % 5 = 2 THEN path ELSE list_append(path, s.callee) END, CASE WHEN s.callee % 5 = 2 THEN list_append(unseen, s.callee) ELSE unseen END, s.callee, CASE WHEN s.callee % 5 = 2 THEN depth ELSE depth + 1 END, s.callee, s.callee % 5 NOT IN (2, 4), list_contains(path, s.callee) OR list_contains(unseen, s.callee)
FROM p JOIN s ON s.caller = p.here WHERE NOT cycle AND depth < 3 AND NOT (s.callee % 5 = 2 AND (list_contains(path, s.callee) OR list_contains(unseen, s.callee))))
SELECT array_to_string(path, '>') AS path, CAST(depth AS BIGINT) AS depth, cycle FROM p WHERE shown""")
def walk_hidden_silent(spark, d):
    edges, targets = _edge_facts(spark, d)
    v = edges.select(F.col("ord").alias("method")).distinct().selectExpr("method", "method % 5 = 2 AS hidden", "method % 5 = 4 AS silent")
    rows = walk.walk(walk.steps(edges, targets), edges.where("caller % 6 = 1").select(F.col("caller").alias("node")).distinct(), v, max_depth=3)
    return rows.select(_text(F.col("path")).alias("path"), F.col("depth").cast("long").alias("depth"), "cycle")


@query("walk_pruned_fanout", f"""WITH RECURSIVE {EDGES_SQL}, g AS (SELECT caller, callee, caller * 10 + callee % 3 AS edge_id FROM e), t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY callee) AS rk, count(*) OVER (PARTITION BY edge_id) AS n, edge_id % 7 = 0 AS cut FROM g),
p(path, note, n, goes) AS (SELECT [caller, callee], CASE WHEN cut THEN 'CUT' WHEN caller = callee THEN 'CYCLE' ELSE '' END, n, n <= 1 AND NOT cut AND caller <> callee FROM t WHERE caller % 6 = 1 AND rk <= 2
UNION ALL SELECT list_append(path, t.callee), CASE WHEN cut THEN 'CUT' WHEN list_contains(path, t.callee) THEN 'CYCLE' ELSE '' END, t.n, t.n <= 1 AND NOT cut AND NOT list_contains(path, t.callee) FROM p JOIN t ON t.caller = path[-1] WHERE goes AND rk <= 2 AND len(path) <= 3)
SELECT array_to_string(path, '>') AS path, note, n FROM p""")
def walk_pruned_fanout(spark, d):
    e = ad.call_edges(spark, d).withColumn("edge_id", F.col("caller") * 10 + F.col("callee") % 3)
    edges = e.select("edge_id", "caller", F.col("edge_id").alias("ord")).distinct()
    pruned = edges.where("edge_id % 7 = 0").select("edge_id", F.lit("CUT").alias("reason"))
    none = e.select(F.col("callee").alias("method"), F.lit(False).alias("hidden"), F.lit(False).alias("silent")).distinct()
    step = walk.steps(edges, e.select("edge_id", F.lit("CHA").alias("label"), "callee"), pruned=pruned, expand=1, listed=2)
    rows = walk.walk(step, edges.where("caller % 6 = 1").select(F.col("caller").alias("node")).distinct(), none, max_depth=3)
    return rows.select(_text(F.col("path")).alias("path"), F.coalesce("unreachable", F.when(F.col("cycle"), "CYCLE"), F.lit("")).alias("note"), "n")


@query("walk_first_rows", f"""WITH RECURSIVE {_STEP_SQL}, p(path, depth) AS (SELECT [caller, callee], 1 FROM s UNION ALL SELECT list_append(path, callee), depth + 1 FROM p JOIN s ON caller = path[-1] WHERE NOT list_contains(path[:-2], path[-1]) AND depth < 2) SELECT array_to_string(path, '>') AS path FROM p ORDER BY p.path LIMIT 50""")
def walk_first_rows(spark, d):
    edges, targets = _edge_facts(spark, d)
    none = edges.select(F.col("ord").alias("method"), F.lit(False).alias("hidden"), F.lit(False).alias("silent")).distinct()
    rows = walk.walk(walk.steps(edges, targets), edges.select(F.col("caller").alias("node")).distinct(), none, max_depth=2, max_rows=50)
    return rows.select(_text(F.col("path")).alias("path"))


@query("lambda_collapse", f"WITH RECURSIVE {EDGES_SQL}, r(caller, callee) AS (SELECT caller, callee FROM e WHERE caller % 4 <> 1 UNION SELECT r.caller, e.callee FROM r JOIN e ON e.caller = r.callee WHERE r.callee % 4 = 1) SELECT caller, callee FROM r WHERE callee % 4 <> 1")
def lambda_collapse(spark, d):
    e = ad.call_edges(spark, d)
    return walk.collapse_lambdas(e, e.select(F.explode(F.array("caller", "callee")).alias("node")).where("node % 4 = 1").distinct())


_ENTRY = Fact("events", {"method": "user_id", "has_body": "user_id % 9 <> 0", "is_lambda": "user_id % 7 = 0", "in_source": "user_id % 5 <> 0"}, distinct=True)


@query("entry_selection", f"WITH {EDGES_SQL}, m AS (SELECT * FROM {_ENTRY.sql} x WHERE in_source AND NOT is_lambda) SELECT method, CASE WHEN method % 17 = 0 THEN 'FRAMEWORK' ELSE 'NOT_CALLED' END AS why FROM m WHERE method % 17 = 0 OR has_body AND method NOT IN (SELECT callee FROM e)")
def entry_selection(spark, d):
    m = _ENTRY.df(spark, d)
    return walk.select_entries(m, ad.call_edges(spark, d), m.where("method % 17 = 0").select("method")).withColumnRenamed("by", "why")


_NOTE = Fact("events", {"event_id": "event_id", "cycle": "event_id % 11 = 0", "unreachable": "CASE WHEN event_id % 23 = 0 THEN '[UNREACHABLE] x' END", "label": "CASE event_id % 6 WHEN 0 THEN 'CHA' WHEN 1 THEN 'NO_IMPL' WHEN 2 THEN 'DATAFLOW_LAMBDA' WHEN 3 THEN 'EXTERNAL_GUESS' WHEN 4 THEN 'CALLBACK' ELSE 'NO_OVERRIDE' END", "n": "CASE WHEN event_id % 6 = 0 THEN 2 + user_id % 30 ELSE 1 END", "src": "event_id % 7 <> 0", "deep": "event_id % 13 = 0", "recv": "CASE event_id % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'P' WHEN 2 THEN 'L' ELSE 'O' END", "fun": "event_id % 29 = 0"})


@query("step_notes", f"""SELECT event_id, concat_ws(' / ', CASE WHEN unreachable IS NOT NULL THEN unreachable WHEN cycle THEN '[UNEXPANDED:CYCLE] returns to a method already on this path' WHEN label = 'EXTERNAL_GUESS' THEN '[EXTERNAL] type guessed from an import (unverified)' WHEN NOT src THEN '[EXTERNAL] no source to follow' WHEN deep THEN '[UNEXPANDED:DEPTH] depth limit (50) reached' END,
CASE WHEN n > 1 THEN CASE WHEN n <= 3 THEN '[CANDIDATE:CHA] ' ELSE '[UNEXPANDED:CHA] ' END || n || ' candidates: ' || CASE recv WHEN 'F' THEN 'field' WHEN 'P' THEN 'parameter (passed in from outside the method)' WHEN 'L' THEN 'local variable' ELSE 'receiver unknown' END || CASE WHEN n > 20 THEN ' (only the first 20 are written as rows)' ELSE '' END
WHEN label = 'DATAFLOW_LAMBDA' THEN NULL WHEN fun THEN '[UNEXPANDED:LAMBDA] implemented by a lambda/method reference (which one runs is undetermined)' WHEN label = 'NO_IMPL' THEN '[UNEXPANDED:NO_IMPL] no implementation with a body in the source' WHEN label = 'CALLBACK' THEN '[RESOLVED:CALLBACK]' END) AS note FROM {_NOTE.sql} x""")
def step_notes(spark, d):
    c = F.col
    return _NOTE.df(spark, d).select("event_id", walk.note(c("cycle"), c("unreachable"), c("label"), c("n"), c("src"), c("deep"), c("recv"), c("fun"), F.lit(0)).alias("note"))


@query("open_call_causes", f"SELECT event_id, coalesce(CASE WHEN n > 1 THEN CASE WHEN n <= 3 THEN '[CANDIDATE:CHA] ' ELSE '[UNEXPANDED:CHA] ' END || CASE recv WHEN 'F' THEN 'field' WHEN 'P' THEN 'parameter (passed in from outside the method)' WHEN 'L' THEN 'local variable' ELSE 'receiver unknown' END WHEN fun THEN '[UNEXPANDED:LAMBDA] implemented by a lambda/method reference' WHEN label = 'NO_IMPL' THEN '[UNEXPANDED:NO_IMPL] no implementation with a body in the source' END, '') AS cause FROM {_NOTE.sql} x")
def open_call_causes(spark, d):
    c = F.col
    return _NOTE.df(spark, d).select("event_id", F.coalesce(walk.unresolved_cause(c("label"), c("n"), c("fun"), c("recv")), F.lit("")).alias("cause"))


@query("arguments_in_order", "SELECT l_orderkey AS node, string_agg('a' || l_suppkey, ',' ORDER BY l_linenumber % 3, l_linenumber, 'a' || l_suppkey) AS args FROM lineitem GROUP BY 1")
def arguments_in_order(spark, d):
    a = table(spark, d, "lineitem").selectExpr("l_orderkey AS node", "l_linenumber % 3 AS pos", "l_linenumber AS seq", "'a' || l_suppkey AS arg")
    return walk.in_argument_order(a).withColumn("args", F.array_join("args", ","))


_ROWS = Fact("orders", {"folder": "o_orderpriority", "file": "'f' || (o_custkey % 20)", "line": "o_orderkey % 100", "ord": "o_orderkey", "key": "'k' || o_orderkey"})


@query("rows_in_source_order", f"WITH x AS (SELECT key, row_number() OVER (ORDER BY folder, file, line, ord, key) AS n FROM {_ROWS.sql} r) SELECT key FROM x WHERE n <= 100")
def rows_in_source_order(spark, d):
    folders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("folder")).distinct().withColumn("place", F.substring("folder", 1, 1).cast("int"))
    return walk.source_order(_ROWS.df(spark, d), folders).select("key").limit(100)


@query("open_calls_by_file_rank", f"WITH x AS (SELECT key, row_number() OVER (ORDER BY (CAST(substring(file, 2) AS BIGINT) * 7) % 20, file, line, ord) AS n FROM {_ROWS.sql} r) SELECT key FROM x WHERE n <= 100")
def open_calls_by_file_rank(spark, d):
    rows = _ROWS.df(spark, d)
    files = rows.select("file").distinct().withColumn("rank", F.expr("(cast(substring(file, 2) AS BIGINT) * 7) % 20"))
    return walk.unresolved_order(rows, files).select("key").limit(100)


@query("call_sites_of_edges", "SELECT o_orderkey AS edge_id, 'C' || o_custkey AS caller, 'f' || (o_custkey % 9) AS file, o_orderkey % 100 AS line FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5)")
def call_sites_of_edges(spark, d):
    e = table(spark, d, "orders").selectExpr("o_orderkey AS edge_id", "'C' || o_custkey AS caller", "'f' || (o_custkey % 9) AS file", "o_orderkey % 100 AS line")
    return walk.edge_sites(e, table(spark, d, "lineitem").where("l_linenumber = 5").select(F.col("l_orderkey").alias("edge_id")))


_TREE = f"""WITH RECURSIVE {EDGES_SQL}, p(path) AS (SELECT [caller, callee] FROM e WHERE caller % 6 = 1 UNION ALL SELECT list_append(path, callee) FROM p JOIN e ON caller = path[-1] WHERE len(path) = 2),
r AS (SELECT DISTINCT path, len(path) - 1 AS depth, 'K' || path[-1] AS key, path[-1] % 7 = 3 AS test, path[-1] % 11 = 5 AS guessed FROM p), ok AS (SELECT * FROM r WHERE NOT test AND NOT guessed AND (len(path) = 2 OR NOT (path[2] % 7 = 3 OR path[2] % 11 = 5)))"""


@query("filtered_tree", f"{_TREE} SELECT DISTINCT array_to_string(a.path, '>') AS path, a.key FROM ok a WHERE a.key LIKE '%4%' OR EXISTS (SELECT 1 FROM ok b WHERE len(b.path) = 3 AND b.path[:2] = a.path AND b.key LIKE '%4%')")
def filtered_tree(spark, d):
    e = ad.call_edges(spark, d)
    one = e.where("caller % 6 = 1").select(F.array("caller", "callee").alias("path"))
    two = one.join(e, F.element_at("path", -1) == e.caller).select(F.concat("path", F.array("callee")).alias("path"))
    tree = one.unionByName(two).withColumn("last", F.element_at("path", -1))
    tree = tree.select(F.transform("path", lambda x: x.cast("string")).alias("path"), (F.size("path") - 1).alias("depth"), F.concat(F.lit("K"), "last").alias("key"), F.when(F.col("last") % 7 == 3, "src/test/X.java").otherwise("src/X.java").alias("file"), (F.col("last") % 11 == 5).alias("guessed"))
    return walk.tree_filters(tree, text="4", tests=False, guessed=False, most=1 << 30).select(F.array_join("path", ">").alias("path"), "key")


# --- conditions and names -----------------------------------------------------------------------------------------------------------

_ATOMS = Fact("lineitem", {"edge_id": "l_orderkey", "pos": "cast(l_linenumber AS INT)", "op": "CASE l_linenumber % 3 WHEN 0 THEN 'EQ' WHEN 1 THEN 'NE' ELSE 'UK' END", "subject_kind": "l_returnflag", "text": "'x  == ' || l_linestatus", "values": "split(l_linestatus, ' ')"}, "l_orderkey % 3 <> 0", distinct=True)
_COND_SQL = f"""a AS {_ATOMS.sql.replace('AS values', 'AS vals')}, c AS (SELECT o_orderkey AS edge_id, max(pos) OVER (PARTITION BY o_orderkey) - pos + 1 AS cond, op <> 'UK' AS decidable, replace(text, '  ', ' ') AS text, CASE WHEN op <> 'UK' THEN subject_kind ELSE '' END AS subject_kind, CASE op WHEN 'EQ' THEN '= ' || vals[1] WHEN 'NE' THEN '≠ ' || vals[1] ELSE '' END AS expectation FROM orders LEFT JOIN a ON a.edge_id = o_orderkey)"""


def _conditions(spark, d):
    return conditions.conditions(table(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id")), _ATOMS.df(spark, d))


@query("conditions_of_calls", f"WITH {_COND_SQL} SELECT edge_id, coalesce(CAST(cond AS BIGINT), 0) AS cond, coalesce(decidable, false) AS decidable, coalesce(text, '') AS text, CASE WHEN cond IS NULL THEN '' ELSE subject_kind END AS subject_kind, CASE WHEN cond IS NULL THEN '' ELSE expectation END AS expectation FROM c")
def conditions_of_calls(spark, d):
    return _conditions(spark, d).select("edge_id", F.coalesce("cond", F.lit(0)).alias("cond"), F.coalesce("decidable", F.lit(False)).alias("decidable"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "subject_kind", "expectation")])


@query("condition_states", f"WITH {_COND_SQL} SELECT edge_id, CASE WHEN count(cond) = 0 THEN 'none' WHEN bool_and(decidable) THEN 'decidable' ELSE 'undecidable' END AS state FROM c GROUP BY edge_id")
def condition_states(spark, d):
    return conditions.condition_states(_conditions(spark, d))


@query("condition_csv", f"WITH {_COND_SQL} SELECT 'f,' || (edge_id % 9) || ',a,b,' || coalesce(CAST(cond AS VARCHAR), '') || ',' || CASE WHEN cond IS NULL THEN '' WHEN decidable THEN '1' ELSE '0' END || ',' || coalesce(text, '') || ',' || CASE WHEN cond IS NULL THEN '' ELSE subject_kind END || ',' || CASE WHEN cond IS NULL THEN '' ELSE expectation END AS line FROM c")
def condition_csv(spark, d):
    sites = table(spark, d, "orders").selectExpr("o_orderkey AS edge_id", "'f' AS file", "o_orderkey % 9 AS line", "'a' AS caller", "'b' AS callee")
    return conditions.report_lines(sites, _conditions(spark, d))


_GUARD = Fact("events", {"edge_id": "event_id", "op": "CASE event_id % 5 WHEN 0 THEN 'EQ' WHEN 1 THEN 'NE' WHEN 2 THEN 'IN' WHEN 3 THEN 'NI' ELSE 'ZZ' END", "text": "'c'", "values": "split(CASE WHEN event_id % 2 = 0 THEN 'click view' ELSE 'click' END, ' ')", "subject_kind": "CASE WHEN user_id % 4 = 0 THEN 'A' ELSE 'V' END", "subject": "event_type"})


@query("unreachable_calls", f"WITH g AS {_GUARD.sql.replace('AS values', 'AS vals')} SELECT edge_id, '[UNREACHABLE] c is false: ' || subject AS reason FROM g WHERE subject_kind = 'V' AND (op IN ('EQ', 'IN') AND NOT list_contains(vals, subject) OR op IN ('NE', 'NI') AND list_contains(vals, subject))")
def unreachable_calls(spark, d):
    return conditions.unreachable(_GUARD.df(spark, d))


@query("sites_of_a_target", "SELECT o_orderkey AS edge_id FROM orders WHERE o_custkey % 10 = 3 AND o_orderkey % 4 = 1")
def sites_of_a_target(spark, d):
    sites = table(spark, d, "orders").selectExpr("o_orderkey AS edge_id", "'src/a/b/T' || (o_custkey % 10) || '.java' AS file", "o_orderkey % 50 AS line", "'m' || (o_orderkey % 4) AS caller_method")
    return conditions.matching_sites(sites, "a.b.T3.Inner#m1").select("edge_id")


_METHODS = Fact("part", {"id": "p_partkey", "pkg": "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'a.b' END", "type": "CASE WHEN p_partkey % 5 = 0 THEN 'Top' || (p_partkey % 9) ELSE 'a.b.Out' || (p_partkey % 9) || '.In' END", "method": "CASE WHEN p_partkey % 4 = 0 THEN '<init>' ELSE 'm' END", "params": "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'java.lang.String' ELSE 'x.Y[],int' END"})
_LABEL_SQL = f"""m AS {_METHODS.sql}, n AS (SELECT *, CASE WHEN pkg = '' THEN type ELSE substring(type, length(pkg) + 2) END AS st, CASE params WHEN 'java.lang.String' THEN 'String' WHEN 'x.Y[],int' THEN 'Y[],int' ELSE '' END AS sp FROM m), o AS (SELECT *, CASE WHEN method = '<init>' THEN string_split(st, '.')[-1] ELSE method END AS dm FROM n)"""


@query("method_labels", f"WITH {_LABEL_SQL} SELECT id, st || '.' || dm AS label, st || '.' || dm || '(' || CASE WHEN id % 2 = 0 THEN params ELSE sp END || ')' AS with_params, type || '.' || dm || '(' || params || ')' AS signature, type || '.' || dm || '(' || CASE WHEN id % 2 = 0 THEN params ELSE sp END || ')' AS display FROM o")
def method_labels(spark, d):
    c, odd = F.col, F.col("id") % 2 == 0
    t, p, m, a = c("type"), c("pkg"), c("method"), c("params")
    return _METHODS.df(spark, d).select("id", names.label(t, p, m).alias("label"), names.label_with_params(t, p, m, a, odd).alias("with_params"), names.full_signature(t, p, m, a).alias("signature"), names.display_label(t, p, m, a, odd).alias("display"))


@query("parameter_lists", f"SELECT id, CASE params WHEN '' THEN 0 WHEN 'java.lang.String' THEN 1 ELSE 2 END AS n, coalesce(CASE params WHEN 'x.Y[],int' THEN 'int' END, '') AS second, false AS array_last FROM {_METHODS.sql} m")
def parameter_lists(spark, d):
    a = F.col("params")
    return _METHODS.df(spark, d).select("id", names.param_count(a).alias("n"), F.coalesce(names.param_at(a, 1), F.lit("")).alias("second"), names.last_is_array(a).alias("array_last"))


@query("token_values", "SELECT p_partkey AS id, p_partkey % 3 = 0 AS has_q, CASE WHEN p_partkey % 3 = 0 THEN 'v' || p_size ELSE '-' END AS q, p_partkey % 3 <> 1 AS only FROM part")
def token_values(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN array('public', 'q=v' || p_size) WHEN 1 THEN array('zz') ELSE array('public') END AS t")
    c = F.col("t")
    return t.select("id", names.has_token(c, "q").alias("has_q"), F.coalesce(names.token_value(c, "q"), F.lit("-")).alias("q"), names.only_among(c, ["public", "q"]).alias("only"))


@query("unit_packages", "SELECT doc_id, source || '.' || lang AS pkg, source || '/' || lang || '/T' || doc_id || '.java' AS file FROM documents")
def unit_packages(spark, d):
    x = table(spark, d, "documents").selectExpr("doc_id", "source || '/' || lang || '/T' || doc_id || '.java' AS path", "source || '.' || lang || '.T' || doc_id || '.In' AS type")
    return x.select("doc_id", names.package_of_unit(F.col("path")).alias("pkg"), names.type_to_path(F.col("type")).alias("file"))


@query("guard_texts", r"SELECT doc_id, substring(trim(regexp_replace(text[:500], '[ \t\n\r\x0b\f]+', ' ', 'g'), ' '), 1, 60) AS t FROM documents WHERE text IS NOT NULL")
def guard_texts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", names.guard_text(F.substring("text", 1, 500)).alias("t"))


@query("protocol_fields", r"SELECT conv_id, turn, replace(replace(replace(replace(coalesce(text, ''), '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS field FROM conversations")
def protocol_fields(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", names.protocol_escape(F.col("text")).alias("field"))


@query("method_patterns", f"WITH t AS (SELECT page_id, {_PKG_SQL} AS name FROM pages) SELECT page_id, regexp_matches(name, '^com\\.example\\.[^.$]*e[^.$]*$') AND page_id % 3 = 1 AS matched, name NOT LIKE '%.%' AS unnamed, false AS never FROM t")
def method_patterns(spark, d):
    p = _packages(spark, d).withColumn("m", F.concat(F.lit("m"), F.col("page_id") % 3))
    n, m = F.col("name"), F.col("m")
    return p.select("page_id", names.method_glob_match(n, m, "com.example.*e*#m1").alias("matched"), names.method_glob_match(n, m, ".**").alias("unnamed"), names.method_glob_match(n, m, "com.example.**#m*").alias("never"))


# --- report forms -----------------------------------------------------------------------------------------------------------------


@query("methods_csv", f"""WITH {EDGES_SQL}, v AS (SELECT caller AS node FROM e UNION SELECT callee FROM e), dg AS (SELECT node, (SELECT count(*) FROM e WHERE callee = node) AS i, (SELECT count(*) FROM e WHERE caller = node) AS o FROM v)
SELECT 'T.m' || node || '(),T,C,T.java,' || node || ',1,' || i || ',' || o || ',' || CASE WHEN node % 17 = 0 THEN 'FRAMEWORK_ENTRY' WHEN i = 0 AND o = 0 THEN 'ISOLATED' WHEN i = 0 THEN 'ENTRY_CANDIDATE' WHEN o = 0 THEN 'LEAF' ELSE 'NORMAL' END || ',' || CASE WHEN node % 2 = 0 THEN 1 ELSE 0 END || ',' || CASE WHEN node % 10 = 0 THEN '3,c' ELSE '0,' END || ',' || CASE WHEN node % 3 = 0 THEN '1,' ELSE '0,' || CASE WHEN node % 5 = 0 THEN 'CHA' ELSE 'NOT_REACHED' END END AS line FROM dg WHERE node % 13 <> 0""")
def methods_csv(spark, d):
    e = ad.call_edges(spark, d)
    v = e.select(F.col("caller").alias("node")).unionByName(e.select(F.col("callee").alias("node"))).distinct()
    m = v.selectExpr("node", "'T.m' || node || '()' AS method", "'T' AS type", "'C' AS kind", "'T.java' AS file", "node AS line", "true AS has_body", "CASE WHEN node % 13 = 0 THEN '<init>()' ELSE 'm()' END AS sig", "false AS is_lambda", "false AS anonymous")
    degree = graph.degrees(e, v)
    rows = sinks.methods_rows(m, degree, graph.roles(degree, v.where("node % 17 = 0")), v.where("node % 2 = 0"), v.where("node % 10 = 0").selectExpr("node AS caller", "3 AS n", "'c' AS causes"), v.where("node % 3 = 0"), v.where("node % 5 = 0").selectExpr("node", "'CHA' AS cause"))
    return sinks.csv_lines(rows)


_TREE_ROWS = Fact("events", {"depth": "event_id % 4", "key": "'k' || event_id", "label": "event_type", "file": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'f' || user_id END", "line": "user_id", "reason": "CASE WHEN event_id % 5 = 0 THEN 'CHA' END", "recursive": "event_id % 7 = 0", "truncated": "event_id % 11 = 0", "guessed": "event_id % 13 = 0", "match": "event_id % 17 = 0"})


@query("tree_rows", f"""SELECT concat('R', chr(9), depth, chr(9), key, chr(9), label, chr(9), coalesce(file, ''), chr(9), line, chr(9), coalesce(reason, ''), chr(9), concat_ws(',', CASE WHEN recursive THEN 'recursive' END, CASE WHEN truncated THEN 'truncated' END, CASE WHEN guessed THEN 'guessed' END, CASE WHEN match THEN 'match' END, CASE WHEN file IS NULL THEN 'nosource' END)) AS line FROM {_TREE_ROWS.sql} t""")
def tree_rows(spark, d):
    return sinks.tree_protocol(_TREE_ROWS.df(spark, d))


@query("tree_export", f"SELECT depth, key AS method, coalesce(file, '') AS file, line, coalesce(reason, '') AS reason, CASE WHEN recursive THEN 'recursive' WHEN truncated THEN 'depth-limit' ELSE '' END AS note FROM {_TREE_ROWS.sql} t")
def tree_export(spark, d):
    return sinks.tree_export(_TREE_ROWS.df(spark, d)).withColumn("reason", F.coalesce("reason", F.lit("")))


@query("store_dump", f"SELECT r.edge_id, coalesce(s.pkg, '') AS pkg, coalesce(s.type, '') AS type, coalesce(s.method, '') AS method, coalesce(s.params, '') AS params FROM {_REFS.sql} r LEFT JOIN {_SYMBOLS.sql} s ON s.file = r.file AND s.sym = r.caller")
def store_dump(spark, d):
    return sinks.dump(_REFS.df(spark, d), _SYMBOLS.df(spark, d), ["caller"]).select("edge_id", *[F.coalesce(f"caller_{x}", F.lit("")).alias(x) for x in ("pkg", "type", "method", "params")])


@query("diagnostics", "SELECT 'double' AS topic, text || ' ' || n AS line FROM (SELECT lang AS text, count(*) AS n FROM documents GROUP BY lang) UNION ALL SELECT 'supplier', s_suppkey || '' FROM supplier WHERE s_acctbal < 0")
def diagnostics(spark, d):
    a = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return sinks.diagnostics([("double", a), ("supplier", table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey"))])
