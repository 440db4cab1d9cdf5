"""From stored facts to the graph: symbols, ids, declarations, edges, open calls, indexes, and facts that follow from other facts.

Facts of a file refer to each other by numbers of that file; tables are joined by (file, number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.hierarchy import bind_kind
from weftgraph.operators.selection import has


def with_symbols(facts: DataFrame, symbols: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(facts with `column`_key for the symbol (file, sym, type, method, params) that it refers to; references to none: file, sym, n). Facts
    with a bad reference are left out of the first and counted in the second, so that nothing goes without a word."""
    key = F.concat(F.col("type"), F.lit("#"), F.col("method"), F.lit("("), F.col("params"), F.lit(")"))
    known = symbols.select("file", F.col("sym").alias(column), key.alias(f"{column}_key"))
    j = facts.join(known, ["file", column], "left")
    bad = j.where(F.col(f"{column}_key").isNull() & F.col(column).isNotNull()).groupBy("file", F.col(column).alias("sym")).agg(F.count("*").alias("n"))
    return j.where(F.col(f"{column}_key").isNotNull() | F.col(column).isNull()), bad


def dictionary(names: DataFrame, column: str = "name", parts: int = 256) -> DataFrame:
    """(column, id): dense numbers 0 .. n-1 for the distinct names. Numbered within hash parts and offset by the parts before, so no task
    sorts them all; which name has which number means nothing."""
    d = names.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_p", F.pmod(F.xxhash64(column), F.lit(parts)))
    sizes = d.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return d.withColumn("_i", place).join(F.broadcast(before), "_p").select(column, (F.col("_b") + F.col("_i")).alias("id"))


def first_declarations(decls: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(declarations, doubles): of declarations (key, folder, path, line, ...) with one key that of the earliest source folder (folder, ord),
    then path, then line; doubles (key, path, kept) are the others."""
    w = Window.partitionBy("key").orderBy("ord", "path", "line")
    d = decls.join(folders.select("folder", "ord"), "folder").withColumn("_r", F.row_number().over(w)).withColumn("kept", F.first("path").over(w))
    return d.where("_r = 1").drop("_r", "kept", "ord"), d.where("_r > 1").select("key", "path", "kept")


def edges(calls: DataFrame) -> DataFrame:
    """`calls` (.., method, mods) with kind, the way they are bound."""
    return calls.withColumn("kind", bind_kind(F.col("method"), F.col("mods")))


def guessed_edges(unresolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, open): unresolved calls (.., caller, candidate type#method) with a caller and a candidate become edges of kind G to it; the
    others stay open."""
    usable = F.col("caller").isNotNull() & F.coalesce(F.col("candidate").rlike(r"^[^#\s]+#[^#\s]+$"), F.lit(False))
    return unresolved.where(usable).withColumn("callee", F.col("candidate")).withColumn("kind", F.lit("G")), unresolved.where(~usable)


def import_guesses(unresolved: DataFrame, imports: DataFrame) -> DataFrame:
    """`unresolved` (file, receiver, method, ..) with candidate: the method on the one imported type (file, type) of the receiver's simple
    name; null if there is none, several, or an on-demand import that could name it."""
    named = imports.where("NOT type LIKE '%.*'").select("file", F.regexp_replace("type", r"^.*\.", "").alias("receiver"), "type").distinct()
    one = named.groupBy("file", "receiver").agg(F.count("*").alias("n"), F.min("type").alias("type")).where("n = 1").drop("n")
    return unresolved.join(one, ["file", "receiver"], "left").withColumn("candidate", F.concat(F.col("type"), F.lit("#"), F.col("method"))).drop("type")


def override_index(overrides: DataFrame) -> DataFrame:
    """(of_key, of_sig, key): who overrides what, by key and by signature. overrides: (key, overridden array)."""
    return overrides.select(F.explode("overridden").alias("of_key"), "key").select("of_key", F.regexp_extract("of_key", "#(.*)$", 1).alias("of_sig"), "key").distinct()


def type_adjacency(types: DataFrame) -> DataFrame:
    """(sub, sup, known): direct supertypes of types (type, supers array, binary array of (t, sup)): their own and those that libraries' types
    among them have; known where sup is one of `types`."""
    own = types.select(F.col("type").alias("sub"), F.explode("supers").alias("sup"))
    far = types.select(F.explode("binary").alias("b")).select(F.col("b.t").alias("sub"), F.col("b.sup").alias("sup"))
    known = types.select(F.col("type").alias("sup"), F.lit(True).alias("known")).distinct()
    return own.unionByName(far).distinct().join(known, "sup", "left").select("sub", "sup", F.coalesce("known", F.lit(False)).alias("known"))


def guards_of(calls: DataFrame, guards: DataFrame) -> DataFrame:
    """(edge_id, atoms): the conditions of each guarded call (edge_id, file, guard) in order, as structs (op, subject, text, values) of guards
    (file, guard, pos, op, subject, text, values). A call without conditions has no row."""
    atoms = guards.groupBy("file", "guard").agg(F.array_sort(F.collect_list(F.struct("pos", "op", "subject", "text", "values"))).alias("a"))
    fields = F.transform("a", lambda x: F.struct(x["op"].alias("op"), x["subject"].alias("subject"), x["text"].alias("text"), x["values"].alias("values")))
    return calls.where("guard IS NOT NULL").select("edge_id", "file", "guard").join(atoms, ["file", "guard"]).select("edge_id", fields.alias("atoms"))


def functional_callees(decls: DataFrame, impls: DataFrame) -> DataFrame:
    """(key, functional): is a declaration (key) implemented by a lambda or method reference (impls: key)?"""
    hit = impls.select("key", F.lit(True).alias("functional")).distinct()
    return decls.select("key").distinct().join(hit, "key", "left").select("key", F.coalesce("functional", F.lit(False)).alias("functional"))


def duplicate_types(types: DataFrame) -> DataFrame:
    """(type, n, paths): types (type, path) that several files declare, with the files in order."""
    by = types.select("type", "path").distinct().groupBy("type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
    return by.where("n > 1")


def inbound(resolved: DataFrame) -> DataFrame:
    """(target, edge_id, caller, line): resolved calls by what they run: the table that callers are read from. Kept as rows, dealt by
    target; nothing is gathered for a target of many calls."""
    return resolved.select("target", "edge_id", "caller", "line").repartition("target")


def stores(sources: list[tuple[DataFrame, str]], path_column: str = "file") -> DataFrame:
    """The same relation of several stores as one, each store's paths under its prefix ('' for one's own)."""
    out = None
    for df, prefix in sources:
        df = df if not prefix else df.withColumn(path_column, F.concat(F.lit(prefix.rstrip("/") + "/"), F.col(path_column)))
        out = df if out is None else out.unionByName(df)
    return out


def field_accesses(store: DataFrame, owner: str, field: str) -> DataFrame:
    """(file, line, caller, access): accesses of one field: the filter reaches the scan, so only matching row groups are read."""
    return store.where((F.col("owner") == owner) & (F.col("field") == field)).select("file", "line", "caller", "access")


def external_references(refs: DataFrame, linked: DataFrame, decls: DataFrame, own: DataFrame) -> DataFrame:
    """(lib, type, sig, kind, decl): what a library's references (lib, type, sig) to one's own types (own: type) meet: EXACT, a declaration
    there; INHERITED, one further up (linked: type, sig, decl); MISSING_NOARG_CTOR, a no-argument constructor that the type no longer has.
    References to anything else have no row."""
    exact = decls.select("type", "sig", F.lit(True).alias("exact")).distinct()
    j = refs.select("lib", "type", "sig").distinct().join(own.select("type").distinct(), "type", "left_semi").join(exact, ["type", "sig"], "left").join(linked.select("type", "sig", "decl"), ["type", "sig"], "left")
    kind = F.when(F.col("exact"), "EXACT").when(F.col("sig") == "<init>()", "MISSING_NOARG_CTOR").when(F.col("decl").isNotNull(), "INHERITED")
    return j.select("lib", "type", "sig", kind.alias("kind"), F.when(F.col("exact"), F.col("type")).when(kind == "INHERITED", F.col("decl")).alias("decl")).where("kind IS NOT NULL")


def override_facts(up: DataFrame, decls: DataFrame) -> DataFrame:
    """(type, sig, of_type): declarations that override one of a supertype, transitively: the same signature, neither private, static nor a
    constructor on either side, and of package access only within its package."""
    open_ = decls.where(~has("mods", "private", "static") & ~F.col("sig").startswith("<"))
    high = open_.select(F.col("type").alias("of_type"), "sig", F.col("pkg").alias("of_pkg"), has("mods", "public", "protected").alias("open"))
    j = open_.select("type", "sig", "pkg").join(up.select(F.col("sub").alias("type"), F.col("sup").alias("of_type")), "type").join(high, ["of_type", "sig"])
    return j.where("open OR pkg = of_pkg").select("type", "sig", "of_type").distinct()


def inherited_implementations(chain: DataFrame, interfaces: DataFrame, decls: DataFrame) -> DataFrame:
    """(type, of_type, sig, by_type): interface methods that a class implements by one inherited from a superclass that isn't of the
    interface itself: the lowest class above that declares it public, where the type itself doesn't."""
    wanted = interfaces.select("type", F.col("interface").alias("of_type")).join(decls.where(~has("mods", "private", "static")).select(F.col("type").alias("of_type"), "sig"), "of_type")
    wanted = wanted.join(decls.select("type", "sig"), ["type", "sig"], "left_anti")
    bodies = decls.where(F.col("has_body") & has("mods", "public") & ~has("mods", "static")).select(F.col("type").alias("ancestor"), "sig")
    found = wanted.join(chain.where("pos > 0"), "type").join(bodies, ["ancestor", "sig"])
    below = interfaces.select(F.col("type").alias("ancestor"), F.col("interface").alias("of_type")).distinct()
    found = found.join(below, ["ancestor", "of_type"], "left_anti")
    return found.groupBy("type", "of_type", "sig").agg(F.min_by("ancestor", "pos").alias("by_type"))


def initializer_callers(sites: DataFrame, constructors: DataFrame) -> DataFrame:
    """(edge_id, type, caller): who runs a call written in an initializer (edge_id, type, static boolean): <clinit>() for static ones, else
    every constructor of the type (type, sig, delegates boolean) that calls no other, or the default one."""
    own = constructors.where("NOT delegates").select("type", F.col("sig").alias("caller"))
    fixed = sites.where("static").select("edge_id", "type", F.lit("<clinit>()").alias("caller"))
    by = sites.where("NOT static").select("edge_id", "type").join(own, "type", "left").select("edge_id", "type", F.coalesce("caller", F.lit("<init>()")).alias("caller"))
    return fixed.unionByName(by)


def implicit_iterations(loops: DataFrame) -> DataFrame:
    """(loop, pos, callee): calls that a loop over an Iterable (loop, type, is_array) makes: iterator, hasNext, next; over an array none."""
    calls = F.array(*[F.struct(F.lit(i).alias("pos"), F.concat(t, F.lit(m)).alias("callee")) for i, (t, m) in enumerate([(F.col("type"), "#iterator()"), (F.lit("java.util.Iterator"), "#hasNext()"), (F.lit("java.util.Iterator"), "#next()")])])
    return loops.where("NOT is_array").select("loop", F.explode(calls).alias("c")).select("loop", "c.pos", "c.callee")


def implicit_closes(resources: DataFrame) -> DataFrame:
    """(stmt, pos, callee): close() of the resources (stmt, ord, type) of a try statement, the last opened first."""
    place = F.row_number().over(Window.partitionBy("stmt").orderBy(F.desc("ord"))) - 1
    return resources.select("stmt", place.alias("pos"), F.concat("type", F.lit("#close()")).alias("callee"))


def implicit_members(types: DataFrame, decls: DataFrame) -> DataFrame:
    """(type, sig, mods): members nobody wrote: a class's (type, kind, mods, components array of (name, type)) default constructor where it
    has none, a record's canonical one and accessors, an enum's values() and valueOf, each unless declared."""
    c = F.col("components")
    canonical = F.concat(F.lit("<init>("), F.array_join(F.transform(c, lambda x: x["type"]), ","), F.lit(")"))
    access = F.filter(F.col("mods"), lambda m: m.isin("public", "protected", "private"))
    rows = types.select("type", "kind", access.alias("access"), canonical.alias("canonical"), c.alias("components"))
    made = rows.where("kind = 'C'").join(decls.where("sig LIKE '<init>%'").select("type"), "type", "left_anti").select("type", F.lit("<init>()").alias("sig"), F.col("access").alias("mods"))
    record = rows.where("kind = 'R'")
    made = made.unionByName(record.select("type", F.col("canonical").alias("sig"), F.col("access").alias("mods")))
    made = made.unionByName(record.select("type", F.explode(F.transform("components", lambda x: F.concat(x["name"], F.lit("()")))).alias("sig"), F.array(F.lit("public")).alias("mods")))
    enums = F.explode(F.array(F.lit("values()"), F.lit("valueOf(java.lang.String)"))).alias("sig")
    made = made.unionByName(rows.where("kind = 'E'").select("type", enums, F.array(F.lit("public"), F.lit("static")).alias("mods")))
    return made.join(decls.select("type", "sig"), ["type", "sig"], "left_anti")


def functional_keys(impls: DataFrame, up: DataFrame, decls: DataFrame) -> DataFrame:
    """(impl, key): interface methods that a lambda or method reference (impl, type, sig) implements: that of its type, and the same signature
    of the superinterfaces that declare it without a body."""
    own = impls.select("impl", F.concat_ws("#", "type", "sig").alias("key"))
    high = impls.join(up.select(F.col("sub").alias("type"), "sup"), "type").join(decls.where("NOT has_body").select(F.col("type").alias("sup"), "sig"), ["sup", "sig"])
    return own.unionByName(high.select("impl", F.concat_ws("#", "sup", "sig").alias("key"))).distinct()


def file_totals(files: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(files, errors, syntax_errors, files_with_errors, unresolved): totals over all files (file, errors, syntax_errors) and open calls (file)."""
    one = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("syntax_errors"), F.lit(0)).alias("syntax_errors"), F.count_if(F.col("errors") > 0).alias("files_with_errors"))
    return one.join(unresolved.agg(F.count("*").alias("unresolved")))
