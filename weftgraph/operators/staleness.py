"""What an update of the fact store must redo: types that changed, files that depend on them, and why.

Names are dotted; a nested type's name goes on after the outer one's, by a dot or a dollar sign. Files: (path, pkg: of the types it
declares, null if none). Dependencies: (path, dep): names of types, or `package.*`; a file without any is never touched.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.lineage import cut

REASONS = ("BY_SOURCE", "BY_LIBRARY")


def package_of_unit(path: Column) -> Column:
    """The package of a source file by its folder: a/b/C.java is in a.b; '' at the top."""
    return F.when(F.instr(path, "/") > 1, F.translate(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/", ".")).otherwise("")


def heads(name: Column, at: str = r"[.]") -> Column:
    """The proper heads of a name: of a.b.C a and a.b. `at`: what parts levels."""
    ends = F.filter(F.sequence(F.lit(2), F.greatest(F.length(name), F.lit(2))), lambda i: F.substring(name, i, F.lit(1)).rlike(f"^{at}$"))
    return F.transform(ends, lambda i: F.substring(name, F.lit(1), i - 1))


def stale_types(changed: DataFrame, type_edges: DataFrame) -> DataFrame:
    """(type): types (type) that changed and all their subtypes by (sub, sup); loops until no type is new."""
    seen = cut(changed.select("type").distinct())
    front = seen
    while True:
        below = front.join(type_edges, front.type == type_edges.sup).select(F.col("sub").alias("type")).distinct()
        front = cut(below.join(seen, "type", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def new_top_level(declared: DataFrame, before: DataFrame) -> DataFrame:
    """(pkg): packages with a top-level type (type, pkg) that was not declared before (type): it can hide names there."""
    rest = F.when(F.col("pkg") == "", F.col("type")).when(F.col("type").startswith(F.concat("pkg", F.lit("."))), F.expr("substring(type, length(pkg) + 2)"))
    return declared.join(before.select("type"), "type", "left_anti").where(rest.isNotNull() & (rest != "") & (F.instr(rest, ".") == 0)).select("pkg").distinct()


def packages_gone_or_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pkg, change): packages (pkg) of one side only: CREATED or REMOVED."""
    o, n = old.select("pkg").distinct().withColumn("o", F.lit(True)), new.select("pkg").distinct().withColumn("n", F.lit(True))
    return o.join(n, "pkg", "full_outer").where("o IS NULL OR n IS NULL").select("pkg", F.when(F.col("o").isNull(), "CREATED").otherwise("REMOVED").alias("change"))


def touched(files: DataFrame, deps: DataFrame, types: DataFrame, packages: DataFrame, moved: DataFrame | None = None, top_level: DataFrame | None = None, libraries: DataFrame | None = None) -> DataFrame:
    """(path, reason): files to redo, BY_SOURCE before BY_LIBRARY.

    A dependency is touched if it is a stale type (type), lies below one (parted by . or $), is or lies below a package that appeared or
    went (moved: pkg), or imports on demand a package of stale types (packages: pkg) or one with a new top-level type (top_level: pkg).
    All files of such a package, or of no known one, are touched too if they depend on anything. libraries: (pkg) of libraries that
    changed; '' is the unnamed one. A library's package touches names below it, names that are it or a head of it, undotted names if
    it is the unnamed one, and its own files.

    All of it is equi-joins on exploded heads of names, so it grows with the dependencies.
    """
    empty = packages.select("pkg").limit(0)
    moved, top_level, libraries = moved if moved is not None else empty, top_level if top_level is not None else empty, libraries if libraries is not None else empty
    d = deps.where("dep <> ''").select("path", "dep").distinct()
    d = d.withColumn("wide", F.col("dep").endswith(".*")).withColumn("name", F.when(F.col("dep").endswith(".*"), F.expr("substring(dep, 1, length(dep) - 2)")).otherwise(F.col("dep")))
    has_deps = files.join(d.select("path").distinct(), "path", "left_semi")
    own = d.select("path", "name")
    above = d.select("path", F.explode(heads(F.col("name"), r"[.$]")).alias("name"))
    above_dots = d.select("path", F.explode(heads(F.col("name"))).alias("name"))
    stale, gone = types.select(F.col("type").alias("name")).distinct(), moved.select(F.col("pkg").alias("name")).distinct()
    wide = packages.select("pkg").unionByName(top_level.select("pkg")).distinct().select(F.col("pkg").alias("name"))
    by_source = own.unionByName(above).join(stale, "name", "left_semi").select("path")
    by_source = by_source.unionByName(own.unionByName(above_dots).join(gone, "name", "left_semi").select("path"))
    by_source = by_source.unionByName(d.where("wide").select("path", "name").join(wide, "name", "left_semi").select("path"))
    if not top_level.isEmpty():
        by_source = by_source.unionByName(has_deps.join(top_level.select("pkg").distinct(), "pkg", "left_semi").select("path")).unionByName(has_deps.where("pkg IS NULL").select("path"))
    lib = libraries.select(F.col("pkg").alias("name")).distinct()
    lib_heads = lib.select(F.explode(F.array_union(heads(F.col("name")), F.array("name"))).alias("name")).where("name <> ''").distinct()
    by_library = above_dots.join(lib, "name", "left_semi").select("path").unionByName(own.join(lib_heads, "name", "left_semi").select("path"))
    unnamed = not libraries.where("pkg = ''").isEmpty()
    if unnamed:
        by_library = by_library.unionByName(d.where("NOT wide AND instr(name, '.') = 0").select("path"))
    if not libraries.isEmpty():
        by_library = by_library.unionByName(has_deps.join(libraries.select("pkg").distinct(), "pkg", "left_semi").select("path")).unionByName(has_deps.where("pkg IS NULL").select("path"))
    every = by_source.select("path", F.lit(0).alias("r")).unionByName(by_library.select("path", F.lit(1).alias("r")))
    return every.groupBy("path").agg(F.min("r").alias("r")).select("path", F.when(F.col("r") == 0, "BY_SOURCE").otherwise("BY_LIBRARY").alias("reason"))


def cascade(files: DataFrame, deps: DataFrame, declared: DataFrame, type_edges: DataFrame, changed: DataFrame, redeclares: DataFrame) -> DataFrame:
    """(path, round): files to redo until nothing more is stale. changed: (path) of round 0; a file whose types (declared: path, type, pkg)
    keep their declarations when it is redone stops the cascade: redeclares (path) are those that don't."""
    seen = cut(changed.select("path").distinct().withColumn("round", F.lit(0).cast("long")))
    front = seen
    for k in count(1):
        open_ = declared.join(front.join(redeclares.select("path"), "path", "left_semi") if k > 1 else front, "path", "left_semi")
        types = stale_types(open_, type_edges)
        hit = touched(files, deps, types, open_.select("pkg").distinct()).select("path")
        front = cut(hit.join(seen, "path", "left_anti").withColumn("round", F.lit(k).cast("long")))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def declaration_fingerprint(declarations: DataFrame) -> DataFrame:
    """(path, fingerprint) of what others see of a file: a digest of its declarations' lines (path, line), whatever their order."""
    return declarations.groupBy("path").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("line")), "\n").cast("binary"), 256).alias("fingerprint"))


def hierarchy_digest(types: DataFrame) -> str:
    """A digest of all types with their kind and supertypes (type, kind, supers array): one number of the whole, for comparison."""
    line = F.concat_ws("|", "type", "kind", F.array_join(F.array_sort("supers"), ","))
    # rows are summed by digest, so that nothing is gathered
    row = types.select(F.conv(F.substring(F.sha2(line.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    got = row.agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return f"{got.n}-{got.s or 0}"


def plan(diff: DataFrame, failing: DataFrame, old_digest: str, new_digest: str, paths: DataFrame) -> tuple[str, DataFrame]:
    """(mode, (path)): NONE if no file (path, change) changed; ALL if the hierarchy did; else SOME: changed files, and those that failed
    before (path), which are tried again whenever anything is redone."""
    changed = diff.where("change <> 'SAME'").select("path")
    if changed.isEmpty():
        return "NONE", changed
    if old_digest != new_digest:
        return "ALL", paths.select("path").distinct()
    return "SOME", changed.unionByName(failing.select("path")).distinct()


def reason_counts(redone: DataFrame) -> DataFrame:
    """(reason, n): how many files are redone for which reason (path, reason)."""
    return redone.groupBy("reason").agg(F.countDistinct("path").alias("n"))


def moved_while_read(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, hash): what to note of files (path, size, hash) after a run: the hash, or null where the file changed, went or came meanwhile,
    so that the next run reads it again."""
    b, a = before.select("path", F.struct("size", "hash").alias("b")), after.select("path", F.struct("size", "hash").alias("a"))
    return b.join(a, "path", "full_outer").select("path", F.when(F.col("a").eqNullSafe(F.col("b")), F.col("b.hash")).alias("hash"))


def reordered_packages(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pkg): packages that several libraries hold, and whose libraries come in another order now. Sides: (lib, ord, pkg). Libraries of
    one side only don't count: what they change is a change of the library itself."""
    both = old.select("lib", "pkg").join(new.select("lib", "pkg"), ["lib", "pkg"], "left_semi").distinct()
    o = old.join(both, ["lib", "pkg"], "left_semi").select("pkg", "lib", F.col("ord").alias("a"))
    n = new.select("pkg", "lib", F.col("ord").alias("b"))
    j = o.join(n, ["pkg", "lib"])
    # the order differs if neighbours of the old order are turned round in the new one
    w = Window.partitionBy("pkg").orderBy("a", "lib")
    return j.withColumn("next", F.lead("b").over(w)).where("next < b").select("pkg").distinct()
