"""Conditions of calls: which calls a target names, what guards say of them, and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import names

_OPS = {"EQ": "=", "NE": "≠", "IN": "∈", "NI": "∉"}


def parse_target(spec: str) -> tuple[str, int | None, str | None]:
    """(path suffix, line, method) of `path[:line]`, `Type[#method]` or both; a type stands for its source file."""
    rest, _, method = spec.strip().replace("\\", "/").partition("#")
    head, colon, line = rest.rpartition(":")
    number = int(line) if len(head) > 1 and colon and line.isdigit() else None
    rest = head if number is not None else rest
    if not rest.endswith(".java"):
        levels: list[str] = []
        for level in rest.split("$")[0].split("."):
            levels.append(level)
            if level[:1].isupper():
                break
        rest = "/".join(levels) + ".java"
    return rest, number, method or None


def matching_sites(sites: DataFrame, spec: str) -> DataFrame:
    """The call sites (file, line, caller_method, ..) that a target names: the file is the path or ends with it, line and method if given."""
    path, line, method = parse_target(spec)
    file = F.translate("file", "\\", "/")
    hit = (file == path) | file.endswith("/" + path)
    if line is not None:
        hit = hit & (F.col("line") == line)
    if method is not None:
        hit = hit & (F.col("caller_method") == method)
    return sites.where(hit)


def conditions(calls: DataFrame, atoms: DataFrame) -> DataFrame:
    """(edge_id, cond, decidable, text, subject_kind, expectation): the conditions of calls (edge_id), from the outermost (cond 1) inwards;
    one row with a null cond for a call without any. atoms: (edge_id, pos from the innermost, op, subject_kind, text, values); ops other
    than EQ, NE, IN and NI can't be decided."""
    decidable = F.col("op").isin(*_OPS)
    last = atoms.groupBy("edge_id").agg(F.max("pos").alias("last"))
    a = atoms.join(last, "edge_id").select(
        "edge_id", (F.col("last") - F.col("pos") + 1).cast("long").alias("cond"), decidable.alias("decidable"), names.guard_text(F.col("text")).alias("text"),
        F.when(decidable, F.col("subject_kind")).otherwise("").alias("subject_kind"), F.coalesce(names.expectation(F.col("op"), F.col("values")), F.lit("")).alias("expectation"),
    )
    return calls.select("edge_id").distinct().join(a, "edge_id", "left")


def condition_states(rows: DataFrame) -> DataFrame:
    """(edge_id, state): decidable if all conditions are, undecidable if one isn't, none without any."""
    by = rows.groupBy("edge_id").agg(F.count("cond").alias("n"), F.min("decidable").alias("all_"))
    return by.select("edge_id", F.when(F.col("n") == 0, "none").when(F.col("all_"), "decidable").otherwise("undecidable").alias("state"))


def unreachable(guards: DataFrame, env: DataFrame | None = None) -> DataFrame:
    """(edge_id, reason): calls that a guard rules out: some atom's subject is known, as a constant or as what the path binds to the parameter
    (env: ctx, index, tag, value; then by ctx), and breaks it. guards: (edge_id, op, text, values, subject_kind V or A, subject: the
    constant, or the parameter's index). Unknown subjects and ops rule nothing out."""
    g = guards
    keys = ["edge_id"]
    if env is not None:
        known = env.where(F.col("tag").isin("LITERAL", "CLASS", "CONST")).select("ctx", F.col("index").cast("string").alias("subject"), F.col("value").alias("bound"))
        by_param = g.where("subject_kind = 'A'").join(known, "subject").withColumn("actual", F.col("bound")).drop("bound")
        by_const = g.where("subject_kind = 'V'").withColumn("actual", F.col("subject"))
        every = env.select("ctx").distinct()
        g = by_param.unionByName(by_const.join(every.withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one")).drop("_one"))
        keys = ["ctx", "edge_id"]
    else:
        g = g.where("subject_kind = 'V'").withColumn("actual", F.col("subject"))
    inside = F.array_contains("values", F.col("actual"))
    bad = F.when(F.col("op").isin("EQ", "IN"), ~inside).when(F.col("op").isin("NE", "NI"), inside)
    reason = F.concat(F.lit("[UNREACHABLE] "), F.col("text"), F.lit(" is false: "), F.col("actual"))
    return g.where(F.coalesce(bad, F.lit(False))).groupBy(*keys).agg(F.min(reason).alias("reason"))


def report_lines(sites: DataFrame, rows: DataFrame) -> DataFrame:
    """(line): call-conditions rows of sites (edge_id, file, line, caller, callee): file, line, caller, callee, condition's number, decidable,
    text, subject's kind, expectation."""
    flag = F.when(F.col("decidable"), "1").when(~F.col("decidable"), "0").otherwise("")
    cells: list[Column] = [names.csv_field(F.col("file")), F.col("s.line").cast("string"), names.csv_field(F.col("caller")), names.csv_field(F.col("callee"))]
    cells += [F.coalesce(F.col("cond").cast("string"), F.lit("")), flag] + [names.csv_field(F.coalesce(c, F.lit(""))) for c in ("text", "subject_kind", "expectation")]
    return sites.alias("s").join(rows, "edge_id").select(F.array_join(F.array(*cells), ",").alias("line"))
