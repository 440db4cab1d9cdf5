"""The text forms of results: CSV reports with their headers, tree rows, dumps of the store, diagnostics.

Each is a table of lines in order; `write_lines` writes any of them in parts, or as one file with a byte order mark for spreadsheets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import names

METHOD_COLUMNS = ["method", "declaringType", "typeKind", "file", "line", "hasBody", "inDegree", "outDegree", "role", "reachable", "unresolvedCalls", "unresolvedCause", "inHierarchy", "absentCause"]


def _cell(c: Column) -> Column:
    return F.coalesce(names.csv_field(c.cast("string")), F.lit(""))


def _flag(c: Column) -> Column:
    return F.when(c, "1").otherwise("0")


def methods_rows(methods: DataFrame, degrees: DataFrame, roles: DataFrame, reached: DataFrame, unresolved: DataFrame, shown: DataFrame, absent: DataFrame) -> DataFrame:
    """All fourteen columns of the method inventory, for methods that others can call: not constructors, initializers, lambda bodies or
    methods of anonymous types. methods: (node, method, type, kind, file, line, has_body, sig, is_lambda, anonymous); degrees: (node,
    in_degree, out_degree); roles: (node, role); reached, shown: (node); unresolved: (caller, n, causes); absent: (node, cause)."""
    own = methods.where(~F.col("is_lambda") & ~F.col("anonymous") & ~F.col("sig").startswith("<"))
    j = own.join(degrees, "node").join(roles, "node").join(reached.select("node", F.lit(True).alias("r")).distinct(), "node", "left")
    j = j.join(unresolved.select(F.col("caller").alias("node"), "n", "causes"), "node", "left").join(shown.select("node", F.lit(True).alias("s")).distinct(), "node", "left").join(absent, "node", "left")
    values = ["method", "type", "kind", "file", "line", _flag(F.col("has_body")), "in_degree", "out_degree", "role", _flag(F.col("r")), F.coalesce("n", F.lit(0)), F.coalesce("causes", F.lit("")), _flag(F.col("s")), F.when(F.col("s"), "").otherwise(F.coalesce("cause", F.lit("NOT_REACHED")))]
    return j.select(*[(F.col(v) if isinstance(v, str) else v).alias(c) for v, c in zip(values, METHOD_COLUMNS, strict=True)])


def csv_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(line) of the columns, quoted where needed; null is empty."""
    return df.select(F.array_join(F.array(*[_cell(F.col(c)) for c in columns or df.columns]), ",").alias("line"))


def tree_protocol(tree: DataFrame) -> DataFrame:
    """(line): R, depth, key, label, file, line, reason and flags, tab-parted, of tree rows (depth, key, label, file, line, reason, recursive,
    truncated, guessed, match); a key without a file has flag nosource."""
    flags = F.array_join(F.filter(F.array(*[F.when(F.col(c), c) for c in ("recursive", "truncated", "guessed", "match")], F.when(F.col("file").isNull(), "nosource")), lambda x: x.isNotNull()), ",")
    cells = [F.lit("R"), F.col("depth").cast("string"), *[names.protocol_escape(F.col(c)) for c in ("key", "label", "file")], F.coalesce(F.col("line").cast("string"), F.lit("")), names.protocol_escape(F.col("reason")), flags]
    return tree.select(F.array_join(F.array(*cells), "\t").alias("line"))


def tree_export(tree: DataFrame) -> DataFrame:
    """(depth, method, file, line, reason, note) of tree rows: the note is recursive, depth-limit or empty."""
    note = F.when(F.col("recursive"), "recursive").when(F.col("truncated"), "depth-limit").otherwise("")
    return tree.select("depth", F.col("key").alias("method"), F.coalesce("file", F.lit("")).alias("file"), "line", "reason", note.alias("note"))


def dump(facts: DataFrame, symbols: DataFrame, columns: list[str]) -> DataFrame:
    """`facts` for people: numbers of symbols (file, sym, pkg, type, method, params) in `columns` written out as four columns each."""
    for c in columns:
        own = symbols.select("file", F.col("sym").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("pkg", "type", "method", "params")])
        facts = facts.join(own, ["file", c], "left").drop(c)
    return facts


def diagnostics(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(topic, line): lines of warnings under their topics, from tables whose columns are joined by a space."""
    out = None
    for topic, df in parts:
        rows = df.select(F.lit(topic).alias("topic"), F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), " ").alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_lines(lines: DataFrame, path: str, header: str | None = None, encoding: str = "UTF-8", one_file: bool = False, bom: bool = False) -> None:
    """Write (line) as text under `path`. With `one_file` all is one file in the order of `lines`, after the header: for reports that
    people open, as one task writes it; else parts as they come, the header in one of its own. `bom` puts a byte order mark before it.
    Characters that the encoding lacks become question marks."""
    rows = lines.select("line", F.monotonically_increasing_id().alias("_at"))
    if header is not None or bom:
        first = ("\ufeff" if bom else "") + (header or "")
        rows = rows.unionByName(lines.sparkSession.createDataFrame([(first, -1)], "line string, _at long"))
    lines = rows.repartition(1).sortWithinPartitions("_at") if one_file else rows
    lines.select(F.col("line").alias("value")).write.mode("error").option("encoding", encoding).text(path)
