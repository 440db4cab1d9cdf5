"""Finding what a reader points at: methods by key or loosely, fields by a place in a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arity(key: Column) -> Column:
    """The number of parameters in a key type#name(params)."""
    params = F.trim(F.regexp_extract(key, r"\((.*)\)", 1))
    return F.when(params == "", 0).otherwise(F.size(F.split(params, ",")))


def find(methods: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, key, how): the method (key) of each wanted key: exact, or loose, the only one of that type, name and number of parameters. No
    row for what neither gives."""
    known = methods.select("key").distinct()
    exact = wanted.select("wanted").distinct().join(known, F.col("wanted") == F.col("key")).select("wanted", "key", F.lit("exact").alias("how"))
    head = r"^([^(]*)\("
    group = known.select("key", F.regexp_extract("key", head, 1).alias("head"), arity(F.col("key")).alias("n")).groupBy("head", "n").agg(F.count("*").alias("c"), F.min("key").alias("key")).where("c = 1")
    open_ = wanted.select("wanted").distinct().join(exact.select("wanted"), "wanted", "left_anti").where(F.col("wanted").rlike(r"^[^#]+#[^(]+\(.*\)"))
    loose = open_.select("wanted", F.regexp_extract("wanted", head, 1).alias("head"), arity(F.col("wanted")).alias("n")).join(group, ["head", "n"])
    return exact.unionByName(loose.select("wanted", "key", F.lit("loose").alias("how")))


def field_at(accesses: DataFrame, fields: DataFrame, methods: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, line, name, keys, how): the fields that a name at a line can be: those accessed there (access), else those that the file's
    types declare, unless the line is in a method's body (declaration). accesses: (file, line, owner, field); fields: (file, type,
    field); methods: (file, lo, hi). No row for what neither gives."""
    a = wanted.join(accesses.select("file", "line", F.col("field").alias("name"), "owner"), ["file", "line", "name"]).groupBy("file", "line", "name").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    rest = wanted.select("file", "line", "name").distinct().join(a, ["file", "line", "name"], "left_anti")
    inside = rest.alias("w").join(methods.alias("m"), (F.col("w.file") == F.col("m.file")) & F.col("w.line").between(F.col("m.lo"), F.col("m.hi"))).select("w.file", "w.line", "w.name").distinct()
    b = rest.join(inside, ["file", "line", "name"], "left_anti").join(fields.select("file", F.col("field").alias("name"), F.col("type").alias("owner")), ["file", "name"]).groupBy("file", "line", "name").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    rows = a.withColumn("how", F.lit("access")).unionByName(b.withColumn("how", F.lit("declaration")))
    return rows.select("file", "line", "name", F.transform("owners", lambda o: F.concat(o, F.lit("#"), F.col("name"))).alias("keys"), "how")
