"""The fact store: text rows of a kind and escaped columns, in versions of which the last complete one counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.names import escape_row, unescape_row

#: A null column; text that begins with a backslash is escaped to two, so no text reads as this.
NULL = "\\N"


def write_store(facts: dict[str, DataFrame], root: str, version: int) -> None:
    """Write relations by kind as a new version. The pointer to it is appended after all rows: readers see whole versions only, and a
    version that a lost job left without a pointer is never read. A version number is used once; a second write of it fails."""
    rows = [
        df.select(F.lit(kind).alias("kind"), F.array_join(F.array(*[F.coalesce(escape_row(F.col(c).cast("string")), F.lit(NULL)) for c in df.columns]), "\t").alias("value"))
        for kind, df in facts.items()
    ]
    spark = next(iter(facts.values())).sparkSession
    reduce(DataFrame.unionByName, rows).write.mode("error").partitionBy("kind").text(f"{root}/v{version}")
    spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def last_version(spark: SparkSession, root: str) -> int:
    """The last complete version; fails where no version is complete."""
    return spark.read.schema("version long").parquet(f"{root}/pointer").agg(F.max("version")).first()[0]


def read_store(spark: SparkSession, root: str, kind: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a kind, with the columns and types of `schema` ("path string, size long"); only that kind's files are read. Rows
    with another number of columns fail the job rather than shift values."""
    version = last_version(spark, root) if version is None else version
    fields = spark.createDataFrame([], schema).schema.fields
    parts = F.split("value", "\t", -1)
    text = spark.read.schema("value string, kind string").text(f"{root}/v{version}").where(F.col("kind") == kind)
    checked = text.select(F.when(F.size(parts) == len(fields), parts).otherwise(F.raise_error(F.lit(f"a {kind} row does not have {len(fields)} columns"))).alias("p"))
    cell = [F.get("p", F.lit(i)) for i in range(len(fields))]
    return checked.select(*[F.when(c != NULL, unescape_row(c)).cast(f.dataType).alias(f.name) for c, f in zip(cell, fields, strict=True)])
