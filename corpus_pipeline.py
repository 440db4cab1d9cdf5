"""A corpus pipeline of the subpackage llm's operators: quality rules, near duplicates, decontamination, mixing, training order.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, but the last, which returns the sequences in training
order. Stages decide on each row by itself: they number the rows they are given, so null and repeated doc_ids are like others. Null and
empty texts and empty tables are as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.decontaminate import decontaminate
from weftgraph.llm.mixing import mix_sources
from weftgraph.llm.ngram_join import ngram_jaccard_join
from weftgraph.llm.quality import quality_rules, trusted_ids
from weftgraph.llm.shared import materialise
from weftgraph.llm.training_order import training_order

#: Ids up to so many are broadcast to the texts; beyond that both sides are shuffled.
BROADCAST_IDS = 2_000_000


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with _row, a number of each row's own, by its place in the files: the same whenever a plan reads them again. Rows that
    don't come from files as they are get written first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = materialise(docs, "rows")
    rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = sorted(r[0] for r in rows.select("_file").distinct().collect())
    places = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "_file string, _place long")
    return rows.join(F.broadcast(places), "_file").withColumn("_row", F.shiftleft("_place", 40) + F.col("_at")).select(*docs.columns, "_row")


def _without(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    ids = materialise(ids.select("_row"), name)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "_row", "left_anti").drop("_row")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))).where("kept").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of five-word shingle similarity 0.8 or more one row stays, of the smallest id; null comes last."""
    rows = _numbered(docs)
    more = materialise(ngram_jaccard_join(rows, id_col="_row", k=5, num=80).where("_row <> component_id").select("_row", "component_id"), "copies")
    members = more.unionByName(more.select(F.col("component_id").alias("_row"), "component_id").distinct())
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    stay = members.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("first")).select(F.col("first._row").alias("_row"))
    return _without(rows, members.join(stay, "_row", "left_anti"), "near")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    rows = _numbered(docs)
    return _without(rows, decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row").where("contaminated"), "contaminated")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it."""
    rows = _numbered(docs)
    copies = materialise(mix_sources(rows, row_col="_row").where("copies > 0").select("_row", F.col("copies").alias("_copies")), "copies")
    side = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    return rows.join(side, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(docs.columns)


def training_order_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of token ids in their slots."""
    return training_order(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", training_order_stage),
]

#: The log-likelihood ratio, the dependent rounding and the permutation are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
    return STAGES[-1][1](spark, docs, sf_dir)
