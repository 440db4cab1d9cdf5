"""Incremental maintenance of a block table from a stream of changed blocks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.maintenance import replace_blocks


def _last(spark, root: str):
    """(batch, version) of the last pointer, or None before the first."""
    try:
        return spark.read.schema("batch long, version string").parquet(f"{root}/pointer").orderBy(F.desc("batch")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark, root: str, schema: str) -> DataFrame:
    """The table as of the last batch whose pointer is written; no rows before the first."""
    last = _last(spark, root)
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{root}/{last.version}")


def maintain(changes: DataFrame, root: str, schema: str, checkpoint: str, order: str = "at") -> StreamingQuery:
    """Keep a table of blocks under `root`, whose `schema` has a column path. `changes` has those columns, deleted boolean and
    `order`: of the changes to a path in a batch the last is applied, rows of the same order together; deleted ones leave no row.

    Each batch writes a new version and then its pointer, so a batch that is run again after a failure gives the same table.
    Batches up to the last pointer's are left alone: a `root` belongs to one checkpoint.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = _last(spark, root)
        if last is not None and last.batch >= batch_id:
            return
        old = current(spark, root, schema)
        changed = batch.withColumn("_r", F.rank().over(Window.partitionBy("path").orderBy(F.desc(order)))).where("_r = 1")
        new = changed.where("NOT deleted").select(old.columns)
        replace_blocks(old, new, changed).write.mode("overwrite").parquet(f"{root}/b{batch_id}")
        spark.range(1).select(F.lit(batch_id).cast("long").alias("batch"), F.lit(f"b{batch_id}").alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/pointer")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
