"""Files as tables: source trees in folder order, and libraries by the directories of their archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_files(spark: SparkSession, folders: list[str], pattern: str = "*.java") -> DataFrame:
    """(folder, folder_ord, path, size, hash, text): files below each folder, by folder in the order given; path is relative to it. Content
    is read by the executors; a hash or text that nobody asks for isn't computed."""
    out = None
    for i, folder in enumerate(folders):
        root = folder.rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^.*?" + _quoted(root.rsplit("://", 1)[-1]) + "/", "")
        rows = files.select(F.lit(folder).alias("folder"), F.lit(i).alias("folder_ord"), path.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


_ENTRY = "lib string, name string, size long, crc long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for lib, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(lib, e.filename, e.file_size, e.CRC) for e in z.infolist()]
            except zipfile.BadZipFile:
                rows.append((lib, None, None, None))
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["lib", "name", "size", "crc"])


def library_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(lib, name, size, crc) from the directories of archives; one row of nulls for one that can't be read."""
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_entries, _ENTRY)


def library_facts(entries: DataFrame) -> DataFrame:
    """(lib, fingerprint, packages): a digest of an archive's directory, '' if it can't be read, and the packages of its classes. The digest
    doesn't depend on the order of entries or their times."""
    line = F.concat_ws("|", "name", "size", "crc")
    package = F.when(F.col("name").endswith(".class") & ~F.col("name").startswith("META-INF/"), F.translate(F.regexp_extract("name", "^(?:(.*)/)?[^/]*$", 1), "/", "."))
    by = entries.groupBy("lib").agg(F.count("name").alias("n"), F.array_sort(F.collect_set(line)).alias("lines"), F.array_sort(F.collect_set(package)).alias("packages"))
    return by.select("lib", F.when(F.col("n") == 0, "").otherwise(F.sha2(F.array_join("lines", "\n").cast("binary"), 256)).alias("fingerprint"), "packages")
