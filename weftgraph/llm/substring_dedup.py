"""Substring dedup: every word of a repeated fixed-length window is removed, but for the window's first document.

Rabin-Karp hashes of all windows go to hash buckets by one shuffle; each bucket finds, for every hash, the smallest document, and
flags the others. Flags are positions; by document they merge into maximal removal intervals, which are few, and only those meet
the texts again.

- A block (about BLOCK_WINDOWS windows of a task) sends, for each hash, only the windows of its smallest document: larger ones are
  flagged on the spot. So a passage that a third of all documents hold is one entry a block, not one a document.
- 64-bit hashes stand for word sequences; among w distinct windows about w*w/2**65 pairs collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import materialise, mix, pack, release, shuffle_partitions, text_slices, unpack, window_hashes, word_hashes, word_spans

BLOCK_WINDOWS = 1 << 20
#: What a worker holds at once beside its block: bytes of text, and rows of a batch that it makes.
SLICE_BYTES = 1 << 20
BATCH_ROWS = 512
#: Removal intervals of up to so many packed bytes are broadcast to the texts; beyond that both sides are shuffled.
BROADCAST_BYTES = 32 << 20

_ENTRY = "bucket long, ids binary, prints binary, counts binary, places binary, hashes binary"
_FLAG = "part long, ids binary, prints binary, counts binary, places binary"
_RUNS = "id long, print long, runs binary"


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _entries(bucket: np.ndarray, doc: np.ndarray, ids: np.ndarray, prints: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> Iterator[dict]:
    """An entry for each bucket; windows come in the order of their buckets."""
    cuts = np.append(_runs(bucket), len(bucket))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        at = _runs(doc[a:z])
        yield {
            "bucket": int(bucket[a]),
            "ids": pack(ids[doc[a:z][at]]),
            "prints": prints[doc[a:z][at]].astype(np.uint32).tobytes(),
            "counts": pack(np.diff(np.append(at, z - a))),
            "places": pack(place[a:z]),
            "hashes": hashes[a:z].tobytes(),
        }


def _flag_entries(doc: np.ndarray, ids: np.ndarray, prints: np.ndarray, place: np.ndarray) -> Iterator[dict]:
    """Local flags travel as entries of bucket -1 without hashes."""
    at = _runs(doc)
    if len(at):
        yield {"bucket": -1, "ids": pack(ids[doc[at]]), "prints": prints[doc[at]].astype(np.uint32).tobytes(), "counts": pack(np.diff(np.append(at, len(doc)))), "places": pack(place), "hashes": b""}


def _block(parts: list, n_buckets: int) -> Iterator[dict]:
    """The entries of `parts`, which this empties. Arrays go as soon as they have been read, as a block's are most of a worker's memory."""
    ids, prints, counts, hashes, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    if len(ids) > 1 and np.any(ids[1:] < ids[:-1]):
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int32)
        rank[by_id] = np.arange(len(ids), dtype=np.int32)
        ids, prints, doc = ids[by_id], prints[by_id], rank[doc]
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        hashes = hashes[order]
        place = place[order]
        del order
    rank = np.cumsum(np.append(0, ids[1:] != ids[:-1]), dtype=np.int32) if len(ids) else np.zeros(0, np.int32)  # rows that share an id share a rank
    order = np.argsort(hashes, kind="stable")
    starts = _runs(hashes[order])
    least = np.empty(len(hashes), np.int32)  # the rank of the smallest id that has this hash, by entry
    least[order] = np.repeat(rank[doc[order[starts]]], np.diff(np.append(starts, len(hashes))))
    del order, starts
    ours = rank[doc] == least
    del least
    yield from _flag_entries(doc[~ours], ids, prints, place[~ours])
    doc, place, hashes = doc[ours], place[ours], hashes[ours]
    del ours
    bucket = ((hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    doc = doc[order]
    place = place[order]
    hashes = hashes[order]
    del order
    yield from _entries(bucket, doc, ids, prints, place, hashes)


def _windows(window: int, n_buckets: int):
    schema = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("ids", "prints", "counts", "places", "hashes"))])

    def sent(parts: list) -> Iterator[pa.RecordBatch]:
        for rows in batched(_block(parts, n_buckets), BATCH_ROWS):
            yield pa.RecordBatch.from_pylist(list(rows), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        held = 0
        for batch in batches:
            all_ids, all_prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, j, b, off in text_slices(batch.column(2), SLICE_BYTES):
                parts.append((all_ids[i:j], all_prints[i:j], *_places(b, off, window)))
                held += len(parts[-1][-1])
                if held >= BLOCK_WINDOWS:
                    yield from sent(parts)
                    parts, held = [], 0
        if held:
            yield from sent(parts)
        release()

    return run


def _places(b: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows by row, hash and place of each window) of some texts."""
    s, e, at = word_spans(b, off)
    h = window_hashes(word_hashes(b, s, e), window)
    counts = np.maximum(np.diff(at) - window + 1, 0)
    place = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    return counts, h[np.repeat(at[:-1], counts) + place], place


def _flagged(n_parts: int):
    """All entries of some hash buckets -> flagged places, packed for each of `n_parts` parts of the documents."""
    schema = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("ids", "prints", "counts", "places"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                by_bucket.setdefault(row["bucket"], []).append(row)
        hits = []
        for bucket in list(by_bucket):  # one at a time: the rest stays packed
            got = []
            for row in by_bucket.pop(bucket):
                counts = unpack(row["counts"])
                ids, prints = (np.repeat(x, counts) for x in (unpack(row["ids"]), np.frombuffer(row["prints"], np.uint32)))
                got.append((ids, prints, unpack(row["places"]), np.frombuffer(row["hashes"], np.uint64)))
            if bucket < 0:
                hits += [x[:3] for x in got]
                continue
            ids, prints, place, hashes = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((ids, hashes))
            starts = _runs(hashes[order])
            least = np.repeat(ids[order[starts]], np.diff(np.append(starts, len(order))))
            hit = order[ids[order] > least]
            hits.append((ids[hit], prints[hit], place[hit]))
        if not hits:
            return
        ids, prints, place = (np.concatenate(x) for x in zip(*hits, strict=True))
        hits.clear()
        part = (mix(ids.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
        order = np.lexsort((place, prints, ids, part))
        part, ids, prints, place = part[order], ids[order], prints[order], place[order]
        cuts = np.append(_runs(part), len(part))
        rows = []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            at = _runs(ids[a:z], prints[a:z])
            rows.append({"part": int(part[a]), "ids": pack(ids[a:z][at]), "prints": prints[a:z][at].tobytes(), "counts": pack(np.diff(np.append(at, z - a))), "places": pack(place[a:z])})
        del part, ids, prints, place, order
        yield pa.RecordBatch.from_pylist(rows, schema)
        release()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All flags of some documents -> one row a document with the runs of its flagged places."""
    hits = []
    for batch in batches:
        for row in batch.to_pylist():
            counts = unpack(row["counts"])
            hits.append((np.repeat(unpack(row["ids"]), counts), np.repeat(np.frombuffer(row["prints"], np.uint32), counts), unpack(row["places"])))
    if not hits:
        return
    ids, prints, place = (np.concatenate(x) for x in zip(*hits, strict=True))
    hits.clear()
    order = np.lexsort((place, prints, ids))
    ids, prints, place = ids[order], prints[order].astype(np.int64), place[order]
    at = _runs(ids, prints)
    cuts = np.append(at, len(ids))
    for k in range(0, len(at), 4096):
        now = at[k : k + 4096]
        runs = pa.array([_intervals(place[cuts[i] : cuts[i + 1]]) for i in range(k, k + len(now))], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(ids[now]), pa.array(prints[now]), runs], names=["id", "print", "runs"])
    release()


def _intervals(place: np.ndarray) -> bytes:
    """Ascending places as runs of consecutive ones: int64 pairs (first, beyond the last)."""
    cut = np.flatnonzero(np.diff(place) > 1) + 1
    return np.column_stack([place[np.append(0, cut)], place[np.append(cut - 1, len(place) - 1)] + 1]).astype(np.int64).tobytes()


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(k, BATCH_ROWS) for whole in batches for k in range(0, whole.num_rows, BATCH_ROWS)):
        words_n, removed_n, texts, spans = [], [], [], []
        for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
            words = (text.as_py() or "").encode().split()
            pairs: list = []
            if runs.is_valid:
                for a, z in np.frombuffer(runs.as_py(), np.int64).reshape(-1, 2).tolist():
                    if pairs and a <= pairs[-1][1]:
                        pairs[-1][1] = max(pairs[-1][1], z + window - 1)
                    else:
                        pairs.append([a, z + window - 1])
            kept, last = [], 0
            for a, z in pairs:
                kept += words[last:a]
                last = z
            kept += words[last:]
            words_n.append(len(words))
            removed_n.append(len(words) - len(kept))
            texts.append(b" ".join(kept).decode())
            spans.append([{"start": a, "end": z} for a, z in pairs])
        extra = [pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *extra], names=["id", "n_words", "n_removed", "kept_text", "removed"])
    release()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(id_col, n_words, n_removed, kept_text, removed): each row of `docs` without the words of repeated windows.

    A word goes if a window of `window` consecutive words that covers it also starts in a row with a smaller id; windows are judged
    on the input. `removed` has the maximal intervals of word places [start, end) that went.

    - A null text has no words; its kept_text is empty. A null id is neither smaller nor larger than any: such a row stays whole.
    - Rows that share an id are told apart by their text, and neither removes anything from the other.
    - Texts shorter than the window stay whole. Columns other than the two named don't matter. No rows give no rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("print", F.expr("xxhash64(text) & 4294967295L"))
    n = shuffle_partitions(spark)
    buckets = 16 * n  # many to a partition, so that hashing them to partitions stays even
    entries = src.where("id is not null and text is not null").select("id", "print", "text").mapInArrow(_windows(window, buckets), _ENTRY)
    # local flags (bucket -1) are spread by their bytes
    spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.crc32("places"))
    flags = entries.withColumn("key", spread).repartition(n, "key").drop("key").mapInArrow(_flagged(4 * n), _FLAG)
    runs = materialise(flags.repartition(n, "part").mapInArrow(_merged, _RUNS), "repeats")
    size = runs.agg(F.sum(F.length("runs") + 64)).first()[0] or 0
    small = F.broadcast(runs) if size <= BROADCAST_BYTES else runs
    met = src.join(small, ["id", "print"], "left").select("id", "text", "runs")
    out = met.mapInArrow(lambda it: _cut(it, window), "id long, n_words long, n_removed long, kept_text string, removed array<struct<start: long, end: long>>")
    return out.withColumnRenamed("id", id_col)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
f AS (SELECT DISTINCT doc_id, i + j AS i FROM g JOIN m USING (h), range(0, 13) AS r(j) WHERE least < doc_id),
c AS (SELECT doc_id, list(i) AS cut FROM f GROUP BY doc_id),
x AS (SELECT d.doc_id, w, coalesce(cut, []) AS cut FROM d LEFT JOIN c USING (doc_id)),
k AS (SELECT doc_id, len(w) AS n_words, len(cut) AS n_removed, w, cut FROM x),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN f USING (doc_id, i) GROUP BY doc_id)
SELECT k.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN s USING (doc_id)
"""
