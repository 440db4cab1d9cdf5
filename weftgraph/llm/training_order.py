"""Token-ID / binary output: training-order materialisation.

Each text becomes token ids, cut into sequences of a fixed length. Sequences are numbered densely; a keyed Feistel permutation with
cycle-walking gives each number a global slot, so the order is a shuffle that can be computed, not stored. Rows are dealt by slot
range and sorted in it: a shard holds `shard_size` consecutive slots of a fixed stride, and a reader finds any slot by arithmetic.

Ids are written to the shared folder once, as sequences can only be numbered when all are counted.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import materialise, mix, shuffle_partitions

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
LENGTH = 512
SHARD = 1 << 14
BUCKETS = 1024
BROADCAST_BYTES = 32 << 20
#: Units whose ids a Python worker keeps; some 200 bytes each.
CACHE = 1 << 15
#: How the byte-level vocabulary's pre-tokens are parted.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A unit is a run of white space and the run of other characters after it. No pre-token crosses from the latter to the former, so
# the ids of a text are those of its units, one after the other.
_WS = "\t-\r \x85\xa0  -     　"
_UNIT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


class _Ids(dict):
    """Unit -> its ids as bytes; filled as units come, up to CACHE."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values(), default=0) > 0xFFFF:
            raise ValueError("ids are stored in two bytes: the vocabulary has larger ones")
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, unit: str) -> bytes:
        ids = array("H", self.encode(unit)).tobytes()
        if len(self) < CACHE and len(unit) < 64:
            self[unit] = ids
        return ids


_loaded: dict[str, _Ids] = {}


def token_bytes(text: str, path: str = RANKS) -> bytes:
    """The ids of a text, two bytes each, little-endian."""
    if path not in _loaded:
        _loaded[path] = _Ids(path)
    ids = _loaded[path]
    return b"".join([ids[u] for u in _UNIT.findall(text)])


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of range(n): a Feistel network on the least even number of bits that hold it, walked until it lands in it."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key} {r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _tokenised(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # a worker that earlier stages used may hold theirs
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [token_bytes(t.as_py() or "", path) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "print", "n_tokens", "ids"])

    return run


_ROWS = "slot long, id long, seq_no int, n_tokens int, tokens binary"


def _placed(length: int, total: int, key: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                number, ids, seq, size, rows = [], [], [], [], []
                for i, own, first, copies in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    raw = own + end.to_bytes(2, "little")
                    pieces = [raw[a : a + 2 * length] for a in range(0, len(raw), 2 * length)]
                    for c in range(copies):
                        number += range(first + c * len(pieces), first + (c + 1) * len(pieces))
                        ids += [i] * len(pieces)
                        seq += range(len(pieces))
                        size += [len(p) // 2 for p in pieces]
                        rows += [p + end.to_bytes(2, "little") * (length - len(p) // 2) for p in pieces]
                slots = feistel(np.array(number, np.int64), total, key)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(ids, pa.int64()), pa.array(seq, pa.int32()), pa.array(size, pa.int32()), pa.array(rows, pa.binary())], names=["slot", "id", "seq_no", "n_tokens", "tokens"])

    return run


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, length: int = LENGTH, shard_size: int = SHARD, key: int = 20240229, end: int = END) -> DataFrame:
    """(slot, shard, place, id_col, seq_no, n_tokens, tokens), one row a sequence, partitions in slot order.

    A text's ids and the end id are cut every `length`; the last piece is filled up with the end id (n_tokens counts without the
    fill). tokens: 2 * length bytes, little-endian. Slots are 0 .. n-1 without gaps; shard = slot // shard_size.

    - A null or empty text is one sequence of the end id. Null ids are kept.
    - Rows of equal id and text are as many copies, each with slots of its own; rows that share an id only are separate texts.
    - The order depends on ids, texts and the key, not on how the rows are dealt. Other columns don't matter. No rows give no rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("print"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = materialise(src.mapInArrow(_tokenised(ranks), "id long, print long, n_tokens long, ids binary"), "ids")
    n_seq = F.ceil((F.first("n_tokens") + 1) / length).alias("n_seq")
    counts = src.groupBy("id", "print").agg(F.count("*").alias("copies"), n_seq)
    counts = materialise(counts.withColumn("bucket", F.pmod(F.xxhash64("id", "print"), F.lit(BUCKETS))), "counts")
    sums = counts.groupBy("bucket").agg(F.sum(F.col("copies") * F.col("n_seq")).alias("n"))
    sums = sums.withColumn("base", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    before = Window.partitionBy("bucket").orderBy("id", "print").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n_seqs = F.col("copies") * F.col("n_seq")
    first = counts.join(F.broadcast(sums.select("bucket", "base")), "bucket").withColumn("first", F.col("base") + F.sum(n_seqs).over(before) - n_seqs)
    first = materialise(first.select("id", "print", "copies", "first"), "offsets")
    size, total = counts.agg(F.count("*") * 40, F.sum(n_seqs)).first()
    total = total or 0
    # rows that repeat wholly become one, which brings its copies
    side = first.select(F.col("id").alias("of"), F.col("print").alias("same"), "copies", "first")
    met = src.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, (F.col("id").eqNullSafe(F.col("of"))) & (F.col("print") == F.col("same")))
    single = met.where("copies = 1").select("id", "ids", "first", "copies")
    several = met.where("copies > 1").groupBy("id", "print", "first", "copies").agg(F.first("ids").alias("ids")).select("id", "ids", "first", "copies")
    rows = single.unionByName(several).mapInArrow(_placed(length, total, key, end), _ROWS)
    n, shards = shuffle_partitions(spark), max(1, -(-total // shard_size))
    rows = rows.withColumn("shard", F.expr(f"slot div {shard_size}")).withColumn("place", F.expr(f"int(slot % {shard_size})"))
    if shards >= n:
        rows = rows.repartitionById(n, F.expr(f"int(shard * {n} div {shards})"))
    else:  # fewer shards than tasks: each is dealt out in runs of slots
        rows = rows.repartitionById(n, F.expr(f"int(slot * {n} div {max(1, total)})"))
    return rows.sortWithinPartitions("slot").select("slot", "shard", "place", F.col("id").alias(id_col), "seq_no", "n_tokens", "tokens")


def write_shards(ordered: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Write the rows of training_order as `path`/shard-N.bin, a folder that all executors mount; return (shard, n_sequences, n_bytes).

    A shard is written under a name of the task attempt's own and renamed when whole, so attempts that overlap don't meet. One of the right size that is there already is left alone, so a
    run that broke off goes on where it stopped.
    """
    stride = 2 * length
    whole = ordered.groupBy("shard").agg(F.count("*").alias("n"))
    rows = ordered.join(F.broadcast(whole), "shard").select("shard", "place", "n", "tokens").repartition("shard").sortWithinPartitions("shard", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        own = TaskContext.get().taskAttemptId()  # another attempt, on this host or elsewhere, has another
        out, at, done, skip = None, None, [], False

        def close():
            if out is not None:
                out.close()
                os.replace(out.name, f"{path}/shard-{at:06d}.bin")

        for batch in batches:
            for shard, n, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if shard != at:
                    close()
                    at, name = shard, f"{path}/shard-{shard:06d}.bin"
                    skip = os.path.exists(name) and os.path.getsize(name) == n * stride
                    out = None if skip else open(f"{name}.{own}", "wb")
                    done.append((shard, n, n * stride))
                if not skip:
                    out.write(tokens)
        close()
        cols = list(zip(*done, strict=True)) if done else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["shard", "n_sequences", "n_bytes"])

    return rows.mapInArrow(run, "shard long, n_sequences long, n_bytes long")


def read_slot(path: str, slot: int, length: int = LENGTH, shard_size: int = SHARD) -> list[int]:
    """The ids at a slot of written shards."""
    with open(f"{path}/shard-{slot // shard_size:06d}.bin", "rb") as f:
        f.seek(slot % shard_size * 2 * length)
        return list(array("H", f.read(2 * length)))


def op5_training_order(spark, sf_dir: str) -> DataFrame:
    return training_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))
