"""What several operators share: materialised intermediate tables, and vectorised word hashing over Arrow text."""

from __future__ import annotations

import ctypes
import hashlib
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators.lineage import shared_folder

#: Java and SQL regular expression of the white space that parts words.
SPACE = r"[\x20\x09-\x0D]+"
#: The same characters, for translate() and trim().
SPACE_CHARS = "\t\n\x0b\x0c\r "

#: malloc_trim of the C library, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

SLICE_BYTES = 4 << 20
CHUNK = 1 << 18


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lineage ends there, so a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give what this process has freed back to the system: Spark keeps workers, and what they keep counts as the executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


# --- word hashing -------------------------------------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_BASE = 0x9E3779B97F4A7C15
_ROLL = np.uint64(0xD1342543DE82EF95)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int) -> np.ndarray:
    p = np.full(CHUNK + 1, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW = _powers(_BASE)
_POW_INV = _powers(pow(_BASE, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of a string column, `limit` bytes at a time or one row that is longer.

    Nulls count as empty. The bytes are a view of the Arrow buffer.
    """
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off_buf, data = column.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by row): the words of each row are the runs of bytes that are not white space."""
    if not len(b):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(off), np.int64)
    solid = ~_IS_SPACE[b]
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums of byte codes times powers of an odd base. fold: A-Z count as a-z."""
    code = _BYTE_FOLDED if fold else _BYTE
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        if ends[j - 1] - base > CHUNK:  # one word beyond a chunk
            word = b[base : ends[i]]
            out[i] = int.from_bytes(hashlib.blake2b((_FOLD[word] if fold else word).tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        part = b[base : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(code[part] * _POW[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * _POW_INV[s] ^ ((e - s).astype(np.uint64) << np.uint64(40)))
        i = j
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive words of the flat array, across rows too: the caller leaves those out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= _ROLL
        h += words[j : n + j]
    return mix(h)


# --- packed integers ----------------------------------------------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """Integers as differences in byte planes, compressed; made for ascending runs."""
    a = np.ascontiguousarray(a, dtype=np.int64)
    d = np.diff(a, prepend=np.int64(0))
    z = ((d << 1) ^ (d >> 63)).view(np.uint64)
    planes = np.ascontiguousarray(z.view(np.uint8).reshape(-1, 8).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    raw = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    z = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel()
    d = (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)
    return np.cumsum(d)
