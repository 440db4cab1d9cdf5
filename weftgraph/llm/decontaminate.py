"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts, one scan of each text.

The automaton reads words by their numbers, each as three symbols of few values, so that a node has few children. A window of w words
holds one whole block of (w + 1) // 2 words that begins at a multiple of that number, so the automaton has those blocks alone: it grows
with the words of the benchmark, not with w times their number. Where a block is found, the match is extended to both sides by the
item's own words; what matches w words or more is hit, word by word, and no more than that. Items of fewer than w words are patterns
as they are. Places are word places, which map back to characters of the original text.

The automaton is built once in each Python worker from the items, which are broadcast; it takes some 35 bytes a byte of items. A
benchmark beyond BLOCK_BYTES is scanned for in several blocks of items, one after the other, and the hits of a text united.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import materialise, text_slices

BLOCK_BYTES = 12 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # with A-Z, as the original has them
_SPAN = "array<struct<start: long, end: long>>"
_SCANNED = f"id long, print long, n_words long, hits array<struct<start: int, end: int>>, items array<long>, spans {_SPAN}"


def _symbols(number: int) -> str:
    """A word's number as three symbols; each place has symbols of its own, so that nothing matches across places."""
    return chr(number & 127) + chr(128 + (number >> 7 & 127)) + chr(256 + (number >> 14))


_UNKNOWN = (0, _symbols(0))


class Windows:
    """The items' windows of `window` words, found in sequences of words."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.window, self.numbers, self.texts, self.owners, self.least = window, {}, [], [], 1 << 30
        block = (window + 1) // 2
        same: dict[bytes, int] = {}  # items of equal words are one
        places: dict[tuple, list] = {}
        for item, text in items:
            words = text.translate(_TABLE).split()
            if not words:
                continue
            ids = array("I", [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words])
            at = same.setdefault(ids.tobytes(), len(self.texts))
            if at < len(self.texts):
                self.owners[at].add(item)
                continue
            self.texts.append(ids)
            self.owners.append({item})
            if len(ids) < window:
                places.setdefault(tuple(ids), []).append((at, -1))
            else:
                for k in range(0, len(ids) - block + 1, block):
                    places.setdefault(tuple(ids[k : k + block]), []).append((at, k))
        self.found = ahocorasick.Automaton()
        while places:
            pattern, where = places.popitem()
            self.least = min(self.least, len(pattern))
            self.found.add_word("".join(map(_symbols, pattern)), (len(pattern), where))
        self.found.make_automaton()
        self.numbers = {w: (i, _symbols(i)) for w, i in self.numbers.items()}

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """(runs of hit words [start, end), ascending and apart; the items they are of)."""
        if not self.texts:
            return [], set()
        known = list(map(self.numbers.get, words, repeat(_UNKNOWN)))
        text = "".join([x[1] for x in known])
        ids: list[int] = []
        runs, which, done, n = [], set(), {}, len(known)
        for last, (size, where) in self.found.iter(text):
            ids = ids or [x[0] for x in known]
            end = last // 3
            first = end - size + 1
            for at, k in where:
                if k < 0:
                    runs.append((first, end + 1))
                    which |= self.owners[at]
                    continue
                if done.get((at, first - k), -1) >= end:  # of a run that is extended already
                    continue
                text = self.texts[at]
                a, i = first, k
                while a and i and ids[a - 1] == text[i - 1]:
                    a, i = a - 1, i - 1
                z, j, m = end + 1, k + size, len(text)
                while z < n and j < m and ids[z] == text[j]:
                    z, j = z + 1, j + 1
                done[at, first - k] = z
                if z - a >= self.window:
                    runs.append((a, z))
                    which |= self.owners[at]
        runs.sort()
        out: list[list[int]] = []
        for a, z in runs:
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], z)
            else:
                out.append([a, z])
        return out, which


_built: dict = {}  # of this worker, the last automaton


def _scan(items: list[tuple[int, bytes]], window: int, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _built:
            _built.clear()
            _built[mark] = Windows(items, window)
        found = _built[mark]
        for batch in batches:
            counts, hits, items_of, spans = [], [], [], []
            for _, _, b, off in text_slices(batch.column(2)):
                raw = b.tobytes()
                flat = raw.translate(_TABLE)
                for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    words = flat[s:e].split()
                    counts.append(len(words))
                    own, which = found.hits(words)
                    hits.append([{"start": a, "end": z} for a, z in own])
                    items_of.append(sorted(which))
                    spans.append(_original(raw[s:e].decode(), own) if own else [])
            pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            narrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, narrow), pa.array(items_of, pa.list_(pa.int64())), pa.array(spans, pair)],
                names=["id", "print", "n_words", "hits", "items", "spans"],
            )

    return run


def _original(text: str, runs: list[list[int]]) -> list[dict]:
    """Word runs as characters [start, end) of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[z - 1][1]} for a, z in runs]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """(id_col, n_words, n_hit, items, spans, contaminated): which words of each row are inside an occurrence of an item's window.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z as a-z. A window is `window` consecutive words of an
    item, or all of a shorter one. `items` are the items with occurring windows, ascending; `spans` the hit runs as character
    offsets [start, end) of the original text. contaminated: n_hit > 0 and share * n_hit >= n_words.

    - A null or wordless text has no words and no hits; so has a benchmark of none (no rows, nulls, no words).
    - A null id is kept; repeated ids and rows give a row each; items that repeat count once by id; a null item id is left out.
    - Other columns don't matter. No rows give no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    scans = []
    for k in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        block = sorted((r["item"], r["text"].encode()) for r in rows.toLocalIterator())
        scan = src.mapInArrow(_scan(block, window, f"{hash(tuple(block))} {window}"), _SCANNED)
        # of several blocks each is scanned for before the next is fetched, and rows without a hit are kept of the first alone
        scans.append(scan if n == 1 else materialise(scan if k == 0 else scan.where("size(hits) > 0"), "scanned"))
    if n == 1:
        got = scans[0].withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
    else:  # of rows that are equal one is scanned, and the result goes to each
        one = scans[0]
        for scan in scans[1:]:
            one = one.unionByName(scan)
        every = one.groupBy("id", "print").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_set("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
        )
        every = every.withColumn("n_hit", F.expr("cast(size(array_distinct(flatten(transform(hits, h -> sequence(h.start, h.end - 1))))) as long)"))
        left, right = src.select("id", "print").alias("l"), every.alias("r")
        same = (F.col("l.id").eqNullSafe(F.col("r.id"))) & (F.col("l.print").eqNullSafe(F.col("r.print")))
        got = left.join(right, same).select("r.*")
    bad = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return got.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans", bad.alias("contaminated"))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
v AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM p),
x AS (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d, (SELECT DISTINCT k FROM v)),
h AS MATERIALIZED (SELECT doc_id, i, x.k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM x) x JOIN v ON x.k = v.k AND x.t = v.t),
n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, range(0, 13) AS r(j) WHERE j < k GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
