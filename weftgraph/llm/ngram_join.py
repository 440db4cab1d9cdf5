"""N-gram Jaccard join: which texts have word-shingle sets of a given Jaccard similarity, as components of such links.

1. Texts with equal sets fall into one class (by a 64-bit print of the set); the rest is about classes.
2. Two sets that link share a token among the first n - ceil(t * n) + 1 of each, in any one order of all tokens. Those prefixes go
   to hash buckets; tokens of a single class end there. The order puts hashes of rare tokens first: tokens that a share HEAVY of a
   task's texts hold come last, so a line that many unrelated texts hold joins nothing. The order matters for speed only.
3. For every set of classes that some token leaves, a signature tree over them gives a spanning forest of the pairs whose bitmaps allow a link: edges
   grow with the members, not with their pairs. Members of a token beyond GROUP are dealt out as pairs of chunks.
4. Within each component of those edges the texts meet once, and a signature tree with exact counts at its leaves gives the links.
   Components beyond BLOCK_TOKENS are dealt out as pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.components import connected_components
from weftgraph.llm.shared import materialise, mix, pack, shuffle_partitions, text_slices, unpack, window_hashes, word_hashes, word_spans
from weftgraph.llm.signature_tree import Tree, bitmap, width_of

#: A token is heavy if it is in over this share of all texts (of some block's, to be found). There are fewer of them than
#: 2 / HEAVY times the mean number of tokens of a text, whatever the corpus: that bounds what is broadcast.
HEAVY, HEAVY_LEAST = 1 / 512, 16
GROUP = 1 << 15
BLOCK_TOKENS = 4 << 20
BROADCAST_BYTES = 32 << 20
_BLOCK = 2 << 20


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row; fewer than k words are one shingle, none are none."""
    for i, j, b, off in text_slices(column):
        s, e, at = word_spans(b, off)
        words = word_hashes(b, s, e, fold=True)
        grams = window_hashes(words, k)
        for r in range(j - i):
            a, z = at[r], at[r + 1]
            if z - a >= k:
                yield i + r, np.unique(grams[a : z - k + 1])
            elif z > a:
                yield i + r, window_hashes(words[a:z], int(z - a)) ^ np.uint64(z - a)
            else:
                yield i + r, np.zeros(0, np.uint64)


def _print(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64) + np.uint64(len(tokens)) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _heavy_part(k: int):
    def run(batches):
        held, docs, n = [], 0, 0

        def out():
            t, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= max(HEAVY_LEAST / 4, HEAVY * docs)
            return pa.RecordBatch.from_arrays([pa.array(t[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for _, tokens in _sets(batch.column(0), k):
                held.append(tokens)
                docs, n = docs + 1, n + len(tokens)
                if n >= _BLOCK:
                    yield out()
                    held, docs, n = [], 0, 0
        if held:
            yield out()

    return run


def _digests(k: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("print", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            rows = [(len(t), _print(t), bitmap(t, width_of(len(t), 1)).tobytes()) for _, t in _sets(batch.column(1), k)]
            n, prints, bits = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(prints, pa.int64()), pa.array(bits, pa.binary())], schema=schema)

    return run


def _prefixes(k: int, num: int, den: int, heavy: np.ndarray, n_buckets: int):
    """Texts -> for each hash bucket, the prefix tokens of the block's classes."""
    schema = pa.schema([("bucket", pa.int64()), ("prints", pa.binary()), ("tokens", pa.binary())])

    def out(held: dict):
        prints = np.repeat(np.fromiter(held, np.int64, len(held)), [len(t) for t in held.values()])
        tokens = np.concatenate(list(held.values()))
        bucket = ((mix(tokens) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, prints, tokens = bucket[order], prints[order], tokens[order]
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        rows = [{"bucket": int(bucket[a]), "prints": prints[a:z].tobytes(), "tokens": tokens[a:z].tobytes()} for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches):
        held, n = {}, 0
        for batch in batches:
            for _, tokens in _sets(batch.column(0), k):
                p = _print(tokens)
                if len(tokens) and p not in held:
                    take = len(tokens) - -(-num * len(tokens) // den) + 1
                    if len(heavy):
                        common = heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens
                        tokens = np.concatenate([tokens[~common], tokens[common]])
                    held[p] = tokens[:take]
                    n += take
                    if n >= _BLOCK:
                        yield out(held)
                        held, n = {}, 0
        if held:
            yield out(held)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All prefix tokens of some buckets -> (mark, slice, chunks, prints): the classes of each token that has two or more, GROUP of
    them a row. Tokens of the very same classes have the same mark."""
    got = [(np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["prints"], np.int64)) for b in batches for r in b.to_pylist()]
    if not got:
        return
    tokens, prints = (np.concatenate(x) for x in zip(*got, strict=True))
    got.clear()
    order = np.lexsort((prints, tokens))
    tokens, prints = tokens[order], prints[order]
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (prints[1:] != prints[:-1])
    tokens, prints = tokens[first], prints[first]
    at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    k = np.diff(np.append(at, len(tokens)))
    marks = mix(np.add.reduceat(mix(prints.view(np.uint64)), at) + k.astype(np.uint64)).view(np.int64)
    _, one = np.unique(marks, return_index=True)
    one = one[k[one] > 1]
    rows, n = [], 0
    for mark, a, m in zip(marks[one].tolist(), at[one].tolist(), k[one].tolist(), strict=True):
        for s in range(0, m, GROUP):
            rows.append((mark, s // GROUP, -(-m // GROUP), prints[a + s : a + min(m, s + GROUP)]))
            n += len(rows[-1][3])
        if n > 1 << 18:
            yield _groups(rows)
            rows, n = [], 0
    if rows:
        yield _groups(rows)


def _groups(rows: list) -> pa.RecordBatch:
    mark, part, chunks, prints = zip(*rows, strict=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in prints])), pa.int32()), pa.array(np.concatenate(prints)))
    return pa.RecordBatch.from_arrays([pa.array(mark, pa.int64()), pa.array(part, pa.int32()), pa.array(chunks, pa.int32()), lists], names=["mark", "slice", "chunks", "prints"])


def _chunked(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a key with `chunks` > 1 out as pairs of chunks (x, y), x <= y; a row's own chunk is `own`."""
    df = df.withColumn("own", F.expr(f"int(pmod(xxhash64(print, {key}), chunks))")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    return df.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")


def _by_key(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> one table for each value of the first n_keys columns."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not len(table):
            continue
        keys = [table.column(i).to_numpy() for i in range(n_keys)]
        new = np.zeros(len(table), bool)
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, z - a)
        rest = table.slice(cuts[-1])
    if rest is not None and len(rest):
        yield rest


def _stars(seen: set, prints: np.ndarray, union) -> Iterator[tuple[int, int]]:
    members: dict[int, list[int]] = {}
    for i, p in enumerate(prints.tolist()):
        members.setdefault(union.root(i), []).append(p)
    for own in members.values():
        lead = min(own)
        for p in own:
            if p != lead and (lead, p) not in seen:
                seen.add((lead, p))
                yield lead, p


def _edge_batch(edges: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])


def _candidates(num: int, den: int):
    """Rows (mark, x, y, print, n, bits, own), sorted -> edges of classes that may link."""

    def run(batches):
        seen: set = set()
        out: list = []
        for t in _by_key(batches, 3):
            prints, sizes = t.column(3).to_numpy(), t.column(4).to_numpy()
            if len(prints) < 2:
                continue
            bits = [np.frombuffer(x, np.uint64) for x in t.column(5).to_pylist()]
            x, y = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            union = Tree(sizes, bits, num, den).forest(groups=t.column(6).to_numpy() if x != y else None)
            out += _stars(seen, prints, union)
            if len(seen) > 1 << 20:
                seen.clear()
            if len(out) > 1 << 14:
                yield _edge_batch(out)
                out = []
        if out:
            yield _edge_batch(out)

    return run


def _verified(k: int, num: int, den: int):
    """Rows (component, x, y, print, text, own), sorted -> edges of classes that link."""

    def run(batches):
        seen: set = set()
        for t in _by_key(batches, 3):
            sets = [s for _, s in _sets(t.column(4).combine_chunks() if isinstance(t.column(4), pa.ChunkedArray) else t.column(4), k)]
            prints, own = t.column(3).to_numpy(), t.column(5).to_numpy()
            # an id that is not unique brings other texts along; and a text may come twice
            right = [i for i, s in enumerate(sets) if _print(s) == prints[i]]
            at: dict[int, int] = {}
            for i in right:
                at.setdefault(int(prints[i]), i)
            take = list(at.values())
            if len(take) < 2:
                continue
            sets, prints, own = [sets[i] for i in take], prints[take], own[take]

            def exact(i, j):
                a, b = sets[i], sets[j]
                both = np.sort(np.concatenate([a, b]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                return den * common >= num * (len(a) + len(b) - common)

            sizes = np.array([len(s) for s in sets])
            x, y = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            union = Tree(sizes, [bitmap(s, width_of(len(s), 4)) for s in sets], num, den).forest(exact, own if x != y else None)
            if edges := list(_stars(seen, prints, union)):
                yield _edge_batch(edges)

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, class_id, component_id): one row for each row of `docs`.

    Words are the runs of characters other than ASCII white space, with A-Z as a-z; a text's set has its distinct k-word shingles, or
    the whole sequence where there are fewer words. Texts link when den * |intersection| >= num * |union|. class_id is the smallest id
    with the same set, component_id the smallest reachable over links, itself included.

    - A null or wordless text has an empty set and links with nothing: its class and component are its own id.
    - Rows with a null id take part in nothing but are returned, with null class and component.
    - Repeated ids and rows are kept; rows of equal text share class and component. Other columns don't matter; no rows give no rows.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    some = src.where("id is not null and text is not null")

    total = src.count()
    counts = some.select("text").mapInArrow(_heavy_part(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    heavy = counts.where(F.col("n") >= max(HEAVY_LEAST, HEAVY / 2 * total)).select("token").toPandas()["token"].to_numpy()
    heavy = np.sort(heavy.astype(np.int64).view(np.uint64))

    digests = materialise(src.select("id", "text").mapInArrow(_digests(k), "id long, n long, print long, bits binary"), "digests")
    classes = digests.where("id is not null and n > 0").groupBy("print").agg(F.min("id").alias("class_id"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = materialise(classes, "classes")

    prefixes = some.select("text").mapInArrow(_prefixes(k, num, den, heavy, 16 * n), "bucket long, prints binary, tokens binary")
    shared = prefixes.repartition(n, "bucket").mapInArrow(_shared, "mark long, slice int, chunks int, prints array<long>")
    shared = shared.groupBy("mark", "slice").agg(F.first("chunks").alias("chunks"), F.first("prints").alias("prints")).select("mark", "chunks", F.explode("prints").alias("print"))
    rows = _chunked(shared.join(classes.select("print", "n", "bits"), "print"), "mark")
    rows = rows.select("mark", "x", "y", "print", "n", "bits", "own").repartition(n, "mark", "x", "y").sortWithinPartitions("mark", "x", "y", "print")
    may = connected_components(rows.mapInArrow(_candidates(num, den), "a long, b long"), "candidates")

    may = may.join(classes.select(F.col("print").alias("node"), "class_id", "n"), "node")
    may = materialise(may.select(F.col("node").alias("print"), "component", "class_id", "n"), "blocks")
    blocks = may.groupBy("component").agg(F.expr(f"int(ceil(sum(n) / {BLOCK_TOKENS}))").alias("chunks"))
    may = may.join(blocks, "component").select("component", "print", F.col("class_id").alias("id"), "chunks")
    small = F.broadcast(may) if total * 40 <= BROADCAST_BYTES or may.count() * 40 <= BROADCAST_BYTES else may
    texts = _chunked(some.join(small, "id"), "component")
    texts = texts.select("component", "x", "y", "print", "text", "own").repartition(n, "component", "x", "y").sortWithinPartitions("component", "x", "y", "print")
    links = connected_components(texts.mapInArrow(_verified(k, num, den), "a long, b long"), "links")

    least = links.join(classes.select(F.col("print").alias("node"), "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    linked = links.join(least, "component").select(F.col("node").alias("print"), "component_id")
    known = classes.select("print", "class_id").join(linked, "print", "left").select("print", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    out = digests.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("print")).alias("print")).join(known, "print", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 2, 2) END)) AS i FROM d),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(node) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
