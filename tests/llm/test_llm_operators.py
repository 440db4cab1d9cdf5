"""Edge cases and brute force for the operators: nulls, empty texts, repeated rows, empty tables, extra columns of clashing names."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate as dc
from weftgraph.llm import html_main, licenses, mixing, ngram_join, quality, queries, shared, signature_tree, substring_dedup, surrogates, token_counts, training_order

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (2, ""), (3, " \t\n"), (None, "a b c d e f g h i j k l m n o p"), (4, "a b c d e f g h i j k l m n o p"), (5, "A b c d e f g h i j k l m n o p"), (6, "x " * 3000), (7, "x " * 3000), (7, "other text")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s" if i != 3 else None, k, "0", "1") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, print string, id string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, same, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])


def test_word_hashes_know_words_apart():
    b = np.frombuffer(b"ab ba ab\x0bAB abab" + b"y" * (1 << 19), np.uint8)
    s, e, at = shared.word_spans(b, np.array([0, len(b)]))
    h = shared.word_hashes(b, s, e)
    assert len(h) == 5 and h[0] == h[2] and len(set(h.tolist())) == 4
    f = shared.word_hashes(b, s, e, fold=True)
    assert f[0] == f[2] == f[3]


def test_pack_round_trip():
    a = np.array([5, 5, 2**62, -3, 0])
    assert shared.unpack(shared.pack(a)).tolist() == a.tolist() and not len(shared.unpack(shared.pack(a[:0])))


def test_substring_dedup(odd, empty):
    got = sorted(((r.doc_id or -1, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(odd).collect()), key=str)
    assert len(got) == len(ODD)
    by = {(g[0], g[1]): g for g in got}
    assert by[(6, 3000)][2] == 0 and by[(7, 3000)][2] == 3000 and by[(7, 2)][2] == 0
    assert by[(-1, 16)][2] == 0 and by[(4, 16)][2] == 0 and by[(5, 16)][2] == 15  # its first word differs
    assert by[(1, 0)][3] == "" and substring_dedup.substring_dedup(empty).count() == 0


def test_ngram_join(odd, empty):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.ngram_jaccard_join(odd).collect()}
    assert got[(4, 13)] == 4 and got[(5, 13)] == 4 and got[(7, 1)] in (6, 7) and got[(1, 0)] == 1 and got[(2, 0)] == 2
    assert ngram_join.ngram_jaccard_join(odd).count() == len(ODD) and ngram_join.ngram_jaccard_join(empty).count() == 0


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = "zz" + str(rng.randint(0, 9))
            texts.append(" ".join(t))
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for w in map(str.split, texts)]
    up = signature_tree.Union(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                up.join(i, j)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: up.root(i) for i in range(len(sets))}


def test_signature_tree_loses_no_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(5, 900)).astype(np.uint64)
        for _ in range(rng.integers(1, 8)):
            keep = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.1])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])))

    def links(i, j):
        c = len(np.intersect1d(sets[i], sets[j]))
        return 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c)

    tree = signature_tree.Tree(np.array([len(s) for s in sets]), [signature_tree.bitmap(s, signature_tree.width_of(len(s), 1)) for s in sets], 85, 100)
    got, want = tree.forest(links), signature_tree.Union(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if links(i, j):
                want.join(i, j)
    assert [got.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def test_decontaminate(spark, odd, empty, monkeypatch):
    bench = spark.createDataFrame([(1, "c D; e f g h i j k l m n O"), (1, "c D; e f g h i j k l m n O"), (9, "Other!"), (8, None), (None, "x"), (7, "--")], "item_id long, text string")
    want = {(4, 16): (13, [1]), (5, 16): (13, [1]), (None, 16): (13, [1]), (7, 2): (1, [9])}
    for size in (dc.BLOCK_BYTES, 70):  # one block, several
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        rows = dc.decontaminate(odd, bench).collect()
        assert len(rows) == len(ODD)
        for r in rows:
            assert (r.n_hit, r["items"]) == want.get((r.doc_id, r.n_words), (0, []))
            assert r.contaminated == (r.n_hit > 0)
        assert {(s.start, s.end) for r in rows if r.doc_id == 4 for s in r.spans} == {(4, 29)}
    assert dc.decontaminate(empty, bench).count() == 0 and dc.decontaminate(odd, bench.where("false")).where("n_hit > 0").count() == 0


def test_substring_dedup_holds_little():
    """A block's arrays go as soon as they have been read, and batches of entries and texts stay small: workers count as executor memory."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 1 << 20, 2000).tolist())) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(rng.permutation(800)), pa.array(np.arange(800)), pa.array(texts)], names=["id", "print", "text"])
    tracemalloc.start()
    try:
        most = max(b.num_rows for b in substring_dedup._windows(13, 816)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most <= substring_dedup.BATCH_ROWS and peak < 100 * substring_dedup.BLOCK_WINDOWS
    whole = pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts), pa.nulls(800, pa.binary())], names=["id", "text", "runs"])
    assert [b.num_rows for b in substring_dedup._cut(iter([whole]), 13)] == [512, 288]


def test_windows_against_brute_force():
    rng = random.Random(1)
    vocabulary = [f"w{k}".encode() for k in range(30)]
    for _ in range(300):
        window = rng.choice([1, 2, 3, 5, 13])
        items = [(i, b" ".join(rng.choice(vocabulary[: rng.choice([2, 5, 30])]) for _ in range(rng.randint(0, 30)))) for i in range(6)]
        text = [rng.choice(vocabulary[: rng.choice([2, 5, 30])]) for _ in range(40)]
        for _ in range(2):
            if own := items[rng.randrange(6)][1].split():
                a = rng.randrange(len(own))
                at = rng.randrange(40)
                text[at:at] = own[a : rng.randint(a, len(own))]
        hit, which = set(), set()
        for item, own in items:
            own = own.split()
            k = min(window, len(own))
            known = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)} if k else set()
            for j in range(len(text) - k + 1):
                if tuple(text[j : j + k]) in known:
                    hit |= set(range(j, j + k))
                    which.add(item)
        runs, found = dc.Windows(items, window).hits(text)
        assert {x for a, z in runs for x in range(a, z)} == hit and found == which


def test_mixing(spark, odd, empty):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()))
    src, size = {r[0]: r[2] for r in rows}, {r[0]: len(r[1].split()) for r in rows}
    total, sizes, taken, target = sum(size.values()), {}, {}, {}
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.copies <= 3
        s = src[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.size * r.copies
        target[s] = r.target
    weight, free, left, want = dict(zip(sorted(sizes), [5, 2, 1, 5])), set(sizes), total, {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3 * sizes[s]
            left -= want[s]
        free -= over
    want |= share
    assert target == pytest.approx(want) and all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert mixing.mix_sources(odd).count() == len(ODD) and mixing.mix_sources(empty).count() == 0


def test_pivot_keeps_probabilities():
    """Copy probabilities are those asked for, whatever the sizes: means over many draws are within five standard errors."""
    sizes, p, n = [900, 300, 40, 30, 20, 10, 5, 5, 1], [0.3, 0.7, 0.2, 0.5, 0.9, 0.4, 0.6, 0.1, 0.5], 20_000
    total, rng = np.zeros(len(p)), random.Random(3)
    for _ in range(n):
        units = [[i, s, x] for i, (s, x) in enumerate(zip(sizes, p, strict=True))]
        held = mixing.pivot(units, rng)
        total += [u[-1] for u in units]
        assert all(u is held or u[-1] in (0.0, 1.0) for u in units)
    assert np.all(np.abs(total / n - p) < 5 * np.sqrt(0.25 / n))


def test_mixing_deals_equal_rows_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    monkeypatch.setattr(mixing, "SPREAD", 64)
    docs = spark.createDataFrame([(None, "w w w", "a")] * 900 + [(i, "w w", "b") for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 1200 and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(3)).collect()))
    taken = sum(r["size"] * r.copies for r in got if r.doc_id is None)
    assert abs(taken - next(r.target for r in got if r.doc_id is None)) <= 3
    sized = docs.select(F.col("doc_id").alias("id"), "source", F.lit(3).alias("size"), F.lit(0).alias("row"))
    assert mixing._numbered(sized).where("id is null").select("copy").distinct().count() == 900


def test_quality_base_counts(spark, odd, empty):
    texts = [t for _, t in ODD] + ["one two three four five one two three four five six", "l1 a\nl2\n\nl1 a\n \nl1 a", "a#b $ %% | <x> *", "é ü ß ñ a b c d e f g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = quality.quality_rules(docs, docs.select("doc_id").where("doc_id >= 4")).collect()
    assert len(out) == len(texts)
    for r in out:
        w = words(texts[r.doc_id])
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        rep = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 100 else set(range(len(w)))
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", texts[r.doc_id] or "")))
        assert (r.n_repeat_words, r.n_dup_lines) == (len(rep), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality_rules(odd, odd.where("false").select("doc_id")).count() == len(ODD) and quality.quality_rules(empty, empty.select("doc_id")).count() == 0


def test_quality_verdict_on_labels(spark):
    out = quality.op9_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in out if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_weights_against_brute_force(spark):
    texts = ["good word here", "good good thing", "bad spam spam spam", None, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality.bucket_weights(docs, docs.select("doc_id").where("doc_id < 2"), "doc_id", "text", buckets=32, prior=1.0).first().weights
    hashed = {w: (r.h, r.t) for w in {x for t in texts for x in words(t)} for r in [spark.sql(f"SELECT xxhash64('{w}') AS h, xxhash64(right('{w}', 3), 3) AS t").first()]}
    raw, own = np.zeros(32), np.zeros(32)
    for i, t in enumerate(texts):
        w = words(t)
        pairs = [spark.sql(f"SELECT xxhash64({hashed[a][0]}L, {hashed[b][0]}L) AS h").first().h for a, b in zip(w, w[1:])]
        for h in [hashed[x][0] for x in w] + [hashed[x][1] for x in w] + pairs:
            raw[h % 32] += 1
            own[h % 32] += i < 2
    want = np.log((own + 1) / (own.sum() / raw.sum() * raw + 1)) * quality.SCALE
    assert np.abs(np.array(got) - want).max() <= 1


def test_trusted_texts_are_not_toxic(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.trusted_ids(labels).collect()} == {1, None}


def test_quality_verdict_on_held_out_labels(spark):
    """Fitted on the labels of even ids, judged on those of odd ones."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.quality_rules(docs, quality.trusted_ids(labels.where("doc_id % 2 = 0"))).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.kept for r in out if r.quality == 1 and r.toxic == 0 and not r.base_failed]
    bad = [r.kept for r in out if r.quality == 0]
    assert len(good) > 100 and len(bad) > 20
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_training_order(spark, odd, empty):
    import base64

    import tiktoken

    with open(training_order.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=training_order.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for text in ["it's  two\n\n words 　x \x1c 12,3 ", "", " \n", "日本 é🙂"]:
        assert list(training_order.array("H", training_order.token_bytes(text))) == encode(text)
    rows = training_order.training_order(odd, length=8).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert sum(r.n_tokens for r in rows) == sum(len(encode(t or "")) + 1 for _, t in ODD) and training_order.training_order(empty).count() == 0


def slot_by_hand(x, n, key):
    """Feistel rounds on Python integers, walked until the number is in range."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    keys = [int.from_bytes(hashlib.blake2b(f"{key} {r}".encode(), digest_size=8).digest(), "little") for r in range(6)]
    m = 2**64 - 1
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for k in keys:
            h = right ^ k
            h ^= h >> 30
            h = h * 0xBF58476D1CE4E5B9 & m
            h ^= h >> 27
            h = h * 0x94D049BB133111EB & m
            h ^= h >> 31
            left, right = right, left ^ (h & ((1 << half) - 1))
        x = left << half | right
        if x < n:
            return x


def test_training_order_slots_by_hand(spark):
    rng = random.Random(8)
    docs = [(None if i % 9 == 0 else i // 2, " ".join(rng.choice(["a", "bb", "thing"]) for _ in range(rng.randint(0, 60)))) for i in range(60)] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    length, got = 8, training_order.training_order(df, length=8).collect()
    counted: dict = {}
    for d in docs:
        counted[d] = counted.get(d, 0) + 1
    rows = []
    keyed = spark.createDataFrame(list(counted), "id long, text string").selectExpr("id", "text", "xxhash64(text) AS print")
    keyed = keyed.selectExpr("*", f"pmod(xxhash64(id, print), {training_order.BUCKETS}) AS bucket").collect()
    for r in sorted(keyed, key=lambda r: (r.bucket, r.id is not None, r.id or 0, r.print)):
        raw = list(training_order.array("H", training_order.token_bytes(r.text))) + [training_order.END]
        for _ in range(counted[r.id, r.text]):
            rows += [(r.id, k // length, raw[k : k + length]) for k in range(0, len(raw), length)]
    want = {slot_by_hand(x, len(rows), 20240229): row for x, row in enumerate(rows)}
    assert len(got) == len(want)
    for r in got:
        i, seq, piece = want[r.slot]
        assert (r.doc_id, r.seq_no, r.n_tokens) == (i, seq, len(piece)) and list(training_order.array("H", r.tokens)) == piece + [training_order.END] * (length - len(piece))


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(training_order.feistel(np.arange(n), n, 5).tolist()) == list(range(n))


def test_shards_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * i) for i in range(40)], "doc_id long, text string")
    rows = training_order.training_order(docs, length=8, shard_size=16)
    first = training_order.write_shards(rows, str(tmp_path), 8).collect()
    assert sum(r.n_sequences for r in first) == rows.count()
    for r in rows.collect():
        assert training_order.read_slot(str(tmp_path), r.slot, 8, 16) == list(training_order.array("H", r.tokens))
    (tmp_path / "shard-000000.bin").unlink()
    assert len(training_order.write_shards(rows, str(tmp_path), 8).collect()) == len(first) and (tmp_path / "shard-000000.bin").exists()


def plain_tokens(model, word):
    """(tokens, pieces) on the best path by the plain recurrence over ends, ties to fewer tokens and shorter last pieces."""
    text, best = token_counts.MARK + word, [(0, 0, [])]
    for d in range(1, len(text) + 1):
        n = len(text[d - 1].encode())
        options = [] if text[d - 1] in model.of else [(best[-1][0] + n * model.byte, best[-1][1] + n, best[-1][2])]
        options += [(best[d - k][0] + model.of[text[d - k : d]], best[d - k][1] + 1, best[d - k][2] + [text[d - k : d]]) for k in range(1, min(d, model.longest) + 1) if text[d - k : d] in model.of]
        best.append(max(options, key=lambda x: (x[0], -x[1])))
    return best[-1][1], best[-1][2]


WORDS = ["thing", "things", "thin", "th", "éè", "日本語", "x" * 300, "a", "🙂a", "hello", "hell"]


def test_trie_against_plain_forward_scores():
    model = token_counts.Unigram(token_counts.vocabulary())
    rng = random.Random(2)
    some = list(dict.fromkeys(WORDS + ["".join(rng.choice("abcdeéßñ日") for _ in range(rng.randint(1, 18))) for _ in range(800)]))
    want = [plain_tokens(model, w) for w in some]
    import pyarrow as pa

    assert model.tokens(pa.array(some)).tolist() == [n for n, _ in want]
    weights = np.arange(1, len(some) + 1)
    found = dict(zip(model.pieces, model.piece_counts(pa.array(some), weights).tolist(), strict=True))
    counted: dict = {}
    for k, (_, pieces) in enumerate(want):
        for piece in pieces:
            counted[piece] = counted.get(piece, 0) + k + 1
    assert {k: n for k, n in found.items() if n} == counted


def test_token_counts_against_plain_estimation(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    count: dict = {}
    for w in (w for own in texts.values() for w in own):
        count[w] = count.get(w, 0) + 1
    pieces = token_counts.vocabulary()
    model = token_counts.Unigram(pieces)
    for _ in range(token_counts.ROUNDS):
        own: dict = {}
        for w, n in count.items():
            for piece in plain_tokens(model, w)[1]:
                own[piece] = own.get(piece, 0) + n
        model = token_counts.Unigram(pieces, [own.get(x, 0) for x in pieces])
    per_word = {w: plain_tokens(model, w)[0] for w in count}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs).collect()}
    assert got == {k: (len(own), sum(per_word[w] for w in own)) for k, own in texts.items()}
    again = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs.repartition(5)).collect()}
    assert again == got
    rows = token_counts.token_counts(odd, unigram=model).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert token_counts.token_counts(empty).count() == 0


def test_a_worker_forgets_and_counts_alike(monkeypatch):
    import pyarrow as pa

    model = token_counts.Unigram(token_counts.vocabulary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([" ".join(WORDS[k % 7 :]) for k in range(30)])], names=["id", "text"])
    want = list(token_counts._count(model)(iter([batch])))
    monkeypatch.setattr(token_counts, "KNOWN", 3)
    monkeypatch.setattr(shared, "SLICE_BYTES", 64)
    assert list(token_counts._count(model)(iter([batch, batch])))[1].equals(want[0])


def test_surrogates(spark, odd, empty):
    text = "Frau Anna Weber, Frau Weber: a.b@x.org c@x.org, 4111 1111 1111 1111, 1.2.3.4, (212) 555-0100, Господин Петров"
    docs = spark.createDataFrame([(1, text), (2, "call (212) 555-0100 now"), (2, None), (3, "no data")], "doc_id long, text string")
    rows = surrogates.replace_pii(docs, "k").collect()
    got = {r.doc_id: r.text for r in rows if r.text}
    assert len(rows) == 4 and got[3] == "no data"
    for x in ("Weber", "a.b@x.org", "4111", "1.2.3.4", "555-0100", "Петров"):
        assert x not in got[1] + got[2]
    phone = re.search(r"\(\d{3}\) \d{3}-\d{4}", got[2])[0]
    assert phone in got[1]
    names = re.match(r"Frau (\w+) (\w+), Frau (\w+):", got[1])
    assert names[1] in surrogates.NAMES["latin f"] and names[2] == names[3]
    assert len(set(re.findall(r"@(\S+\.org)", got[1]))) == 1 and re.search(r"Господин [А-Я][а-я]+", got[1])
    assert surrogates.replace_pii(odd, "k").count() == len(ODD) and surrogates.replace_pii(empty, "k").count() == 0


def test_surrogates_stay_apart(spark):
    ips = [f"{a}.{b}.1.1" for a in range(1, 10) for b in range(1, 10)]
    rows = surrogates.surrogate_table(spark.createDataFrame([(x,) for x in ips], "entity string"), "k").collect()
    out = {r.entity: r.surrogate for r in rows}
    assert len(out) == len(set(out.values())) == len(ips) and not set(ips) & set(out.values())


def test_surrogates_of_one_entity_in_two_formats(spark):
    pairs = [
        ("4111 1111 1111 1111", "4111111111111111"), ("+49 30 12345", "+49.30.12345"), ("(212) 555-0100", "212-555-0100"), ("Ann.Bee@X.org", "ann.bee@x.org"),
        ("DE44 5001 0517 5407 3249", "DE44500105175407324" + "9"), ("Mr. Smith", "Mr Smith"), ('token = "abcd1234efgh"', "TOKEN: abcd1234efgh"),
    ]
    other = ["4111-1111-1111-1112", "+49 30 12346", "a.bee@x.org", "+4 930 12345"]
    rows = surrogates.surrogate_table(spark.createDataFrame([(x,) for p in pairs for x in p] + [(x,) for x in other], "entity string"), "k").collect()
    out = {r.entity: r.surrogate for r in rows}

    def bare(x):
        return re.sub(r"[^a-z0-9@]", "", x.split('= "')[-1].split("TOKEN: ")[-1].lower())

    for a, b in pairs:
        assert bare(out[a]) == bare(out[b]) != bare(a) and (len(out[a]) == len(a) and len(out[b]) == len(b) or a.startswith("Mr")), (a, b)
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", out["4111 1111 1111 1111"]) and re.fullmatch(r"[A-Z][a-z]+\.[A-Z][a-z]+@[A-Z]\.org", out["Ann.Bee@X.org"])
    assert out["+49 30 12345"].startswith("+49 ") and out["Mr. Smith"].startswith("Mr. ") and out['token = "abcd1234efgh"'].endswith('"')
    assert len({bare(x) for x in out.values()}) == len(pairs) + len(other)


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(digits))) % 10


def shape(text):
    return re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", text)))


def test_surrogates_of_a_made_corpus(spark):
    """Held against what was planted: the texts around entities stay, equal entities get equal surrogates, others others, of one shape."""
    rng = random.Random(9)

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        base = "4" + digits(14)
        return next(base + c for c in "0123456789" if luhn(base + c) == 0)

    def iban():
        own = digits(18)
        return next(f"DE{k:02d}{own}" for k in range(2, 99) if mod97(f"DE{k:02d}{own}") == 1)

    people = [(g, f"{rng.choice(surrogates.GIVEN[g][:40])} {rng.choice(['Weber', 'Klein', 'Stone', 'Rivera', 'Novak'])}") for g in "fmfmfmfm"]
    made = {"email": [f"{rng.choice('abc')}.{rng.choice(['lee', 'roy'])}@{rng.choice(['x', 'y', 'mail.z'])}.org" for _ in range(12)], "card": [card() for _ in range(10)], "iban": [iban() for _ in range(10)]}
    made |= {"ssn": [f"{digits(3)}-{digits(2)}-{digits(4)}" for _ in range(10)], "ip": [f"{rng.randint(10, 99)}.{rng.randint(1, 9)}.1.{rng.randint(1, 9)}" for _ in range(10)], "secret": [f"password=пароль{k}-ключ" for k in range(5)] + ["password=!!!!!!??", "password=??!!!!!!"]}
    made |= {"name": [t for _, t in people] + [f"Dr. {t}" for _, t in people] + [f"{'Frau' if g == 'f' else 'Herr'} {t.split()[-1]}" for g, t in people]}
    texts, planted = [], []
    for _ in range(120):
        own = [rng.choice(made[k]) for k in rng.sample(sorted(made), 3)]
        planted.append(own)
        texts.append("start " + " then ".join(own) + " end.")
    rows = surrogates.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    new: dict = {}
    for r in rows:
        assert r.n_entities == 3, texts[r.doc_id]
        got = re.fullmatch("start (.*) then (.*) then (.*) end[.]", r.text)
        for a, b in zip(planted[r.doc_id], got.groups(), strict=True):
            assert new.setdefault(a, b) == b and a != b
    assert len(set(new.values())) == len(new) and not set(new) & set(new.values())
    for a, b in new.items():
        kind = next(k for k, own in made.items() if a in own)
        if kind in ("card", "ssn", "ip", "iban"):
            assert shape(a)[0] == shape(b)[0] and len(a) == len(b)
        if kind == "card":
            assert luhn(b) == 0
        if kind == "iban":
            assert mod97(b) == 1 and b[:2] == "DE"
        if kind == "email":
            assert {x.split("@")[1] for y, x in new.items() if y.split("@")[-1] == a.split("@")[1] and "@" in y} == {b.split("@")[1]}
        if kind == "secret":
            assert not set(a.split("=")[1]) - set("-!?") & set(b.split("=")[1]) or re.search("[а-я]", b)
            assert "пароль" not in b and "!!!!!!" not in b and len(a) == len(b)
    family = {}
    for g, t in people:
        for a in (t, f"Dr. {t}"):
            if a in new:
                given, last = new[a].removeprefix("Dr. ").split(" ")
                assert given.split("-")[0] in surrogates.NAMES[f"latin {g}"] and family.setdefault(t.split()[-1], last) == last
        a = f"{'Frau' if g == 'f' else 'Herr'} {t.split()[-1]}"
        if a in new:
            assert family.setdefault(t.split()[-1], new[a].split(" ")[1]) == new[a].split(" ")[1]
    assert len(set(family.values())) == len(family)


def test_surrogates_follow_the_key(spark):
    docs = spark.createDataFrame([(1, "mail a.b@x.org or Mr Smith")], "doc_id long, text string")
    one, again, other = (surrogates.replace_pii(docs, k).first().text for k in ("k", "k", "l"))
    assert one == again != other


def test_surrogates_of_hot_entities(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"from a@x.org to b{i % 7}@x.org") for i in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, surrogates.replace_pii(docs, "k").collect()))
    monkeypatch.setattr(surrogates, "HOT_ROWS", 20)
    assert sorted(map(tuple, surrogates.replace_pii(docs, "k").collect())) == want


def test_surrogates_of_secrets(spark):
    cases = {
        'token = "abcd1234efgh"': "abcd1234efgh", 'TOKEN = "0A1B2C3D4E5F60718293"': "0A1B2C3D4E5F60718293", "Password: Hunter22!": "Hunter22", 'password = "correct horse battery"': "horse",
        "password='qwerty77'": "qwerty77", 'api_key = "zyxw9876vuts"': "zyxw9876vuts", "SECRET_KEY=s3cr3tvalue": "s3cr3tvalue", '{"db_password": "swordfish"}': "swordfish", "access-token:  tkn55tkn55": "tkn55tkn55",
        "key: id_rsa_2048_abc": "id_rsa_2048_abc", "secret = 'mellon99'": "mellon99",
    }
    plain = ["the key: reading with care", "key = getValue", "token: https://x.org/page1", "a password is needed", "no secrets here"]
    rows = surrogates.replace_pii(spark.createDataFrame(list(enumerate([*cases, *plain])), "doc_id long, text string"), "k").collect()
    got = {r.doc_id: r for r in rows}
    for i, (text, value) in enumerate(cases.items()):
        assert got[i].n_entities == 1 and value not in got[i].text and len(got[i].text) == len(text), text
        assert got[i].text.split(value.split()[0])[0][:3] == text[:3]
    assert re.fullmatch(r'TOKEN = "[0-9A-F]{20}"', got[1].text)
    assert [got[len(cases) + i].text for i in range(len(plain))] == plain


def test_licenses(spark, odd, empty):
    assert all(re.search(licenses.CUES, s) for s in licenses.SENTENCES.values())
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"). The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    docs = spark.createDataFrame([(1, mit + "\nAll rights reserved."), (2, "Some words.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the software")], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_sentences, r.n_unruled) for r in licenses.license_scan(docs).collect()}
    assert got == {1: ("MIT,Proprietary", 4, 0), 2: ("", 1, 1)}
    own = licenses.license_scan(docs, sentences={"words": "some words"}, rules=[("Own", ["words"])]).collect()
    assert {r.doc_id: r.licenses for r in own} == {1: "", 2: "Own"}
    assert licenses.license_scan(odd).count() == len(ODD) and licenses.license_scan(empty).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_licenses_of_whole_wrapped_notices(spark):
    cases = [(MIT, "MIT", 3), (BSD.format("the copyright holder"), "BSD-3-Clause", 2), (BSD.format("Some Firm Inc."), "BSD-3-Clause", 2), (BSD.split("3.")[0], "BSD-2-Clause", 1)]
    cases += [(APACHE, "Apache-2.0", 3), (GPL3, "GPL", 1), (GPL2, "GPL", 1), (MPL, "MPL-2.0", 1)]
    styles = [lambda t: t, lambda t: re.sub("(?m)^", "# ", t), lambda t: "/*\n" + re.sub("(?m)^", " * ", t) + "\n */\n", lambda t: re.sub("(?m)^", ";; ", t), lambda t: re.sub("(?m)^", "dnl ", t), lambda t: t.replace("\n", "\r\n")]
    styles += [lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n"))]
    docs = [(f(text), want, n) for text, want, n in cases for f in styles]
    rows = licenses.license_scan(spark.createDataFrame([(i, d[0]) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.licenses, r.n_sentences, r.n_unruled) == (docs[r.doc_id][1], docs[r.doc_id][2], 0), docs[r.doc_id][0]
    cut = licenses.license_scan(spark.createDataFrame([(1, "All rights\n\nreserved"), (2, "All rights. Reserved"), (3, "words before\nAll rights\nreserved\nand after")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in cut} == {1: "", 2: "", 3: "Proprietary"}
    assert all(re.search(licenses.CUES, s) for s in licenses.NOTICES)


def extracted(model, page):
    nodes = html_main.flat(html_main.parse(page))
    return html_main.decode(nodes, model.score(html_main.features(nodes)))


def on_made_pages(model, seed, n, wraps):
    """(share of characters of main text found, share of those found that are main text) on pages not trained on."""
    rng, found, wanted, right = random.Random(seed), 0, 0, 0
    for _ in range(n):
        nodes, own = html_main.training_nodes(html_main.training_page(rng, wraps)[0])
        want = {x.text for x, o in zip(nodes, own, strict=True) if x.text and o}
        got = html_main.decode(nodes, model.score(html_main.features(nodes)))
        found, wanted, right = found + sum(map(len, got)), wanted + sum(map(len, want)), right + sum(len(x) for x in got if x in want)
    return right / wanted, right / found


def test_html_held_out():
    recall, precision = on_made_pages(html_main.model(), 77, 150, tuple(range(html_main.WRAPS)))
    assert recall >= 0.96 and precision >= 0.99


@pytest.mark.parametrize("out", [(0, 1, 2), (8,), (9,), (13,)])
def test_html_held_out_layouts(out):
    model = html_main.model(400, wraps=tuple(k for k in range(html_main.WRAPS) if k not in out))
    recall, precision = on_made_pages(model, 5, 100, out)
    assert recall >= 0.9 and precision >= 0.98


def test_html_pages_against_their_articles(spark):
    """Each page of the table has one article element: its text by a plain cut is what the trees find."""
    import html

    got = {r.page_id: r.text for r in html_main.op4_extract_main(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.sub(r"(?s)^.*?<article>|</article>.*$", "", r.html)
        blocks = re.sub(r"<[^>]+>", "\0", re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", article))
        assert got[r.page_id] == " ".join(html.unescape(blocks).replace("\0", " ").split())


NAMES_OF_ARTICLES = ["share-post", "comment-policy", "side-effects", "legal-news", "social-science", "related-work", "tags post", "post", "foo-post", "sidebar", "notice", "menu", "comments"]


@pytest.mark.parametrize("name", NAMES_OF_ARTICLES)
def test_no_class_name_empties_a_page(name):
    page = f'<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav><article class="{name}"><h1>A heading</h1><p>First paragraph of some length, with words enough to be read as prose.</p><p>Second paragraph, which goes on for a while and ends here.</p></article><footer>&copy; Us</footer></body></html>'
    assert len(extracted(html_main.model(), page)) == 3


PROSE = "<p>{0} began early, and people came from all over the valley to see it.</p><p>By noon the square was full; nobody remembered a year like this one, the mayor said.</p><p>In the evening there was music, and the last visitors left after midnight.</p>"
LAYOUTS = {
    "blog": '<div id="page"><header class="site-header"><h1><a href="/">My blog</a></h1><nav class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header><main id="main"><article class="post hentry"><header class="entry-header"><h2>Market day</h2></header><div class="entry-content">{}</div></article><section id="comments" class="comments-area"><h3>2 comments</h3><ol class="comment-list"><li class="comment"><p>Nice text, thanks for it.</p></li><li class="comment"><p>I was there too, it rained.</p></li></ol></section></main><aside class="widget-area sidebar"><h3>Archive</h3><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></aside><footer class="site-footer">&copy; 2020 Me</footer></div>',
    "news": '<header><div class="logo"><a href="/">Daily</a></div><nav><a href="/w">World</a> | <a href="/s">Sport</a></nav></header><div class="ad">Buy now and save a lot</div><main><article><h1>Market day</h1>{}<aside class="related"><h3>More</h3><ul><li><a href="/x">Other day</a></li></ul></aside></article></main><div class="cookie-notice"><p>We use cookies to make this better.</p><a href="#">Accept</a></div><footer>&copy; Daily</footer>',
    "old table": '<table><tr><td class="menu"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li><li><a href="/c">C</a></li></ul></td><td><h1>Market day</h1>{}</td></tr></table><div id="footer">&copy; 1999</div>',
    "bare": "<h1>Market day</h1>{}",
    "divs": '<div class="top"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></div><div class="wrap"><div class="c1"><div class="c2"><h1>Market day</h1>{}</div></div></div><div class="footer"><p>All about us</p></div>',
    "docs": '<nav class="sidebar"><ul><li><a href="/1">Start</a></li><li><a href="/2">Install</a></li><li><a href="/3">Use</a></li></ul></nav><main class="docs-content"><h1>Market day</h1>{}</main><form class="search"><input><button>Go</button></form>',
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts_of_real_life(name):
    page = "<html><body>" + LAYOUTS[name].format(PROSE.format("The market")) + "</body></html>"
    text = " ".join(extracted(html_main.model(), page))
    for part in ("The market began early", "nobody remembered", "left after midnight"):
        assert part in text
    for part in ("Home", "Archive", "thanks for it", "cookies", "Buy now", "2020", "Install", "Go", "World"):
        assert part not in text


def test_html_rows(spark):
    """No rows, repeated rows, a very long page, and columns of clashing names."""
    page = "<article><h1>Title of it</h1>" + "<p>Some words, and more of them, in a line.</p>" * 20_000 + "</article>"
    rows = [(1, "u", page, "x", 1), (1, "u", page, "x", 1), (2, "v", "<p>short</p>", None, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, id string, blocks int")
    out = html_main.extract_main(df).collect()
    assert len(out) == 3 and out[0].text == out[1].text and [len(r.blocks) for r in out if r.page_id == 1] == [20_001, 20_001]
    assert html_main.extract_main(df.where("false")).count() == 0


def test_html_edges(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Big &amp; news</h1><p>One <b>bo</b>ld line,<br>two lines here. And more words to read, in full.<p>Three</article><footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (4, "u", page[: page.index("</article")])]
    out = {r.page_id: r.text for r in html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Big & news One bold line, two lines here. And more words to read, in full. Three"
    assert out == {1: want, 2: "", None: "", 4: want}


def test_pipeline_keeps_columns_and_decides(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = c.quality_stage(spark, docs, DATA)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in quality.op9_quality_rules(spark, DATA).where("kept").collect()}
    assert {r.doc_id for r in good.select("doc_id").collect()} == kept
    clean = c.decontamination_stage(spark, docs, DATA)
    bad = {r.doc_id for r in dc.op3_decontaminate(spark, DATA).where("contaminated").collect()}
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad and clean.columns == docs.columns
    one = c.near_duplicate_stage(spark, docs, DATA)
    groups = ngram_join.ngram_jaccard_join(docs, k=5, num=80).select("component_id").distinct().count()
    assert one.count() == groups and one.columns == docs.columns
    mixed = c.mixing_stage(spark, docs, DATA)
    assert mixed.count() == mixing.mix_sources(docs).agg(F.sum("copies")).first()[0] and mixed.columns == docs.columns


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline as c

    long = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(3)]
    rows = [(7, long[0]), (7, long[0]), (None, long[0]), (3, long[0]), (None, long[1]), (None, long[1]), (7, long[2]), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = sorted(map(tuple, c.near_duplicate_stage(spark, docs, DATA).collect()), key=str)
    assert one == sorted([(3, long[0]), (None, long[1]), (7, long[2]), (None, ""), (None, "")], key=str)
    spark.createDataFrame([(1, long[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = sorted(map(tuple, c.decontamination_stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert clean == sorted([r for r in rows if r[1] != long[0]], key=str)
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else i // 2, f"t{i} " * rng.randint(1, 40), f"s{i % 2}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed, taken = c.mixing_stage(spark, docs, DATA).collect(), {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    target = {r.source: r.target for r in mixing.mix_sources(docs.withColumn("doc_id", F.monotonically_increasing_id())).join(docs.withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "source"), "doc_id").select("source", "target").distinct().collect()}
    assert taken == pytest.approx(target, abs=40) and any(r.doc_id is None for r in mixed)


def test_kept_digest(spark):
    r = substring_dedup.op7_substring_dedup(spark, DATA).where("n_removed = 0").first()
    text = spark.read.parquet(f"{DATA}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    assert r.kept_sha256 == hashlib.sha256(" ".join(words(text)).encode()).hexdigest()


def test_pipeline_run(spark):
    """Every kept text comes back whole from its sequences, as often as the mix takes it, in slots without gaps."""
    import base64

    import corpus_pipeline as c
    import tiktoken

    rows = c.run(spark, DATA).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, DATA), "stage")
    want: dict = {}
    for r in docs.collect():
        want[r.doc_id, r.text] = want.get((r.doc_id, r.text), 0) + 1
    with open(training_order.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    decode = tiktoken.Encoding("own", pat_str=training_order.PATTERN, mergeable_ranks=ranks, special_tokens={}).decode
    pieces: dict = {}
    for r in rows:
        own = list(training_order.array("H", r.tokens))[: r.n_tokens]
        pieces.setdefault(r.doc_id, {}).setdefault(r.seq_no, []).append(own)
    for (doc_id, text), n in want.items():
        parts = pieces.pop(doc_id)
        assert all(len(x) == n and all(y == x[0] for y in x) for x in parts.values())
        ids = [i for k in sorted(parts) for i in parts[k][0]]
        assert ids[-1] == training_order.END and decode(ids[:-1]) == text
    assert not pieces


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as c

    good = " ".join(f"word{k} and more" for k in range(30))
    rows = [(1, good, "s"), (1, good, "s"), (None, None, None), (2, "", "s"), (None, good + " other", None), (3, "x " * 5000, "t")]
    schema = "doc_id long, text string, source string"
    for name, given in (("odd", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(given, schema).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert c.run(spark, f"{tmp_path}/none").count() == 0
    ids = {r.doc_id for r in c.run(spark, f"{tmp_path}/odd").collect()}
    assert ids <= {1, None} and ids


@pytest.mark.parametrize("module, query", [(ngram_join, "op2_ngram_join"), (training_order, "op5_training_order"), (substring_dedup, "op7_substring_dedup")])
def test_results_are_the_same_without_broadcast(spark, monkeypatch, module, query):
    want = sorted(map(repr, queries.QUERIES[query](spark, DATA).collect()))
    monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    assert sorted(map(repr, queries.QUERIES[query](spark, DATA).collect())) == want


def test_mixing_without_broadcast(spark, monkeypatch):
    want = sorted(map(repr, mixing.op8_mix(spark, DATA).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    assert sorted(map(repr, mixing.op8_mix(spark, DATA).collect())) == want


def test_pipeline_without_broadcast(spark, monkeypatch):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")

    def results():
        return [sorted(map(repr, stage(spark, docs, DATA).collect())) for stage in (c.near_duplicate_stage, c.decontamination_stage, c.mixing_stage)]

    want = results()
    monkeypatch.setattr(c, "BROADCAST_IDS", -1)
    assert results() == want
