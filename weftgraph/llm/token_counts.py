"""Token counts under a unigram model, by trie-shared dynamic programming.

The pieces come from a vocabulary file; their probabilities are estimated here, from the corpus: distinct pre-tokens and their counts
are gathered over all texts, and ROUNDS rounds of hard expectation-maximisation count the pieces on the best path of each. Counts and
scores are integers, so the model doesn't depend on how rows are dealt.

Distinct pre-tokens of a block of text go into a trie of characters, level by level. A node's forward score is the best sum of scores
over the cuts of the prefix that ends there, computed once from its ancestors' scores, whatever the number of pre-tokens that share it;
a pre-token's count is that of its terminal node. A worker keeps the counts of pre-tokens it has met.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import materialise, text_slices, word_hashes, word_spans

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS = 2
#: Scores are integers in 1/SCALE nats.
SCALE = 1 << 16
#: Pre-tokens whose counts a worker keeps, at 16 bytes each; results don't depend on it.
KNOWN = 2_000_000
#: Pre-tokens of a trie.
TRIE = 100_000
#: Longer pre-tokens are walked by themselves.
LONGEST = 256
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str = MODEL) -> list[str]:
    """The pieces of a vocabulary file, most frequent first; without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    normal.sort(key=lambda i: (-model.get_score(i), i))
    return list(dict.fromkeys(map(model.id_to_piece, normal)))


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
    return h


class Unigram:
    """Pieces with integer scores. A character that is no piece of its own is cut into its UTF-8 bytes, each at the score `byte`."""

    def __init__(self, pieces: list[str], counts: list[int] | None = None):
        n = len(pieces)
        if counts is None:  # before any round: as for words whose frequency falls with their rank
            weights = [1 / (r + 2) for r in range(n)]
        else:
            weights = [c + 1 for c in counts]
        total = math.fsum(weights)
        self.pieces, self.scores = pieces, np.array([round(SCALE * math.log(w / total)) for w in weights], np.int64)
        self.byte = int(self.scores.min()) - round(SCALE * math.log(256)) if n else -SCALE
        self.of = {p: int(s) for p, s in zip(pieces, self.scores, strict=True)}
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_size.setdefault(len(p), []).append(i)
        self.longest = max(by_size, default=1)
        self.by_size = {}
        for size, own in by_size.items():
            hashes, own = np.array([_hash(pieces[i]) for i in own], np.uint64), np.array(own)
            order = np.argsort(hashes)
            self.by_size[size] = (hashes[order], own[order])
        self.power = np.array([pow(int(_BASE), k, 2**64) for k in range(self.longest + 1)], np.uint64)

    def walk(self, word: str) -> tuple[int, list[int]]:
        """(number of tokens, pieces) on the best path of MARK + word; of equal scores that of fewer tokens, then of shorter last pieces."""
        text, best = MARK + word, [(0, 0, 0)]
        index = self._index()
        back: list[int] = [-1]
        for d in range(1, len(text) + 1):
            got, piece = None, -1
            if text[d - 1] not in self.of:
                n = len(text[d - 1].encode())
                got = (best[d - 1][0] + n * self.byte, -best[d - 1][1] - n, d - 1)
            for size in range(1, min(d, self.longest) + 1):
                s = self.of.get(text[d - size : d])
                if s is not None:
                    new = (best[d - size][0] + s, -best[d - size][1] - 1, d - size)
                    if got is None or new[:2] > got[:2]:
                        got, piece = new, index[text[d - size : d]]
            best.append((got[0], -got[1], got[2]))
            back.append(piece)
        pieces, d = [], len(text)
        while d:
            if back[d] >= 0:
                pieces.append(back[d])
            d = best[d][2]
        return best[-1][1], pieces

    def _index(self) -> dict[str, int]:
        if not hasattr(self, "_at"):
            self._at = {p: i for i, p in enumerate(self.pieces)}
        return self._at

    def trie(self, words: pa.Array, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(tokens of each of the distinct `words`, how often each piece is on their best paths, words counted `weights` times)."""
        order = pc.sort_indices(words).to_numpy()
        sorted_ = words.take(pa.array(order))
        size = pc.utf8_length(sorted_).to_numpy().astype(np.int64)
        chars = np.frombuffer("".join(sorted_.to_pylist()).encode("utf-32-le"), np.uint32)
        start = np.cumsum(size) - size
        out = np.zeros(len(words), np.int64)
        # by depth: prefix hash, best score, tokens, parent; piece, its size and where it begins on the best path
        hashes, best, tokens, parents, last = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [None]
        active, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        ends = []
        d = 0
        while len(active):
            d += 1
            char = chars[start[active] + d - 2] if d > 1 else np.full(len(active), ord(MARK), np.uint32)
            new = np.ones(len(active), bool)
            new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
            parent, c = node[new], char[new]
            node = np.cumsum(new) - 1
            own = hashes[d - 1][parent] * _BASE + (c.astype(np.uint64) + np.uint64(1))
            n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000).astype(np.int64)
            score, count = best[d - 1][parent] + n_bytes * self.byte, tokens[d - 1][parent] + n_bytes
            piece, at, depth = np.full(len(c), -1), parent.copy(), np.full(len(c), d - 1)
            above = parent
            for k in range(1, min(d, self.longest) + 1):
                if k > 1:
                    above = parents[d - k + 1][above]
                if k not in self.by_size:
                    continue
                keys, ids = self.by_size[k]
                h = own - hashes[d - k][above] * self.power[k]
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == h)
                if not len(hit):
                    continue
                ids, up = ids[place[hit]], above[hit]
                s, t = best[d - k][up] + self.scores[ids], tokens[d - k][up] + 1
                take = np.ones(len(hit), bool) if k == 1 else (s > score[hit]) | ((s == score[hit]) & (t < count[hit]))
                hit, up = hit[take], up[take]
                score[hit], count[hit], piece[hit], at[hit], depth[hit] = s[take], t[take], ids[take], up, d - k
            hashes.append(own)
            best.append(score)
            tokens.append(count)
            parents.append(parent)
            last.append((piece, at, depth))
            done = size[active] == d - 1
            out[order[active[done]]] = count[node[done]]
            ends.append((active[done], node[done]))
            active, node = active[~done], node[~done]
        if weights is None:
            return out, None
        found = np.zeros(len(self.pieces), np.int64)
        flow = [np.zeros(len(b), np.int64) for b in best]
        for k in range(d, 0, -1):
            words_, nodes = ends[k - 1]
            np.add.at(flow[k], nodes, weights[order[words_]])
            piece, at, depth = last[k]
            real = piece >= 0
            np.add.at(found, piece[real], flow[k][real])
            for to in np.unique(depth):
                mine = depth == to
                np.add.at(flow[to], at[mine], flow[k][mine])
        return out, found

    def tokens(self, words: pa.Array) -> np.ndarray:
        """The number of tokens of each of some distinct words."""
        out = np.zeros(len(words), np.int64)
        long = pc.greater(pc.utf8_length(words), LONGEST).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(long).tolist():
            out[i] = self.walk(words[i].as_py())[0]
        short = np.flatnonzero(~long)
        for k in range(0, len(short), TRIE):
            part = short[k : k + TRIE]
            out[part] = self.trie(words.take(pa.array(part)))[0]
        return out

    def piece_counts(self, words: pa.Array, weights: np.ndarray) -> np.ndarray:
        found = np.zeros(len(self.pieces), np.int64)
        long = pc.greater(pc.utf8_length(words), LONGEST).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(long).tolist():
            np.add.at(found, self.walk(words[i].as_py())[1], weights[i])
        short = np.flatnonzero(~long)
        for k in range(0, len(short), TRIE):
            part = short[k : k + TRIE]
            found += self.trie(words.take(pa.array(part)), weights[part])[1]
        return found


def _strings(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([raw[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()).cast(pa.string())


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> the distinct pre-tokens of a slice, with their counts."""
    for batch in batches:
        for _, _, b, off in text_slices(batch.column(0)):
            s, e, _ = word_spans(b, off)
            if len(s):
                _, first, n = np.unique(word_hashes(b, s, e), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_strings(b.tobytes(), s[first], e[first]), pa.array(n, pa.int64())], names=["word", "n"])


def _pieces_of(model: Unigram):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(model.pieces), np.int64)
        for batch in batches:
            if batch.num_rows:
                found += model.piece_counts(batch.column(0).cast(pa.string()), batch.column(1).to_numpy())
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["piece", "n"])

    return run


def estimate(docs: DataFrame, text_col: str = "text", model: str = MODEL, rounds: int = ROUNDS) -> Unigram:
    """The vocabulary's pieces with probabilities from all texts: each round counts the pieces on the best paths of all distinct
    pre-tokens under the scores of the round before, and adds one to each. What comes to the driver is one number a piece."""
    pieces = vocabulary(model)
    unigram = Unigram(pieces)
    if rounds:
        src = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
        words = src.mapInArrow(_distinct, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        words = materialise(words, "pretokens")
        for _ in range(rounds):
            rows = words.mapInArrow(_pieces_of(unigram), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
            counts = [0] * len(pieces)
            for r in rows:
                counts[r.piece] = r.n
            unigram = Unigram(pieces, counts)
    return unigram


class _Known:
    """Hashes of pre-tokens met so far, ascending, and their tokens."""

    def __init__(self, model: Unigram):
        self.model, self.hashes, self.n = model, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, hashes: np.ndarray, words) -> np.ndarray:
        """The tokens of words by their ascending distinct hashes; words(places) gives those that are new as strings."""
        out, new = np.zeros(len(hashes), np.int64), np.ones(len(hashes), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            new = self.hashes[at] != hashes
            out[~new] = self.n[at[~new]]
        if new.any():
            out[new] = self.model.tokens(words(np.flatnonzero(new)))
            if len(self.hashes) + int(new.sum()) > KNOWN:
                self.hashes, self.n = hashes[:KNOWN], out[:KNOWN]
            else:
                every = np.concatenate([self.hashes, hashes[new]])
                order = np.argsort(every, kind="stable")
                self.hashes, self.n = every[order], np.concatenate([self.n, out[new]])[order]
        return out


def _count(model: Unigram):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model)
        for batch in batches:
            words_n, tokens_n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j, b, off in text_slices(batch.column(1)):
                s, e, at = word_spans(b, off)
                words_n[i:j] = np.diff(at)
                if len(s):
                    hashes, first, which = np.unique(word_hashes(b, s, e), return_index=True, return_inverse=True)
                    raw = b.tobytes()
                    n = known.of(hashes, lambda k, raw=raw, s=s, e=e, first=first: _strings(raw, s[first[k]], e[first[k]]))
                    sums = np.append(0, np.cumsum(n[which]))
                    tokens_n[i:j] = sums[at[1:]] - sums[at[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_n), pa.array(tokens_n)], names=["id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, unigram: Unigram | None = None) -> DataFrame:
    """(id_col, n_pretokens, n_tokens) for each row of `docs`; pre-tokens are the runs of other than ASCII white space. `unigram`: a
    model estimated before, else it is estimated from these texts.

    - A character that is no piece counts as its UTF-8 bytes. A null or blank text has no tokens. Texts are counted whole.
    - Null and repeated ids and rows are kept, each row by itself. Other columns don't matter. No rows give no rows.
    - 64-bit hashes stand for pre-tokens in a worker; among w distinct ones about w*w/2**65 pairs collide.
    """
    unigram = unigram or estimate(docs, text_col, model)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_count(unigram), "id long, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
