"""Signature trees over token sets: nodes hold OR-combined token bitmaps, size ranges and hash excess; two trees (or one and itself)
are traversed together, and a pair of nodes is left out when no members of it can overlap enough or all are connected already."""

from __future__ import annotations

import numpy as np

LEAF = 32
FAN = 8


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def width_of(n: int, spread: int) -> int:
    """Bits of a bitmap for n tokens: the least power of two, 64 at least, that is not under n * spread."""
    return max(64, 1 << (max(1, n * spread) - 1).bit_length())


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) at a smaller width; bits of equal rank modulo it are OR-combined."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


class Node:
    __slots__ = ("lo", "hi", "small", "large", "excess", "bits", "parts")

    def __init__(self, lo, hi, small, large, excess, bits, parts):
        self.lo, self.hi, self.small, self.large, self.excess, self.bits, self.parts = lo, hi, small, large, excess, bits, parts


class Tree:
    """Members in order of size; one tree (root) for each bitmap width. Sets link when den * |x & y| >= num * |x | y|."""

    def __init__(self, sizes: np.ndarray, bits: list[np.ndarray], num: int, den: int):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.num, self.den = num, den
        widths = np.array([len(bits[i]) for i in self.order])
        cuts = np.append(np.flatnonzero(np.diff(widths, prepend=-1)), len(widths))
        self.rows: list[tuple[int, np.ndarray, np.ndarray]] = []  # first member, bitmaps, excess
        self.roots = []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            own = np.stack([bits[i] for i in self.order[a:z]])
            excess = self.sizes[a:z] - np.bitwise_count(own).sum(axis=1).astype(np.int64)
            self.rows.append((int(a), own, excess))
            level = [self._node(len(self.rows) - 1, lo, min(lo + LEAF, int(z))) for lo in range(int(a), int(z), LEAF)]
            while len(level) > 1:
                level = [self._over(level[k : k + FAN]) for k in range(0, len(level), FAN)]
            self.roots.append((len(self.rows) - 1, level[0]))

    def _node(self, row, lo, hi):
        first, own, excess = self.rows[row]
        return Node(lo, hi, int(self.sizes[lo]), int(self.sizes[hi - 1]), int(excess[lo - first : hi - first].max()), np.bitwise_or.reduce(own[lo - first : hi - first], axis=0), None)

    @staticmethod
    def _over(parts):
        if len(parts) == 1:
            return parts[0]
        return Node(parts[0].lo, parts[-1].hi, parts[0].small, parts[-1].large, max(p.excess for p in parts), np.bitwise_or.reduce([p.bits for p in parts], axis=0), parts)

    def forest(self, exact=None, groups: np.ndarray | None = None) -> Union:
        """Components of the links among the members (places as given). exact(i, j): whether a pair that may link does; without it,
        a pair that the bitmaps allow counts as linked. groups: only members of different groups are compared."""
        self.union, self.exact = Union(len(self.sizes)), exact
        self.groups = None if groups is None else groups[self.order]
        for x, (row, a) in enumerate(self.roots):
            self._dual(row, a, row, a)
            for row2, b in self.roots[x + 1 :]:
                self._dual(row, a, row2, b)
        out = Union(len(self.sizes))
        for k in range(len(self.sizes)):
            out.join(int(self.order[k]), int(self.order[self.union.root(k)]))
        return out

    def _connected(self, a: Node, b: Node) -> bool:
        root = self.union.root
        first = root(a.lo)
        return all(root(i) == first for i in range(a.lo, a.hi)) and all(root(i) == first for i in range(b.lo, b.hi))

    def _dual(self, row, a: Node, row2, b: Node) -> None:
        """a is b, or all of a comes before b."""
        if a is not b:
            if self.num * b.small > self.den * a.large:
                return
            words = min(len(a.bits), len(b.bits))
            most = int(np.bitwise_count(fold(a.bits, words) & fold(b.bits, words)).sum())
            ea, eb = (x.excess if len(x.bits) == words else x.large for x in (a, b))  # folding adds to the excess
            if (self.num + self.den) * min(most + min(ea, eb), a.large, b.large) < self.num * (a.small + b.small):
                return
        if self._connected(a, b):
            return
        if a.parts is None and b.parts is None:
            self._leaves(row, a, row2, b)
        elif a is b:
            for i, x in enumerate(a.parts):
                for y in a.parts[i:]:
                    self._dual(row, x, row2, y)
        elif b.parts is None or a.parts is not None and a.hi - a.lo >= b.hi - b.lo:
            for x in a.parts:
                self._dual(row, x, row2, b)
        else:
            for y in b.parts:
                self._dual(row, a, row2, y)

    def _leaves(self, row, a: Node, row2, b: Node) -> None:
        (f, own, ex), (f2, own2, ex2) = self.rows[row], self.rows[row2]
        x, y, ex, ex2 = own[a.lo - f : a.hi - f], own2[b.lo - f2 : b.hi - f2], ex[a.lo - f : a.hi - f], ex2[b.lo - f2 : b.hi - f2]
        sa, sb = self.sizes[a.lo : a.hi], self.sizes[b.lo : b.hi]
        words = min(x.shape[1], y.shape[1])
        if x.shape[1] > words:
            x = fold(x, words)
            ex = sa - np.bitwise_count(x).sum(axis=1).astype(np.int64)
        if y.shape[1] > words:
            y = fold(y, words)
            ex2 = sb - np.bitwise_count(y).sum(axis=1).astype(np.int64)
        most = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(axis=2).astype(np.int64) + np.minimum(ex[:, None], ex2[None, :])
        most = np.minimum(most, np.minimum(sa[:, None], sb[None, :]))
        can = (self.num + self.den) * most >= self.num * (sa[:, None] + sb[None, :])
        if self.groups is not None:
            can &= self.groups[a.lo : a.hi][:, None] != self.groups[b.lo : b.hi][None, :]
        if a is b:
            can = np.triu(can, 1)
        union, exact, order = self.union, self.exact, self.order
        for i, j in zip(*(z.tolist() for z in np.nonzero(can)), strict=True):
            i, j = a.lo + i, b.lo + j
            if union.root(i) != union.root(j) and (exact is None or exact(int(order[i]), int(order[j]))):
                union.join(i, j)
