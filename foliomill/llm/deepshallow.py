"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, then blind tries for long common prefixes.

Sorts the suffixes of one buffer within groups given beforehand, all groups at once; a suffix counts for its first `width` bytes.

Shallow: multikey quicksort on symbols of 8 bytes. In each round every open segment is parted by a pivot into the lower, the
equal and the higher; the equal go on to the next symbol.

Deep: segments that are equal down to the shallow depth have long common prefixes, and become blind tries. An inner node holds
only a skip depth (the bit at which its leaves part) and two children by that bit. A suffix searches blindly, looking at no
other bits than the nodes', and is compared with the one leaf it comes to. If it is equal it joins the leaf; else the first
bit that differs says on which edge of its path a node with a leaf of its own belongs. Of suffixes that belong on one edge one
is hung in, the others search again; so a round serves all edges of all tries.
"""

from __future__ import annotations

import numpy as np

#: Depth of the shallow phase, in symbols.
SHALLOW = 5
#: Suffixes compared with their leaves at once.
BLOCK = 1 << 15


def symbols(buf: np.ndarray) -> np.ndarray:
    """At each offset the next 8 bytes as one big-endian number; zeros follow the end."""
    w = np.zeros(len(buf) + 8, np.uint64)
    w[: len(buf)] = buf
    for k in (1, 2, 4):
        w[:-k] = w[:-k] << np.uint64(8 * k) | w[k:]
    return w


def bit_of(w: np.ndarray, pos: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The bit numbered `bit` of each suffix."""
    return (w[pos + (bit >> 6 << 3)] >> (63 - (bit & 63)).astype(np.uint64) & np.uint64(1)).astype(bool)


def multikey(w: np.ndarray, out: np.ndarray, group: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorts `out` by its first `depth` symbols within groups (given in order). Returns the segments left equal: (first, size)."""
    equal: list[tuple[np.ndarray, np.ndarray]] = []
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(out)))
    at = np.zeros(len(first), np.int64)  # the symbol that each segment is parted by
    while True:
        done = at >= depth
        if done.any():
            equal.append((first[done], size[done]))
        keep = ~done & (size > 1)
        first, size, at = first[keep], size[keep], at[keep]
        if not len(first):
            return equal
        begin = np.cumsum(size) - size
        slot = np.repeat(first - begin, size) + np.arange(int(size.sum()))
        held = out[slot]
        key = w[held + 8 * np.repeat(at, size)]
        a, b, c = key[begin], key[begin + size // 2], key[begin + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)  # the middle of three
        low, high = key < pivot, key > pivot
        n_low, n_high = (np.add.reduceat(x, begin, dtype=np.int64) for x in (low, high))
        n_same = size - n_low - n_high
        before_low, before_high = (np.cumsum(x) - x for x in (low, high))
        before_low -= np.repeat(before_low[begin], size)
        before_high -= np.repeat(before_high[begin], size)
        within = slot - np.repeat(first, size)
        to = np.where(low, before_low, np.where(high, np.repeat(n_low + n_same, size) + before_high, np.repeat(n_low, size) + within - before_low - before_high))
        out[np.repeat(first, size) + to] = held
        first = np.concatenate([first, first + n_low, first + n_low + n_same])
        at = np.concatenate([at, at + 1, at])
        size = np.concatenate([n_low, n_same, n_high])


class Tries:
    """A blind trie for each of some groups of suffixes that share their first `start` bytes. A node made for suffix i is
    numbered i; as a child, leaf i is written ~i."""

    def __init__(self, w: np.ndarray, pos: np.ndarray, first: np.ndarray, size: np.ndarray, start: int, width: int):
        self.w, self.pos, self.first, self.size = w, pos, first, size
        self.steps = np.arange(start, width, 8)
        self.rest = np.uint64((1 << 64) - (1 << 64 - 8 * ((width - start - 1) % 8 + 1)))  # bits of the last symbol that count
        n = len(pos)
        self.group = np.repeat(np.arange(len(first)), size)
        self.bit, self.child = np.zeros(n, np.int64), np.zeros(2 * n + len(first), np.int64)  # children of nodes, then roots
        self.root = 2 * n
        self.child[self.root :] = ~first
        self.leaf = np.arange(n)
        todo = np.ones(n, bool)
        todo[first] = False
        self._insert(np.flatnonzero(todo))

    def _descend(self, x: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """The edge (place in `child`) at which the blind search of each suffix ends: at a leaf, or above a node beyond bit `until`."""
        edge = self.root + self.group[x]
        live = np.arange(len(x))
        while True:
            node = self.child[edge[live]]
            go = node >= 0
            if until is not None:
                go &= self.bit[np.maximum(node, 0)] < until[live]
            live, node = live[go], node[go]
            if not len(live):
                return edge
            edge[live] = 2 * node + bit_of(self.w, self.pos[x[live]], self.bit[node])

    def _parting(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first bit at which each suffix of x differs from that of y; -1 if none does."""
        out = np.empty(len(x), np.int64)
        for s in range(0, len(x), BLOCK):
            e = slice(s, s + BLOCK)
            d = self.w[self.pos[x[e], None] + self.steps] ^ self.w[self.pos[y[e], None] + self.steps]
            d[:, -1] &= self.rest
            k = (d != 0).argmax(axis=1)
            d = d[np.arange(len(d)), k]
            same = d == 0
            for shift in (1, 2, 4, 8, 16, 32):
                d |= d >> np.uint64(shift)
            out[e] = np.where(same, -1, 8 * self.steps[k] + 64 - np.bitwise_count(d))
        return out

    def _insert(self, x: np.ndarray) -> None:
        while len(x):
            y = ~self.child[self._descend(x)]
            bit = self._parting(x, y)
            same = bit < 0
            self.leaf[x[same]] = y[same]
            x, bit = x[~same], bit[~same]
            edge = self._descend(x, bit)
            edge, chosen = np.unique(edge, return_index=True)
            new, at = x[chosen], bit[chosen]
            side = bit_of(self.w, self.pos[new], at)
            self.bit[new] = at
            self.child[2 * new + side], self.child[2 * new + ~side] = ~new, self.child[edge]
            self.child[edge] = new
            x = np.delete(x, chosen)

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order by group, whether each equals the one before it)."""
        n = len(self.pos)
        weight = np.bincount(self.leaf, minlength=n)  # suffixes at each leaf
        levels, nodes = [], self.child[self.root :]
        nodes = nodes[nodes >= 0]
        while len(nodes):
            levels.append(nodes)
            nodes = np.concatenate([self.child[2 * nodes], self.child[2 * nodes + 1]])
            nodes = nodes[nodes >= 0]
        under = np.zeros(n, np.int64)  # suffixes below each node
        count = lambda c: np.where(c >= 0, under[np.maximum(c, 0)], weight[np.maximum(~c, 0)])
        for nodes in reversed(levels):
            under[nodes] = count(self.child[2 * nodes]) + count(self.child[2 * nodes + 1])
        begin, leaf_begin = np.zeros(n, np.int64), np.zeros(n, np.int64)

        def put(c: np.ndarray, where: np.ndarray) -> None:
            inner = c >= 0
            begin[c[inner]], leaf_begin[~c[~inner]] = where[inner], where[~inner]

        put(self.child[self.root :], self.first)
        for nodes in levels:
            left = self.child[2 * nodes]
            put(left, begin[nodes])
            put(self.child[2 * nodes + 1], begin[nodes] + count(left))
        at = leaf_begin[self.leaf]
        by = np.argsort(at, kind="stable")
        return by, np.append(False, at[by][1:] == at[by][:-1])


def order(buf: np.ndarray, pos: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted, equal): `pos` with each group (a run of equal numbers) in order of the `width` bytes there, and whether each
    equals the one before it in its group. Every position needs `width` bytes in the buffer."""
    w = symbols(buf)
    out, equal = pos.copy(), np.zeros(len(pos), bool)
    depth = min(SHALLOW, width // 8)
    open_ = multikey(w, out, group, depth)
    if not open_:
        return out, equal
    first, size = (np.concatenate([x[i] for x in open_]) for i in (0, 1))
    some = size > 1
    first, size = first[some], size[some]
    if not len(first):
        return out, equal
    begin = np.cumsum(size) - size
    slot = np.repeat(first - begin, size) + np.arange(int(size.sum()))
    if 8 * depth >= width:  # nothing is left to look at
        equal[slot] = True
        equal[first] = False
        return out, equal
    by, same = Tries(w, out[slot], begin, size, 8 * depth, width).order()
    out[slot], equal[slot] = out[slot[by]], same
    return out, equal
