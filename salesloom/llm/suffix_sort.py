"""Deep-shallow sorting of byte strings, and the repeated windows that sorted contexts tell.

Strings are rows of a matrix, each up to its own length. They are first ordered by multikey sorting, eight bytes a
symbol: each round orders what is still tied on its next symbol and goes on inside the ties. What is tied down to the
shallow depth shares a long prefix and goes through blind tries, which read a string's bytes only to compare it with one
other.
"""

from __future__ import annotations

import numpy as np

#: Bytes that multikey sorting looks at; ties beyond go through blind tries.
SHALLOW = 32


class BlindTrie:
    """Patricia trie of strings; a node knows where its strings first differ, and its children by that byte.

    The end of a string sorts before every byte.
    """

    __slots__ = ("root", "strings")

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    def _common(self, a: bytes, b: bytes) -> int:
        low, high = 0, min(len(a), len(b))
        while low < high:
            middle = (low + high + 1) >> 1
            if a[low:middle] == b[low:middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def add(self, k: int) -> None:
        """Nodes are [depth, children]; leaves are [-1, ids of equal strings]."""
        s = self.strings[k]
        if self.root is None:
            self.root = [-1, [k]]
            return
        node, size = self.root, len(s)
        while node[0] >= 0:  # blindly to some leaf: only the branching bytes are read
            c = s[node[0]] if node[0] < size else -1
            children = node[1]
            node = children[c] if c in children else next(iter(children.values()))
        other = self.strings[node[1][0]]
        depth = self._common(s, other)
        if depth == size == len(other):
            node[1].append(k)
            return
        c = s[depth] if depth < size else -1
        above, edge, node = None, None, self.root
        while 0 <= node[0] < depth:
            above, edge = node, s[node[0]]
            node = node[1][edge]
        if node[0] == depth:
            node[1][c] = [-1, [k]]
            return
        split = [depth, {c: [-1, [k]], (other[depth] if depth < len(other) else -1): node}]
        if above is None:
            self.root = split
        else:
            above[1][edge] = split

    def ordered(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out += node[1]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow_order(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Positions of the rows in order of group, then bytes; ``rows`` is padded with zeros to a multiple of eight."""
    order = np.argsort(group, kind="stable")
    tie = group[order]
    symbols = rows.view(">u8").astype(np.uint64)
    open_ = np.arange(len(order))  # places in ``order`` whose row is tied with a neighbour
    for level in range(SHALLOW // 8):
        at = order[open_]
        key = symbols[at, level]
        left = np.clip(lengths[at] - 8 * level, 0, 8)
        new = np.lexsort((left, key, tie[open_]))
        at, key, left, old = at[new], key[new], left[new], tie[open_][new]
        order[open_] = at
        split = np.ones(len(at), bool)
        split[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1]) | (left[1:] != left[:-1])
        sub = np.cumsum(split)
        tie[open_] = sub
        size = np.bincount(sub)
        still = (size[sub] > 1) & (left == 8)
        open_ = open_[still]
        if not len(open_):
            return order
    bounds = np.flatnonzero(np.concatenate([[True], tie[open_][1:] != tie[open_][:-1], [True]]))
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        places = open_[s:e]
        at = order[places]
        trie = BlindTrie([rows[k, SHALLOW : lengths[k]].tobytes() for k in at])
        for k in range(len(at)):
            trie.add(k)
        order[places] = at[trie.ordered()]
    return order


def common_prefixes(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in the order, the prefix shared with the one before; -1 where a group begins."""
    out = np.full(len(order), -1, np.int64)
    for s in range(1, len(order), 1 << 14):
        at = order[s - 1 : s + (1 << 14)]
        a, b = at[:-1], at[1:]
        differs = rows[a] != rows[b]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        shared = np.minimum(first, np.minimum(lengths[a], lengths[b]))
        out[s : s + len(b)] = np.where(group[a] == group[b], shared, -1)
    return out


def padded(strings: list[bytes], width: int) -> np.ndarray:
    joined = b"".join(s.ljust(width, b"\0") for s in strings)
    return np.frombuffer(joined, np.uint8).reshape(len(strings), width)


def repeated_windows(
    window: int, group: np.ndarray, strings: list[bytes], lead: np.ndarray, count: np.ndarray, place: np.ndarray
) -> np.ndarray:
    """Which windows of the strings start earlier too: a matrix, string by window.

    String i has ``count[i]`` windows, and an anchor ``lead[i]`` bytes from its start that lies in all of them. Equal
    windows of a group have their anchor at the same offset, so that two are equal where the contexts right of the
    anchors agree far enough, and those left of them. ``place`` (document, start) orders occurrences.
    """
    width = -(-window // 8) * 8
    n = len(strings)
    repeated = np.zeros((n, int(count.max(initial=0))), bool)
    right = [s[a:] for s, a in zip(strings, lead.tolist())]
    left = [s[:a][::-1] for s, a in zip(strings, lead.tolist())]
    shared, orders = [], []
    for contexts in (right, left):
        rows, lengths = padded(contexts, width), np.array([len(c) for c in contexts])
        order = deep_shallow_order(rows, lengths, group)
        orders.append(order)
        shared.append(common_prefixes(rows, lengths, group, order))
    reach = []
    for order, prefix in zip(orders, shared):
        best = np.empty(n, np.int64)
        best[order] = np.maximum(prefix, np.append(prefix[1:], -1))
        reach.append(best)
    may = reach[0] + reach[1] >= window
    if not may.any():
        return repeated
    by_place = np.lexsort((place[:, 1], place[:, 0]))
    by_place = by_place[may[by_place]]
    classes = np.empty((2, n), np.int64)
    for d in range(int((lead - count + 1)[may].min()), int(lead[may].max()) + 1):
        rows = by_place[(lead[by_place] >= d) & (lead[by_place] - count[by_place] < d)]
        rows = rows[(reach[0][rows] >= window - d) & (reach[1][rows] >= d)]
        if len(rows) < 2:
            continue
        for k, depth in ((0, window - d), (1, d)):
            classes[k, orders[k]] = np.cumsum(shared[k] < depth)
        key = classes[0, rows] * (n + 1) + classes[1, rows]
        new = np.argsort(key, kind="stable")
        key, rows = key[new], rows[new]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        first = rows[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        at, start = rows, place[rows, 1] + lead[rows] - d
        other = (place[at, 0] != place[first, 0]) | (start != place[first, 1] + lead[first] - d)
        repeated[at[other], (lead[at] - d)[other]] = True
    return repeated
