"""A prefix tree of globally ordered sets: overlap search with shared partial overlaps and length bounds.

Sets are sorted arrays of element ranks. Sorted lexicographically, neighbours share their common beginnings; the array
of common lengths gives the path-compressed tree at once. A probe walks the tree level by level: the overlap of a
node's path is computed once for all sets below it, and a subtree is left as soon as the elements that remain - the
probe's after the path's last element, or the longest rest below - cannot lift any of its sets to what it needs.
"""

from __future__ import annotations

import numpy as np

NEVER = np.int64(1) << 40


class Trie:
    def __init__(self, sets: list[np.ndarray]):
        """sets: arrays of ranks 0..U-1, each ascending, with at least one element."""
        n = len(sets)
        self.n = n
        self.size = np.fromiter(map(len, sets), dtype=np.int64, count=n)
        width = int(max((s[-1] for s in sets), default=-1)) + 1
        self.universe = width
        #: leaf k of the tree is set order[k]
        self.order = np.array(sorted(range(n), key=lambda i: sets[i].astype(">u4").tobytes()), dtype=np.int64)
        ordered = [sets[i] for i in self.order.tolist()]
        lcp = [0] * (n + 1)
        for k in range(1, n):
            a, b = ordered[k - 1], ordered[k]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            at = int(differ.argmax()) if m else 0
            lcp[k] = at if m and differ[at] else m
        lengths = self.size[self.order].tolist()
        # Nodes: (first leaf, last leaf + 1, depth at which its edge starts, depth at which it ends, level).
        nodes: list[tuple[int, int, int, int, int]] = []
        parents: list[int] = []
        todo = [(0, n, 0, 0, -1)] if n else []
        while todo:
            lo, hi, depth, level, parent = todo.pop()
            if hi - lo == 1:
                nodes.append((lo, hi, depth, lengths[lo], level))
                parents.append(parent)
                continue
            shared = min(lcp[lo + 1 : hi])
            me = len(nodes)
            nodes.append((lo, hi, depth, shared, level))
            parents.append(parent)
            cut = [lo] + [k for k in range(lo + 1, hi) if lcp[k] == shared] + [hi]
            todo += [(a, b, shared, level + 1, me) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        table = np.array(nodes, dtype=np.int64).reshape(-1, 5)
        order = np.argsort(table[:, 4], kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        table, parent = table[order], np.array(parents, dtype=np.int64)[order]
        self.parent = np.where(parent >= 0, place[parent], -1)
        self.lo, self.hi = table[:, 0], table[:, 1]
        self.is_leaf = self.hi - self.lo == 1
        edge = table[:, 3] - table[:, 2]
        self.edges = np.concatenate([ordered[lo][a:b] for lo, a, b in zip(table[:, 0].tolist(), table[:, 2].tolist(), table[:, 3].tolist(), strict=True)] or [np.empty(0, np.int64)]).astype(np.int64)
        self.edge_end = np.cumsum(edge)
        self.edge_start = self.edge_end - edge
        leaf_size = self.size[self.order]
        self.rest = np.array([leaf_size[lo:hi].max() for lo, hi in zip(self.lo.tolist(), self.hi.tolist(), strict=True)], dtype=np.int64) - table[:, 3]
        self.tail = np.array([ordered[lo][end - 1] if end else -1 for lo, end in zip(self.lo.tolist(), table[:, 3].tolist(), strict=True)], dtype=np.int64)
        self.levels = np.searchsorted(table[:, 4], np.arange(int(table[-1, 4]) + 2 if len(table) else 1))

    def probe(self, one: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets whose overlap with `one` reaches need[set], and those overlaps. need is indexed like `sets`; NEVER
        leaves a set out."""
        member = np.zeros(self.universe + 1, dtype=np.int64)
        member[one[one < self.universe]] = 1
        upto = np.cumsum(member)
        need = need[self.order]
        low = np.minimum.reduceat(np.append(need, NEVER), np.column_stack((self.lo, self.hi)).ravel())[::2] if len(self.lo) else np.empty(0)
        got = np.concatenate(([0], np.cumsum(member[self.edges])))
        own = got[self.edge_end] - got[self.edge_start]
        left = np.minimum(len(one) - np.where(self.tail >= 0, upto[self.tail], 0), self.rest)
        overlap = np.zeros(len(self.lo), dtype=np.int64)
        alive = np.zeros(len(self.lo), dtype=bool)
        for a, b in zip(self.levels[:-1].tolist(), self.levels[1:].tolist(), strict=True):
            above = self.parent[a:b]
            reach = np.where(above >= 0, alive[above], True)
            if not reach.any():
                break
            overlap[a:b] = np.where(above >= 0, overlap[above], 0) + own[a:b]
            alive[a:b] = reach & (overlap[a:b] + left[a:b] >= low[a:b])
        leaf = np.flatnonzero(self.is_leaf & alive)
        found = self.order[self.lo[leaf]]
        hit = overlap[leaf] >= need[self.lo[leaf]]
        return found[hit], overlap[leaf][hit]


def required(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    """Least overlap of sets of sizes a and b for which 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class Union:
    """Disjoint sets of 0..n-1; the root is the least member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
