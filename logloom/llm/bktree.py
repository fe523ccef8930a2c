"""BK-trees over bit fingerprints: children are keyed by their integer Hamming distance to the parent.

A forest of trees, one per group of rows, is built and searched level by level in numpy, so thousands of small trees cost a few array operations
and a large one costs as many as it is deep.
"""

from __future__ import annotations

import numpy as np


class BKForest:
    """Trees over the rows of ``prints`` (n x lanes, unsigned 64-bit); ``group`` numbers the tree of each row, ascending from 0."""

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        self.prints, self.far = prints, 64 * prints.shape[1] + 1
        _, self.roots = np.unique(group, return_index=True)
        at = self.roots[group]  # the node below which each row still has to be hung
        left = np.flatnonzero(at != np.arange(len(at)))
        keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(left):
            edge = at[left] * self.far + self.distance(left, at[left])
            own, first, which = np.unique(edge, return_index=True, return_inverse=True)
            hung = left[first]
            keys.append(own)
            nodes.append(hung)
            at[left] = hung[which]
            left = left[at[left] != left]
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(keys)
        self.keys, self.children = keys[order], nodes[order]

    def distance(self, a: np.ndarray, b: np.ndarray, prints: np.ndarray | None = None) -> np.ndarray:
        """Hamming distances of rows ``a`` (of ``prints``, if given) and nodes ``b``."""
        return np.bitwise_count((self.prints if prints is None else prints)[a] ^ self.prints[b]).sum(1, dtype=np.int64)

    def search(self, prints: np.ndarray, group: np.ndarray, radius: int, slice_rows: int = 2048):
        """Pairs (query, node) within ``radius``, in slices; query i looks only into the tree ``group[i]``.

        At a node at distance d only the edges d - radius to d + radius are followed: the triangle inequality rules the others out.
        """
        for lo in range(0, len(prints), slice_rows):
            query = np.arange(lo, min(lo + slice_rows, len(prints)))
            node = self.roots[group[query]]
            hits = []
            while len(query):
                d = self.distance(query, node, prints)
                near = d <= radius
                hits.append((query[near], node[near]))
                start = np.searchsorted(self.keys, node * self.far + np.maximum(d - radius, 0))
                stop = np.searchsorted(self.keys, node * self.far + np.minimum(d + radius, self.far - 1), "right")
                n = stop - start
                query = np.repeat(query, n)
                node = self.children[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            yield tuple(np.concatenate(x) for x in zip(*hits))
