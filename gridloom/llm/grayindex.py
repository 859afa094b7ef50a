"""Gray-order hierarchical index over 64-bit fingerprints: self-join within a Hamming radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Children of a node, and members of a leaf.
FAN = 16
#: Queries that descend the tree together, and meetings of queries and nodes looked at at once: they bound the memory.
QUERIES, MEETINGS = 512, 1 << 14


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.astype(np.uint64)
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


class GrayIndex:
    """Codes in Gray order, block by block, under one tree of shared bit patterns.

    levels[0] describes runs of FAN neighbouring codes, levels[i] runs of FAN nodes of levels[i - 1]. A node holds the
    mask of the bits on which all codes below it agree and their values; the bits that its parent already fixed are
    left out, so differences add up along a path and a whole group is dropped once the sum passes the radius. A node also
    holds the first and last block below it; groups of other blocks are dropped, too.

    met, far, other count the meetings of a query and a node that were looked at, and those of them that ended there
    because the differences passed the radius, or else because the node's blocks were others (or lay behind the query).
    """

    def __init__(self, codes: np.ndarray, block: np.ndarray | None = None):
        """codes: uint64, sorted by (block, gray_rank); block: ascending whole numbers, by default one for all."""
        self.codes = codes
        self.block = np.zeros(len(codes), dtype=np.int64) if block is None else block
        self.met = self.other = self.far = 0
        mask, pattern, low, high = np.full(len(codes), ~np.uint64(0)), codes, self.block, self.block
        levels = []
        while not levels or len(mask) > FAN:
            starts = np.arange(0, len(mask), FAN)
            ones, zeros = np.bitwise_and.reduceat(pattern | ~mask, starts), np.bitwise_or.reduceat(pattern & mask, starts)
            agree = np.bitwise_and.reduceat(mask, starts) & ~(ones ^ zeros)
            mask, pattern, low, high = agree, zeros & agree, low[starts], np.maximum.reduceat(high, starts)
            levels.append((mask, pattern, low, high))
        self.levels = []
        for i, (mask, pattern, low, high) in enumerate(levels):
            own = mask & ~np.repeat(levels[i + 1][0], FAN)[: len(mask)] if i + 1 < len(levels) else mask
            self.levels.append((own, pattern, low, high))
        self.rest = ~np.repeat(levels[0][0], FAN)[: len(codes)]

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j, of all codes of one block that differ in at most radius bits, a bounded part at a time."""
        n, top = len(self.codes), len(self.levels) - 1
        roots = len(self.levels[top][0])
        for first in range(0, n, QUERIES):
            q = np.arange(first, min(n, first + QUERIES))
            stack = [(top, np.repeat(q, roots), np.tile(np.arange(roots), len(q)), np.zeros(len(q) * roots, dtype=np.int16))]
            while stack:
                depth, query, node, sums = stack.pop()
                if len(query) > MEETINGS:
                    stack.append((depth, query[MEETINGS:], node[MEETINGS:], sums[MEETINGS:]))
                    query, node, sums = query[:MEETINGS], node[:MEETINGS], sums[:MEETINGS]
                mask, pattern, low, high = self.levels[depth]
                own = self.block[query]
                same = (low[node] <= own) & (own <= high[node]) & ((node + 1) * FAN ** (depth + 1) > query)
                sums = sums + np.bitwise_count((self.codes[query] ^ pattern[node]) & mask[node])
                keep = same & (sums <= radius)
                self.met += len(query)
                self.far += int((sums > radius).sum())
                self.other += int((~same & (sums <= radius)).sum())
                query, node, sums = query[keep], node[keep], sums[keep]
                if not len(query):
                    continue
                below = len(self.levels[depth - 1][0]) if depth else n
                query, sums = np.repeat(query, FAN), np.repeat(sums, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < below
                query, node, sums = query[real], node[real], sums[real]
                if depth:
                    stack.append((depth - 1, query, node, sums))
                    continue
                near = (node > query) & (self.block[query] == self.block[node])
                query, node, sums = query[near], node[near], sums[near]
                near = sums + np.bitwise_count((self.codes[query] ^ self.codes[node]) & self.rest[node]) <= radius
                yield query[near], node[near]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; label holds each position's smallest position so far, in place."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up
