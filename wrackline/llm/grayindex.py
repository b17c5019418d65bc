"""A hierarchical index over fingerprints in Gray order.

Fingerprints are sorted by their rank in the binary reflected Gray sequence, so
neighbours differ in few bits.  Runs of neighbours form nodes whose shared bits
are one masked pattern, and patterns of a level form the nodes of the one
above, whose shared bits are factored out of the children.  A pair of nodes is
dropped as a whole as soon as the differences gathered over the shared bits
pass the radius, or where all of both already lies in one component, so a dense
group yields a spanning star and never all its pairs.

A forest holds the trees of many buckets at once; every bucket, small or large,
is searched in the same way.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
_CHUNK = 1 << 13


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the binary reflected Gray sequence."""
    out = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class Sets:
    """Union-find over 0..n-1 with array lookups."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            deeper = self.up[r]
            if np.array_equal(deeper, r):
                return r
            r = deeper

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of many pairs: minimum labels are hooked until none moves."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))
        self.up = self.roots(np.arange(len(self.up)))


class GrayForest:
    """Trees over fingerprints that come sorted by bucket and Gray rank; level 0 are the fingerprints.

    ``shared[l]`` has the bits in which all members of a node agree and
    ``value[l]`` their values; the bits of a parent are among its children's.
    ``leaf[l]`` is a node's first fingerprint, ``child[l]`` its first child.
    ``node_pairs``, ``pruned`` and ``leaf_pairs`` count the work of ``links``.
    """

    def __init__(self, bucket: np.ndarray, fp: np.ndarray, fanout: int = FANOUT) -> None:
        self.shared, self.value = [np.full(len(fp), ~np.uint64(0))], [fp]
        self.leaf, self.child = [np.arange(len(fp))], [np.arange(len(fp))]
        self.node_pairs = self.pruned = self.leaf_pairs = 0
        while True:
            fresh = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            start = np.flatnonzero(fresh)
            if len(start) == len(bucket):
                break
            rank = np.arange(len(bucket)) - start[np.cumsum(fresh) - 1]
            at = np.flatnonzero(rank % fanout == 0)
            shared, value = self.shared[-1], self.value[-1]
            low = np.bitwise_and.reduceat(value | ~shared, at)
            high = np.bitwise_or.reduceat(value & shared, at)
            both = np.bitwise_and.reduceat(shared, at) & ~(low ^ high)
            self.shared.append(both)
            self.value.append(low & both)
            self.child.append(at)
            self.leaf.append(self.leaf[-1][at])
            bucket = bucket[at]

    def links(self, radius: int, sets: Sets) -> None:
        """Join in ``sets`` all members of a bucket that links of at most ``radius`` bits connect.

        Each node pair carries the bits compared so far and the differences
        found in them; a level adds only the bits that it shares anew.
        """
        top = len(self.value) - 1
        root = np.flatnonzero(np.diff(np.append(self.leaf[top], len(self.leaf[0]))) > 1)
        stack = [(top, root, root, np.zeros(len(root), np.uint64), np.zeros(len(root), np.uint8))]
        while stack:
            level, a, b, seen, apart = stack.pop()
            if level and len(a) > _CHUNK:
                half = len(a) // 2
                stack += [(level, *(x[half:] for x in (a, b, seen, apart))), (level, *(x[:half] for x in (a, b, seen, apart)))]
                continue
            fresh = self.shared[level][a] & self.shared[level][b] & ~seen
            apart = apart + np.bitwise_count((self.value[level][a] ^ self.value[level][b]) & fresh)
            near = apart <= radius
            if level == 0:
                self.leaf_pairs += len(a)
                sets.merge(a[near], b[near])
                continue
            self.node_pairs += len(a)
            self.pruned += len(a) - int(near.sum())
            near[near] = self._open(level, a[near], b[near], sets)
            if not near.any():
                continue
            a, b, seen, apart = a[near], b[near], (seen | fresh)[near], apart[near]
            x, y, of = self._children(level, a, b)
            seen, apart = seen[of], apart[of]
            inner = np.abs(x - y) < (2 if level > 1 else FANOUT)
            # Neighbours go first: what they join lets later pairs be dropped whole.
            for part in (~inner, inner):
                if part.any():
                    stack.append((level - 1, x[part], y[part], seen[part], apart[part]))

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of children of the node pairs, and of which pair each is; a leaf never meets itself."""
        first = np.append(self.child[level], len(self.value[level - 1]))
        n_a, n_b = first[a + 1] - first[a], first[b + 1] - first[b]
        total = n_a * n_b
        of = np.repeat(np.arange(len(a)), total)
        k = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total)
        x, y = first[a][of] + k // n_b[of], first[b][of] + k % n_b[of]
        fits = x < y if level == 1 else x <= y
        return x[fits], y[fits], of[fits]

    def _open(self, level: int, a: np.ndarray, b: np.ndarray, sets: Sets) -> np.ndarray:
        """Which node pairs are not yet wholly in one component."""
        low, high = (f.reduceat(sets.up, self.leaf[level]) for f in (np.minimum, np.maximum))
        return (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])


def bucket_links(bucket: np.ndarray, fp: np.ndarray, radius: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, GrayForest]:
    """Star links (node, least node of its component) inside each bucket, and the forest that found them."""
    order = np.lexsort((gray_rank(fp), bucket))
    bucket, fp, node = bucket[order], fp[order], node[order]
    sets = Sets(len(fp))
    forest = GrayForest(bucket, fp)
    forest.links(radius, sets)
    root = sets.roots(np.arange(len(fp)))
    least = np.full(len(fp), np.iinfo(np.int64).max)
    np.minimum.at(least, root, node)
    linked = node != least[root]
    return node[linked], least[root][linked], forest
