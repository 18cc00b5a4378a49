"""Cover trees over the rows of one chunk, as flat arrays.

A node has a row of its own as centre and a covering radius that holds every row below it. Its children are the same centre again
and rows taken farthest first, so centres of one node lie at least as far apart as the radius that their rows keep; taking ends
when that radius has halved or the fan is full. Each row goes to the nearest centre. Rows of a node are a stretch of `order`, so
counts and sums of a whole subtree are differences of running sums. Radii are measured, never assumed, with a margin for rounding.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

MARGIN = 1 + 1e-9


@dataclass
class Tree:
    """`order` holds the rows; node i holds order[begin[i]:end[i]] and the nodes first[i] to last[i] (none in a leaf)."""

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def rows(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows below several nodes, and for each the place of its node in `nodes`."""
        size = self.end[nodes] - self.begin[nodes]
        which = np.repeat(np.arange(len(nodes)), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.order[self.begin[nodes][which] + inside], which

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of several nodes, and for each the place of its parent in `nodes`."""
        size = self.last[nodes] - self.first[nodes]
        which = np.repeat(np.arange(len(nodes)), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.first[nodes][which] + inside, which


def build(points: np.ndarray, leaf: int = 16, fan: int = 16) -> Tree:
    """A tree over the rows of `points`, which has at least one."""
    at = points.astype(float)
    away = lambda rows, head: np.sqrt(((at[rows] - at[head]) ** 2).sum(axis=1))
    order = np.arange(len(at))
    root = int(np.argmin(((at - at.mean(axis=0)) ** 2).sum(axis=1)))
    far = away(order, root)
    begin, end, centre, radius, first, last = [0], [len(at)], [root], [], [], []
    node = 0
    while node < len(begin):
        lo, hi, head = begin[node], end[node], centre[node]
        rows = order[lo:hi]
        near = far[rows]
        radius.append(near.max() * MARGIN)
        first.append(len(begin))
        if hi - lo > leaf and radius[node] > 0:
            heads, which, halved = [head], np.zeros(hi - lo, np.int64), radius[node] / 2
            while len(heads) < fan and near.max() > halved:
                head = rows[np.argmax(near)]
                d = away(rows, head)
                closer = d < near
                near, which = np.where(closer, d, near), np.where(closer, len(heads), which)
                heads.append(head)
            far[rows] = near
            sort = np.argsort(which, kind="stable")
            order[lo:hi] = rows[sort]
            edges = lo + np.searchsorted(which[sort], np.arange(len(heads) + 1))
            begin += edges[:-1].tolist()
            end += edges[1:].tolist()
            centre += heads
        last.append(len(begin))
        node += 1
    whole = lambda x: np.array(x, np.int64)
    return Tree(order, whole(begin), whole(end), whole(centre), np.array(radius), whole(first), whole(last))


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    return x.astype(np.result_type(np.min_scalar_type(int(x.min())), np.min_scalar_type(int(x.max())))) if x.size else x


def pack(points: np.ndarray, trees: list[Tree]) -> bytes:
    """A chunk's points and trees as one value of a binary column."""
    arrays = {"points": narrow(points)}
    for k, tree in enumerate(trees):
        arrays |= {f"{name}{k}": x if x.dtype.kind == "f" else narrow(x) for name, x in vars(tree).items()}
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(block: bytes) -> tuple[np.ndarray, list[Tree]]:
    with np.load(io.BytesIO(block), allow_pickle=False) as arrays:
        points, n = arrays["points"].astype(np.int64), sum(name.startswith("order") for name in arrays.files)
        names = Tree.__dataclass_fields__
        read = lambda name: x if (x := arrays[name]).dtype.kind == "f" else x.astype(np.int64)
        return points, [Tree(*[read(f"{name}{k}") for name in names]) for k in range(n)]
