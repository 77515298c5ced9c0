"""Softmaxes down trees of words, over hashed contexts.

A tree splits its words by count into branches of like weight, those again, and so on until every word has a leaf of its
own; a word's probability is the product of the softmaxes on its way.  A softmax adds up the weights of its node, and of the
node together with the word before, with the word two back, and with both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BRANCHES = 16
# odd numbers that spread bits, and a share for branches that hold no word
SPREAD, STEEP, STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
NEVER = 1e-9
# exponentials of more than this are taken less the greatest of their row
SAFE = 60
# so many weights of a row take part in its squares, on average
EQUAL = 8


def softmax(logits: np.ndarray) -> np.ndarray:
    """Row by row, in place."""
    if len(logits) and max(logits.max(), -logits.min()) > SAFE:
        logits -= logits.max(axis=1)[:, None]
    np.exp(logits, out=logits)
    logits *= np.repeat(1 / np.einsum("ij->i", logits), logits.shape[1]).reshape(logits.shape)
    return logits


def summed(rows: np.ndarray, n_rows: int, error: np.ndarray, passes: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of their errors."""
    # sixteen bits are sorted in time that is linear
    order = np.argsort(rows.astype(np.uint16 if n_rows <= 1 << 16 else np.int64), kind="stable")
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    sizes = np.empty(len(starts), np.int64)
    sizes[:-1], sizes[-1] = starts[1:] - starts[:-1], len(rows) - starts[-1]
    # most rows come a few times: their errors are added one place after the other, those of all others run by run
    less = passes + 1 - np.minimum(sizes, passes + 1).astype(np.uint8)
    by_size = np.argsort(less, kind="stable")
    longer = np.cumsum(np.bincount(less, minlength=passes + 1))[::-1]  # how many come more than k times
    starts = starts[by_size]
    out = error.take(order[starts], axis=0)
    often = int(longer[passes])
    for k in range(1, passes):
        if longer[k] > often:
            out[often : longer[k]] += error.take(order[starts[often : longer[k]] + k], axis=0)
    if often:
        run = sizes[by_size[:often]]
        begins = np.cumsum(run) - run
        inside = np.arange(begins[-1] + run[-1]) + np.repeat(starts[:often] - begins, run)
        out[:often] = np.add.reduceat(error.take(order[inside], axis=0), begins, axis=0)
    return sorted_rows[starts], out


def descend(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, error: np.ndarray, rate: float) -> None:
    """One gradient step for each of the rows, whose size shrinks with the steps so far; errors of a row add up.

    ``squares`` are kept for every weight, or one for every row.
    """
    found, gradient = summed(rows, len(table), error)
    width = error.shape[1]
    if squares.ndim == 1:
        square = squares.take(found) + np.einsum("ij,ij->i", gradient, gradient) / EQUAL
        squares[found] = square
        gradient *= (rate / np.sqrt(square + 1)).astype(np.float32)[:, None]
        whole = table.take(found, axis=0)
        whole[:, :width] -= gradient
        table[found] = whole
    else:
        square = squares.take(found, axis=0)[:, :width]
        square += gradient * gradient
        squares[found, :width] = square
        table[found, :width] = table.take(found, axis=0)[:, :width] - rate * gradient / np.sqrt(square + 1)


class Softmaxes:
    """Weights of one softmax for each node: of hashed contexts, which are trained, and of the node itself, which are not."""

    def __init__(self, shares: np.ndarray, tree: np.ndarray, rows: np.ndarray):
        """``shares`` of every node's branches are what the softmaxes give before any training; ``tree`` is that of each node,
        and ``rows`` how many rows each tree has for contexts: trees share none."""
        self.tree = tree
        self.first, self.size = ((np.cumsum(rows) - rows)[tree], rows[tree].astype(np.uint64))
        self.table = np.zeros((int(rows.sum()), shares.shape[1]), np.float32)
        self.bias = np.log(np.maximum(shares / np.maximum(shares.sum(axis=1, keepdims=True), NEVER), NEVER)).astype(np.float32)

    def rows(self, node: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Rows of the contexts: ``a`` one place back, ``b`` two, and both."""
        first, size = self.first.take(node), self.size.take(node)
        node, a, b = (x.astype(np.uint64) + np.uint64(1) for x in (node, a, b))
        out = []
        for context in (a, b << np.uint64(20), a << np.uint64(40) | b):
            mixed = context * SPREAD + node * STEEP
            mixed ^= mixed >> np.uint64(29)
            out.append(first + ((mixed * STIR >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64))
        return out

    def probabilities(self, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        logits = self.bias.take(node, axis=0)
        for r in rows:
            logits += self.table.take(r, axis=0)
        return softmax(logits)

    def log10(self, node: np.ndarray, child: np.ndarray, a: np.ndarray, b: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
        """log10 of the probability of each branch."""
        out = np.zeros(len(node))
        for i in range(0, len(node), at_once):
            some = slice(i, i + at_once)
            p = self.probabilities(node[some], self.rows(node[some], a[some], b[some]))
            out[some] = np.log10(np.maximum(p[np.arange(len(p)), child[some]], NEVER * NEVER).astype(float))
        return out

    def train(
        self,
        node: np.ndarray,
        child: np.ndarray,
        a: np.ndarray,
        b: np.ndarray,
        squares: np.ndarray,
        rng: np.random.Generator,
        rate: float,
        batch: int,
    ) -> None:
        """One pass of gradient steps over small batches, tree by tree, so that the rows in use are near each other; there is
        one of ``squares`` for every row."""
        order = rng.permutation(len(node))
        tree = self.tree.take(node[order])
        order = order[np.argsort(tree.astype(np.uint16) if len(self.tree) <= 1 << 16 else tree, kind="stable")]
        node, child, a, b = (x.take(order) for x in (node, child, a, b))
        for i in range(0, len(order), batch):
            some = slice(i, i + batch)
            rows = self.rows(node[some], a[some], b[some])
            error = self.probabilities(node[some], rows)
            error.ravel()[np.arange(0, error.size, error.shape[1]) + child[some]] -= 1
            for r in rows:
                descend(self.table, squares, r, error, rate)


@dataclass
class Ways:
    """The ways from the tops of trees down to leaves: nodes and branches of leaf ``i`` are those from ``begin[i]`` on,
    ``depth[i]`` of them; ``shares`` are what the branches of the nodes weigh, and ``tree`` is
    the tree of each node."""

    begin: np.ndarray
    depth: np.ndarray
    node: np.ndarray
    child: np.ndarray
    shares: np.ndarray
    tree: np.ndarray

    def items(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given leaves each step belongs to, and where the step is."""
        depth = self.depth[leaf]
        which = np.repeat(np.arange(len(leaf)), depth)
        return which, np.arange(len(which)) + np.repeat(self.begin[leaf] - (np.cumsum(depth) - depth), depth)


def ways(tree: np.ndarray, weight: np.ndarray) -> Ways:
    """Trees over leaves of some weight; leaves with equal ``tree`` share one.  A tree of one leaf has no node."""
    order = np.lexsort((np.arange(len(tree)), -weight, tree))
    weight = weight[order].astype(float)
    # leaves of a node stand side by side; a node with one leaf is left out
    group, steps, shares, trees, nodes = tree[order], [], [], [], 0
    active = np.arange(len(order))
    while len(active):
        first = np.concatenate([[True], group[1:] != group[:-1]])
        number = np.cumsum(first) - 1
        several = np.bincount(number)[number] > 1
        active, number = active[several], number[several]
        if not len(active):
            break
        first = np.concatenate([[True], number[1:] != number[:-1]])
        number = np.cumsum(first) - 1
        mass = weight[active]
        total = np.bincount(number, mass)
        before = np.cumsum(mass) - mass
        before -= before[first][number]
        child = np.clip((BRANCHES * (before + mass / 2) / total[number]).astype(np.int64), 0, BRANCHES - 1)
        # rounding never puts all leaves of a node on one branch
        child[first] = np.minimum(child[first], BRANCHES // 2)
        last = np.concatenate([first[1:], [True]])
        child[last] = np.maximum(child[last], BRANCHES // 2 + 1)
        child = np.maximum.accumulate(child + number * BRANCHES) - number * BRANCHES
        steps.append((active, number + nodes, child))
        shares.append(np.bincount(number * BRANCHES + child, mass, len(total) * BRANCHES).reshape(-1, BRANCHES))
        trees.append(tree[order[active[first]]])
        nodes += len(total)
        group = number * BRANCHES + child
    if not steps:
        none = np.zeros(0, np.int64)
        return Ways(np.zeros(len(tree), np.int64), np.zeros(len(tree), np.int64), none, none, np.zeros((0, BRANCHES)), none)
    leaf, node, child = (np.concatenate(x) for x in zip(*steps))
    leaf = order[leaf]
    by_leaf = np.argsort(leaf, kind="stable")
    depth = np.bincount(leaf, minlength=len(tree))
    node, child = (x[by_leaf].astype(np.int32) for x in (node, child))
    return Ways(np.cumsum(depth) - depth, depth, node, child, np.concatenate(shares), np.concatenate(trees))
