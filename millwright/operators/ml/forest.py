"""Random forest regression on Spark: hash-drawn bags, histogram trees, all settings of a search at once.

*Bags.*  A row's weight in tree t is a Poisson number of mean 1 drawn from a hash of (t, key): a bootstrap of the whole table that no
partitioning changes.  No bag is stored: whoever reads a row draws its weights again.

*Bins.*  Features become one byte, their place among cut points, which are order statistics of all rows (``functions/ranks.py``).
The binned rows are kept as blocks, a block's columns as binary values.

*Trees.*  A tree grows level by level: the best split of every node of the level is read from the running sums of the histogram of
(node, feature, bin).  While a node has more than ``LOCAL_ROWS`` drawn rows, every task counts its own blocks for all trees and the
counts are added up, in whole numbers; a node with fewer is sent to one task, which grows the rest below it.  So no task holds more rows
than that, however many there are.  Nodes are numbered as in a heap and each one keeps its mean, so the tree of a smaller depth is the
same tree read to that depth, and a smaller forest is its first trees.

*Search.*  For the same reason settings (trees, depth, leaf) that differ in trees or depth alone share their trees: a search grows one
forest per value of ``leaf`` and scores every setting in one pass over the fold.  The values of ``leaf`` share the nodes of a tree as
long as they choose the same splits.

The forest is at most trees x 2**(depth + 1) nodes of nine bytes however many rows there are; it is broadcast to the scoring tasks.
Errors are summed as whole numbers of 1e-9, so a mean absolute error is the same for any partitioning.
"""

from __future__ import annotations

import copy
import gc
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.common import ensure_parallel
from millwright.functions.ranks import order_statistics
from millwright.session import written

ROWS_PER_TREE = math.inf  # a tree draws as many rows as there are
BINS = 64
SEED = 42
BLOCK = 512  # rows that go down all trees at once
BLOCK_ROWS = 1 << 15  # rows of a stored block; up to 2**17 sums of a block are exact
LOCAL_ROWS = 1 << 19  # drawn rows of a node below which one task grows the rest
HELD_NODES = 1 << 13  # nodes that a counting pass holds at once (14 kB each for nine features)
SENT_ROWS = 1 << 27  # drawn rows that one job sends to the tasks that grow the rest
LIMB = 31  # bits of each half of a label in whole numbers
ERROR_UNIT = 1e-9

Setting = tuple[int, int, int]  # trees, depth, leaf


def _uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / float(1 << 52)


def cut_points(df: DataFrame, features: list[str], n: int, bins: int = BINS) -> np.ndarray:
    """(feature, bins - 1) ascending cut points: of the ``n`` rows the least value that a share of b / bins does not exceed."""
    if not n:
        return np.zeros((len(features), bins - 1))
    return order_statistics(df.select(*[F.col(f).cast("double").alias(f) for f in features]), n, [max(0, -(-n * b // bins) - 1) for b in range(1, bins)])


def binned(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Place of each value among its feature's cut points: at most b means <= cuts[b]."""
    return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, values.T)], axis=1).astype(np.uint8) if len(values) else np.zeros(values.shape, np.uint8)


@dataclass
class Trees:
    """Trees as heaps: node i has the children 2i + 1 and 2i + 2; ``feature`` is -1 at a leaf."""

    feature: np.ndarray  # (tree, node) int8
    bin: np.ndarray  # (tree, node) uint8: to the left up to this bin
    value: np.ndarray  # (tree, node) float64: mean of the node's rows
    gain: np.ndarray  # (tree, feature) float64: squares that the splits took away

    def levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level (feature, bin, value) of (tree, place); below the node of place p are 2p and 2p + 1, below a leaf its value."""
        out, depth = [], (self.feature.shape[1] + 1).bit_length() - 1
        for k in range(depth):
            at = slice((1 << k) - 1, (2 << k) - 1)
            feature, value = self.feature[:, at], self.value[:, at].copy()
            if out:
                leaf = np.repeat(above < 0, 2, axis=1)
                value = np.where(leaf, np.repeat(out[-1][2], 2, axis=1), value)
                feature = np.where(leaf, np.int8(-1), feature)
            above = feature
            out.append((np.maximum(feature, 0).astype(np.int64), self.bin[:, at].copy(), value))
        return out


def tree_sums(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray, asked: set[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """For each (trees, depth) the sum over the first ``trees`` trees, read to that depth, of the values of the rows ``x`` (bins)."""
    out, n = {a: np.empty(len(x)) for a in asked}, len(x)
    most = [max((t for t, d in asked if d >= k), default=0) for k in range(len(levels))]  # trees that go as deep
    for at in range(0, n, BLOCK):
        block = np.ascontiguousarray(x[at : at + BLOCK].T)
        rows = np.arange(block.shape[1])
        flat, place = block.ravel(), np.repeat(np.arange(most[0])[:, None], len(rows), axis=1)
        for k, (feature, cut, value) in enumerate(levels):
            for trees, depth in asked:
                if depth == k:
                    out[trees, depth][at : at + BLOCK] = value.ravel().take(place[:trees]).sum(axis=0)
            if k + 1 == len(levels) or not most[k + 1]:
                break
            place = place[: most[k + 1]]
            cell = (feature * len(rows)).ravel().take(place)
            cell += rows
            right = flat.take(cell) > cut.ravel().take(place)
            place += place
            place += right
    return out


def _best(sides: Iterable[tuple[np.ndarray, ...]], base: np.ndarray, nodes: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By leaf (gain, feature or -1, bin) of the best split of its ``nodes``.  ``sides``: for each feature weights and sums to the left and to the
    right of each (node, bin); ``base``: by node the square of its sum over its weight."""
    found = {leaf: (np.full(len(at), 1e-12), np.full(len(at), -1), np.zeros(len(at), np.int64)) for leaf, at in nodes.items()}
    for f, (left_w, left_s, right_w, right_s) in enumerate(sides):
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = left_s**2 / left_w + right_s**2 / right_w - base[:, None]
        least = np.minimum(left_w, right_w)
        for leaf, at in nodes.items():
            best, best_f, best_b = found[leaf]
            mine = slice(None) if len(at) == len(base) else at
            allowed = np.where(least[mine] >= leaf, gains[mine], 0.0)
            b = allowed.argmax(axis=1)
            top = allowed[np.arange(len(at)), b]
            better = top > best * (1 + 1e-12)
            best[better], best_f[better], best_b[better] = top[better], f, b[better]
    return found


def _routed(rows: np.ndarray, node: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, split): each row once for each split of its node, which are ``many`` from ``first`` on."""
    if len(many) and many.min() == 1 == many.max():
        return rows, first.take(node)
    count = many.take(node)
    at = np.repeat(np.arange(len(node)), count)
    split = first.take(node).take(at) + np.arange(len(at)) - (np.cumsum(count) - count).take(at)
    return rows.take(at), split


def grow_all(x: np.ndarray, y: np.ndarray, w: np.ndarray, depths: dict[int, int], bins: int = BINS) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each leaf -> depth a tree: feature, bin and value by heap place, and the gain by feature.  ``x``: bins of (feature, row), ``w``: weights above 0."""
    n_features, leaves = len(x), sorted(depths)
    size = {leaf: (1 << depths[leaf] + 1) - 1 for leaf in leaves}
    out = {leaf: (np.full(size[leaf], -1, np.int8), np.zeros(size[leaf], np.uint8), np.zeros(size[leaf]), np.zeros(n_features)) for leaf in leaves}
    if not len(y):
        return out
    wy = w * y
    for leaf in leaves:
        out[leaf][2][0] = wy.sum() / w.sum()
    goes_on = lambda level: sum(1 << k for k, leaf in enumerate(leaves) if depths[leaf] > level)
    # the nodes of a level: heap place and the leaves (as bits) that share the node; a row stands once for each node it is in
    rows, node, heap, shared, level = np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(1, np.int64), np.full(1, goes_on(0)), 0
    while len(heap) and shared.any():
        row_w, row_wy, cells, n = w.take(rows), wy.take(rows), node * bins, len(heap)
        total_w, total_s = np.bincount(node, row_w, n), np.bincount(node, row_wy, n)

        def sides() -> Iterator[tuple[np.ndarray, ...]]:
            for f in range(n_features):
                cell = cells + x[f].take(rows)
                left_w = np.bincount(cell, row_w, n * bins).reshape(-1, bins).cumsum(axis=1)[:, :-1]
                left_s = np.bincount(cell, row_wy, n * bins).reshape(-1, bins).cumsum(axis=1)[:, :-1]
                yield left_w, left_s, total_w[:, None] - left_w, total_s[:, None] - left_s

        nodes = {leaf: at for k, leaf in enumerate(leaves) if len(at := np.flatnonzero(shared >> k & 1))}
        found = _best(sides(), total_s**2 / total_w, nodes)
        chosen, by = [], []
        for k, leaf in enumerate(leaves):
            if leaf in found:
                gains, f, b = found[leaf]
                split = f >= 0
                at = nodes[leaf][split]
                out[leaf][0][heap[at]], out[leaf][1][heap[at]] = f[split], b[split]
                np.add.at(out[leaf][3], f[split], gains[split])
                chosen.append((at * n_features + f[split]) * bins + b[split])
                by.append(np.full(len(at), 1 << k))
        splits, place = np.unique(np.concatenate(chosen), return_inverse=True)
        holds = np.zeros(len(splits), np.int64)
        np.bitwise_or.at(holds, place, np.concatenate(by))
        of, f, b = splits // (n_features * bins), splits // bins % n_features, splits % bins
        rows, split = _routed(rows, node, np.searchsorted(of, np.arange(n)), np.bincount(of, minlength=n))
        child = 2 * split + (x.ravel().take(f.take(split) * x.shape[1] + rows) > b.take(split))
        counts, sums = np.bincount(child, w.take(rows), 2 * len(splits)), np.bincount(child, wy.take(rows), 2 * len(splits))
        heap, holds, level = (2 * heap[of][:, None] + [1, 2]).ravel(), np.repeat(holds, 2), level + 1
        for k, leaf in enumerate(leaves):
            at = np.flatnonzero(holds >> k & 1)
            out[leaf][2][heap[at]] = sums[at] / counts[at]
        shared = holds & goes_on(level)
        keep = (shared > 0) & (counts >= 2 * leaves[0])  # fewer cannot be split
        stay = keep.take(child)
        rows, node = rows[stay], (np.cumsum(keep) - 1).take(child[stay])
        heap, shared = heap[keep], shared[keep]
    return out


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, leaf: int, bins: int = BINS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree: feature, bin and value by heap place, and the gain by feature.  ``x``: bins of (row, feature), ``w``: weights above 0."""
    return grow_all(np.ascontiguousarray(x.T), y, w, {leaf: depth}, bins)[leaf]


def _steps(n: int) -> list[float]:
    """The chance of at most k draws of a row, k = 0, 1, ..., until it is 1 as far as a double goes."""
    mean = min(1.0, ROWS_PER_TREE / max(1, n))
    steps, chance, total = [], math.exp(-mean), 0.0
    for k in range(20):
        total += chance
        steps.append(total)
        chance *= mean / (k + 1)
    return steps


def _bags(df: DataFrame, features: list[str], label: str, key: list[str], trees: int, seed: int) -> DataFrame:
    """(tree, h, w, label, features): a row for each tree that draws it, with its Poisson weight; ``_Draws`` in Spark's own functions, to check it by."""
    steps = _steps(df.count())
    kept = [F.col(f).cast("double").alias(f) for f in features]
    rows = ensure_parallel(df.select(F.xxhash64(F.lit(seed), *key).alias("h"), F.col(label).cast("double").alias("label"), *kept))
    draw = lambda t: _uniform(seed + 1, t, F.col("h"))
    drawn = rows.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "*").withColumn("u", draw(F.col("tree"))).where(F.col("u") >= steps[0])
    weight = sum((F.col("u") >= s).cast("int") for s in steps[1:]) + F.lit(1)
    return drawn.select("tree", "h", weight.cast("int").alias("w"), "label", *features)


_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_64 = (1 << 64) - 1


def _xxhash_int(value: int, seed: int) -> int:
    """Spark's xxhash64 of an int."""
    h = (seed + _P5 + 4 & _64) ^ ((value & 0xFFFFFFFF) * _P1 & _64)
    h = ((h << 23 | h >> 41) * _P2 + _P3) & _64
    h = (h ^ h >> 33) * _P2 & _64
    h = (h ^ h >> 29) * _P3 & _64
    return h ^ h >> 32


class _Draws:
    """The Poisson weights of rows in the bags, from the hashes of their keys: ``xxhash64(seed + 1, tree, h)`` of a whole block."""

    def __init__(self, n: int, seed: int):
        self.seed, self.limits = _xxhash_int(seed + 1, 42), [math.ceil(s * (1 << 52)) for s in _steps(n)]

    def every_row(self) -> _Draws:
        """Each row once."""
        out = copy.copy(self)
        out.limits = [0]
        return out

    def block(self, h: np.ndarray) -> np.ndarray:
        """What all trees share of the hashes."""
        v = h.view(np.uint64) * np.uint64(_P2)
        return (v << np.uint64(31) | v >> np.uint64(33)) * np.uint64(_P1)

    def weights(self, shared: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, weights) of the rows that the tree draws."""
        v = shared ^ np.uint64(_xxhash_int(tree, self.seed) + _P5 + 8 & _64)
        v = (v << np.uint64(27) | v >> np.uint64(37)) * np.uint64(_P1) + np.uint64(_P4)
        v = (v ^ v >> np.uint64(33)) * np.uint64(_P2)
        v = (v ^ v >> np.uint64(29)) * np.uint64(_P3)
        u = (v ^ v >> np.uint64(32)) & np.uint64((1 << 52) - 1)
        rows = np.flatnonzero(u >= np.uint64(self.limits[0]))
        u, w = u[rows], np.ones(len(rows))
        for limit in self.limits[1:]:
            more = u >= np.uint64(limit)
            if not more.any():
                break
            w += more
        return rows, w


def _blocks(df: DataFrame, features: list[str], label: str, key: list[str], cuts: np.ndarray, seed: int) -> DataFrame:
    """(x, y, h): up to BLOCK_ROWS rows each, bins feature by feature, labels and hashes of keys."""
    kept = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([label, *features])]
    rows, size = ensure_parallel(df.select(F.xxhash64(F.lit(seed), *key).alias("h"), *kept)), BLOCK_ROWS

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        h, y, *x = (c.to_numpy() for c in table.columns)
        x = np.ascontiguousarray(binned(np.stack(x, axis=1), cuts).T)
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y, h)], ["x", "y", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, size - n))
                n, batch = n + held[-1].num_rows, batch.slice(size - n)
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return rows.mapInArrow(run, "x binary, y binary, h binary")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, h) of each block."""
    for batch in batches:
        for x, y, h in zip(*batch.columns):
            y = np.frombuffer(y.as_buffer())
            yield np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, len(y)), y, np.frombuffer(h.as_buffer(), np.int64)


@dataclass
class _Top:
    """The upper part of a tree: by level the splits of its nodes (a node has several where leaves choose otherwise)."""

    levels: list[dict[str, np.ndarray]] = field(default_factory=list)
    open: list[tuple[int, list[int], int]] = field(default_factory=list)  # (heap place, leaves, drawn rows) of the nodes of the last level
    sent: list[tuple[int, list[int], int]] = field(default_factory=list)  # the same of the nodes whose rest one task grows

    def down(self, x: np.ndarray, rows: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(rows, place in ``open``) and (rows, place in ``sent``) of rows that start at the root."""
        node, ends = np.zeros(len(rows), np.int64), []
        if not self.levels:
            return ((rows, node), (rows[:0], node[:0])) if self.open else ((rows[:0], node[:0]), (rows, node))
        for level in self.levels:
            rows, split = _routed(rows, node, level["first"], level["many"])
            child = 2 * split + (x.ravel().take(level["feature"].take(split) * x.shape[1] + rows) > level["bin"].take(split))
            end, node = level["sent"].take(child), level["next"].take(child)
            ends.append((rows[end >= 0], end[end >= 0]))
            rows, node = rows[node >= 0], node[node >= 0]
        return (rows, node), tuple(np.concatenate(c) for c in zip(*ends))


def _unit(largest: float) -> float:
    """The power of two of which a label of that size has at most 2 LIMB bits."""
    return 2.0 ** max(math.frexp(largest)[1] - 2 * LIMB, -1000)


def _counted(blocks: DataFrame, tops: dict[int, _Top], asked: dict[int, list[int]], draws: _Draws, unit: float, n_features: int) -> list[dict]:
    """The best splits for each leaf of the open nodes ``asked`` (by tree): one pass over the blocks.

    Sums of labels are sums of whole numbers in two halves, so that no order changes them."""
    held = blocks.sparkSession.sparkContext.broadcast(tops)
    first, slots = {}, 0
    for tree, nodes in asked.items():
        first[tree], slots = slots, slots + len(nodes)
    whole = sorted((t, k) for t, nodes in asked.items() for k in nodes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((slots, n_features, 3, BINS), np.int64)
        place = {t: np.full(len(held.value[t].open), -1) for t in asked}
        for t, nodes in asked.items():
            place[t][nodes] = np.arange(len(nodes))
        for x, y, h in _opened(batches):
            units, shared = np.rint(y / unit).astype(np.int64), draws.block(h)
            high, low, w = (units >> LIMB).astype(float), (units & (1 << LIMB) - 1).astype(float), np.zeros(len(y))
            for t, nodes in asked.items():
                rows, drawn = draws.weights(shared, t)
                w[rows] = drawn
                (rows, at), _ = held.value[t].down(x, rows)
                at = place[t].take(at)
                if (at < 0).any():
                    rows, at = rows[at >= 0], at[at >= 0]
                mine, parts = total[first[t] : first[t] + len(nodes)], [v := w.take(rows), v * high.take(rows), v * low.take(rows)]
                at *= BINS
                for f in range(n_features):
                    cell = at + x[f].take(rows)
                    for c, part in enumerate(parts):
                        mine[:, f, c] += np.bincount(cell, part, len(nodes) * BINS).reshape(-1, BINS).astype(np.int64)
        if total.any():
            for at in range(0, slots, 512):
                some = whole[at : at + 512]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in some], pa.int32()), pa.array([k for _, k in some], pa.int32()), pa.array([total[at + i].tobytes() for i in range(len(some))], pa.binary())], ["tree", "node", "counts"])

    def choose(group: pa.Table) -> pa.Table:
        tree, node = group["tree"][0].as_py(), group["node"][0].as_py()
        left = sum(np.frombuffer(c.as_buffer(), np.int64) for c in group["counts"]).reshape(n_features, 3, BINS).cumsum(axis=2)
        both = left[:, :, -1:]
        left, right = left[:, :, :-1], both - left[:, :, :-1]
        number = lambda v: (v[:, 1] * float(1 << LIMB) + v[:, 2]) * unit
        sides = [left[:, 0].astype(float), number(left), right[:, 0].astype(float), number(right)]
        sum_w, sum_s = float(both[0, 0, 0]), float(number(both)[0, 0])
        found = _best(([s[f : f + 1] for s in sides] for f in range(n_features)), np.array([sum_s**2 / sum_w]), {leaf: np.zeros(1, np.int64) for leaf in held.value[tree].open[node][1]})
        out = []
        for leaf, ((gain,), (f,), (b,)) in found.items():
            near = [float(s[f, b]) for s in sides] if f >= 0 else [0.0] * 4
            out.append({"tree": tree, "node": node, "leaf": leaf, "sum_w": sum_w, "sum_s": sum_s, "gain": float(gain), "feature": int(f), "bin": int(b)} | dict(zip(("left_w", "left_s", "right_w", "right_s"), near)))
        return pa.Table.from_pylist(out, schema=kind)

    kind = pa.schema([(c, pa.int32()) for c in ("tree", "node", "leaf", "feature", "bin")] + [(c, pa.float64()) for c in ("sum_w", "sum_s", "gain", "left_w", "left_s", "right_w", "right_s")])
    names = "tree int, node int, leaf int, feature int, bin int, sum_w double, sum_s double, gain double, left_w double, left_s double, right_w double, right_s double"
    found = blocks.mapInArrow(count, "tree int, node int, counts binary").groupBy("tree", "node").applyInArrow(choose, names).collect()
    return sorted((r.asDict() for r in found), key=lambda r: (r["tree"], r["node"], r["leaf"]))


def _in_chunks(items: list[tuple[int, int, int]], most: int) -> Iterator[dict[int, list[int]]]:
    """(tree, place, size): places by tree, chunks of at most ``most`` in size (or of one)."""
    chunk, total = {}, 0
    for tree, place, size in items:
        if chunk and total + size > most:
            yield chunk
            chunk, total = {}, 0
        chunk.setdefault(tree, []).append(place)
        total += size
    if chunk:
        yield chunk


def _finished(blocks: DataFrame, tops: dict[int, _Top], asked: dict[int, list[int]], draws: _Draws, depths: dict[int, int]) -> list[dict]:
    """The rest below the nodes ``asked`` (by tree) of ``sent``, each grown in one task from its rows in the order of their hashes."""
    held = blocks.sparkSession.sparkContext.broadcast(tops)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, h in _opened(batches):
            shared, w = draws.block(h), np.zeros(len(y), np.uint8)
            for t, nodes in asked.items():
                rows, drawn = draws.weights(shared, t)
                w[rows] = drawn
                _, (rows, node) = held.value[t].down(x, rows)
                order = np.argsort(node, kind="stable")
                rows, node = rows[order], node[order]
                ends = np.searchsorted(node, [nodes, [k + 1 for k in nodes]])
                parts = [(k, rows[a:b]) for k, a, b in zip(nodes, *ends.tolist()) if b > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([t] * len(parts), pa.int32()), pa.array([k for k, _ in parts], pa.int32()),
                    *(pa.array([v[..., r].tobytes() for _, r in parts], pa.binary()) for v in (x, y, w, h))], ["tree", "node", "x", "y", "w", "h"])

    def build(group: pa.Table) -> pa.Table:
        tree, node = group["tree"][0].as_py(), group["node"][0].as_py()
        y, w, h = (np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in group[c]]) for c, kind in (("y", float), ("w", np.uint8), ("h", np.int64)))
        at, x = 0, np.empty((len(group["x"][0].as_buffer()) // len(group["w"][0].as_buffer()), len(y)), np.uint8)
        for v, k in zip(group["x"], group["w"]):
            n = len(k.as_buffer())
            x[:, at : at + n], at = np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, n), at + n
        order = np.argsort(h, kind="stable")
        if (np.diff(h[order]) == 0).any():
            order = np.lexsort([*x[::-1], y, h])
        heap, leaves, _ = held.value[tree].sent[node]
        level = (heap + 1).bit_length() - 1
        made = grow_all(np.ascontiguousarray(x[:, order]), y[order], w[order].astype(float), {leaf: depths[leaf] - level for leaf in leaves})
        columns = [pa.array([v] * len(made), pa.int32()) for v in (tree, node)] + [pa.array(list(made), pa.int32())]
        columns += [pa.array([parts[k].tobytes() for parts in made.values()], pa.binary()) for k in range(4)]
        return pa.Table.from_arrays(columns, ["tree", "node", "leaf", "feature", "bin", "value", "gain"])

    # a group is heavy however few bytes it has: as many partitions as groups, which adaptive execution leaves alone
    parts = min(sum(map(len, asked.values())), 1 << 11)
    rows = blocks.mapInArrow(send, "tree int, node int, x binary, y binary, w binary, h binary").repartition(parts, "tree", "node")
    found = rows.groupBy("tree", "node").applyInArrow(build, "tree int, node int, leaf int, feature binary, bin binary, value binary, gain binary").collect()
    return sorted((r.asDict() for r in found), key=lambda r: (r["tree"], r["node"], r["leaf"]))


class Forest:
    """A fitted forest: predictions and importances."""

    def __init__(self, trees: Trees, cuts: np.ndarray, features: list[str], depth: int):
        self.trees, self.cuts, self.features, self.depth = trees, cuts, features, depth

    def importances(self) -> list[tuple[str, float]]:
        """Share of the squares that each feature's splits take away, mean over trees, largest first."""
        total = self.trees.gain.sum(axis=1, keepdims=True)
        shares = self.trees.gain[total[:, 0] > 0] / total[total[:, 0] > 0]
        mean = shares.mean(axis=0) if len(shares) else np.zeros(len(self.features))
        return sorted(zip(self.features, map(float, mean / mean.sum() if mean.sum() else mean)), key=lambda t: (-t[1], t[0]))

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with a column of predictions."""
        cuts, features, depth, held = self.cuts, self.features, self.depth, df.sparkSession.sparkContext.broadcast(self.trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n_trees, levels = len(held.value.feature), held.value.levels()
            for batch in batches:
                table = pa.Table.from_batches([batch])
                x = binned(np.stack([table[f].to_numpy() for f in features], axis=1).astype(float), cuts)
                sums = tree_sums(levels, x, {(n_trees, depth)})[n_trees, depth]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums / n_trees)], [*batch.schema.names, name])

        rows = df.withColumns({f: F.col(f).cast("double") for f in features})
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{fields}, `{name}` double")


def _grown(df: DataFrame, features: list[str], label: str, key: list[str], wanted: dict[int, tuple[int, int]], seed: int) -> tuple[dict[int, Trees], np.ndarray]:
    """By leaf the trees for ``wanted``: leaf -> (trees, depth), and the cut points."""
    n, largest = df.agg(F.count(F.lit(1)), F.max(F.abs(F.col(label).cast("double")))).first()
    cuts = cut_points(df, features, n)
    depths, most = {leaf: d for leaf, (_, d) in wanted.items()}, max(t for t, _ in wanted.values())
    size = {leaf: (1 << d + 1) - 1 for leaf, d in depths.items()}
    out = {leaf: Trees(np.full((t, size[leaf]), -1, np.int8), np.zeros((t, size[leaf]), np.uint8), np.zeros((t, size[leaf])), np.zeros((t, len(features)))) for leaf, (t, _) in wanted.items()}
    if not n:
        raise ValueError("no rows to grow a forest from")
    draws, unit, blocks = _Draws(n, seed), _unit(largest), _blocks(df, features, label, key, cuts, seed)
    tops = {t: _Top() for t in range(most)}
    for t, top in tops.items():
        (top.open if n > LOCAL_ROWS else top.sent).append((0, [leaf for leaf, (trees, _) in sorted(wanted.items()) if t < trees], n))
    if n > LOCAL_ROWS:
        blocks = written(blocks, "forest-rows")
    while any(top.open for top in tops.values()):
        asked = _in_chunks([(t, k, 1) for t, top in tops.items() for k in range(len(top.open))], HELD_NODES)
        found = [r for some in asked for r in _counted(blocks, tops, some, draws, unit, len(features))]
        by: dict[int, list[dict]] = {}
        for r in found:
            by.setdefault(r["tree"], []).append(r)
        for t, top in tops.items():
            _deeper(t, top, by.get(t, []), out, depths)
    filled = set()
    for i, some in enumerate(_in_chunks([(t, k, size) for t, top in tops.items() for k, (*_, size) in enumerate(top.sent)], SENT_ROWS)):
        if i:
            _let_go(df.sparkSession)
        found = _finished(blocks, tops, some, draws, depths)
        _put(found, tops, out)
        filled |= {r["tree"] for r in found}
    if n <= LOCAL_ROWS and len(filled) < most:  # a bag of a table of few rows may be empty: it takes each row once
        _put(_finished(blocks, tops, {t: [0] for t in tops if t not in filled}, draws.every_row(), depths), tops, out)
    return out, cuts


def _let_go(spark) -> None:
    """Spark deletes the shuffle files of an ended job when the driver's JVM has collected its plan: have that done now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _put(found: list[dict], tops: dict[int, _Top], out: dict[int, Trees]) -> None:
    """Put what grew below the sent nodes into ``out``."""
    for r in found:
        trees, (root, _, _), t = out[r["leaf"]], tops[r["tree"]].sent[r["node"]], r["tree"]
        for c, kind in (("feature", np.int8), ("bin", np.uint8), ("value", np.float64)):
            below, k = np.frombuffer(r[c], kind), 0
            while (1 << k) <= len(below):
                at = (root + 1 << k) - 1
                getattr(trees, c)[t, at : at + (1 << k)] = below[(1 << k) - 1 : (2 << k) - 1]
                k += 1
        trees.gain[t] += np.frombuffer(r["gain"])


def _deeper(t: int, top: _Top, found: list[dict], out: dict[int, Trees], depths: dict[int, int]) -> None:
    """Put the splits of the open nodes of tree ``t`` into ``out``; their children are the next open nodes, or are sent."""
    opened, top.open = top.open, []
    if not opened:
        return
    level, splits = len(top.levels) + 1, {}
    for r in found:
        trees, heap = out[r["leaf"]], opened[r["node"]][0]
        trees.value[t, heap] = r["sum_s"] / r["sum_w"]
        if r["feature"] >= 0:
            trees.feature[t, heap], trees.bin[t, heap] = r["feature"], r["bin"]
            trees.gain[t, r["feature"]] += r["gain"]
            trees.value[t, 2 * heap + 1], trees.value[t, 2 * heap + 2] = r["left_s"] / r["left_w"], r["right_s"] / r["right_w"]
            splits.setdefault((r["node"], r["feature"], r["bin"]), []).append(r)
    order = sorted(splits)
    next_, sent = np.full(2 * len(order), -1), np.full(2 * len(order), -1)
    for k, split in enumerate(order):
        leaves = [r["leaf"] for r in splits[split] if depths[r["leaf"]] > level]
        for side, drawn in enumerate((splits[split][0]["left_w"], splits[split][0]["right_w"])):
            if leaves:
                to, at = (top.open, next_) if drawn > LOCAL_ROWS else (top.sent, sent)
                at[2 * k + side] = len(to)
                to.append((2 * opened[split[0]][0] + 1 + side, leaves, int(drawn)))
    of = np.array([s[0] for s in order], np.int64)
    top.levels.append({
        "first": np.searchsorted(of, np.arange(len(opened))), "many": np.bincount(of, minlength=len(opened)),
        "feature": np.array([s[1] for s in order], np.int64), "bin": np.array([s[2] for s in order], np.int64), "next": next_, "sent": sent})


def fit(df: DataFrame, features: list[str], label: str, key: list[str], setting: Setting, seed: int = SEED) -> Forest:
    """A forest of one setting on all rows of ``df`` (complete rows, ``key`` names a row)."""
    trees, depth, leaf = setting
    grown, cuts = _grown(df, features, label, key, {leaf: (trees, depth)}, seed)
    return Forest(grown[leaf], cuts, features, depth)


def mean_error(df: DataFrame, label: str, prediction: str = "prediction") -> float | None:
    """Mean absolute error, exact in units of 1e-9; None without rows."""
    units = F.round(F.abs(F.col(label) - F.col(prediction)) / ERROR_UNIT).cast("decimal(38,0)")
    r = df.agg(F.sum(units).alias("s"), F.count(units).alias("n")).first()
    return float(r["s"]) * ERROR_UNIT / r["n"] if r["n"] else None


def search(part: DataFrame, fold: DataFrame, features: list[str], label: str, key: list[str], settings: list[Setting], seed: int = SEED) -> list[float]:
    """Mean absolute error on ``fold`` of each setting fitted on ``part``: as fitting one by one, from shared trees."""
    wanted: dict[int, tuple[int, int]] = {}
    for trees, depth, leaf in settings:
        t, d = wanted.get(leaf, (0, 0))
        wanted[leaf] = max(t, trees), max(d, depth)
    grown, cuts = _grown(part, features, label, key, wanted, seed)
    held = part.sparkSession.sparkContext.broadcast(grown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors, n = np.zeros(len(settings), object), 0
        levels = {leaf: held.value[leaf].levels() for leaf in wanted}
        for batch in batches:
            x = binned(np.stack([batch.column(f).to_numpy() for f in features], axis=1), cuts)
            y, n = batch.column(label).to_numpy(), n + len(x)
            for leaf in wanted:
                sums = tree_sums(levels[leaf], x, {s[:2] for s in settings if s[2] == leaf})
                for k, (trees, depth, of) in enumerate(settings):
                    if of == leaf:
                        units = np.rint(np.abs(y - sums[trees, depth] / trees) / ERROR_UNIT)
                        errors[k] += int(units.astype(np.int64).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(settings)), pa.int32()), pa.array([str(e) for e in errors]), pa.array([n] * len(settings), pa.int64())], ["k", "e", "n"])

    rows = ensure_parallel(fold.select(*[F.col(c).cast("double").alias(c) for c in [*features, label]]))
    found = rows.mapInArrow(run, "k int, e string, n long").groupBy("k").agg(F.sum(F.col("e").cast("decimal(38,0)")).alias("e"), F.sum("n").alias("n")).collect()
    by = {r["k"]: float(r["e"]) * ERROR_UNIT / r["n"] if r["n"] else float("nan") for r in found}
    return [by.get(k, float("nan")) for k in range(len(settings))]
