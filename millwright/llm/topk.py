"""Exact top-k by inner product over a bit-sliced index.

*Index.*  Vectors are quantised to integers, floor(256 * x), and cut into blocks of up to
``BLOCK_ROWS`` rows in id order.  Of each attribute a block stores its least value and, of
what is above it, one bitmap per binary digit (a slice).

*Scores.*  A query's score of all rows of a block is a sum of slices shifted by the binary
digits of the query's weights; for a negative weight the complement of the slice is
added, which shifts the sum by a constant.  Slices of one significance are added
three by three (bitwise full adder: sum and carry), all threes of a level at once, until one
slice of the sum is left and the carries go on to the next.

*Selection.*  From the most significant slice of the sum downward, rows with the digit
set are taken as long as no more than k are; else only they stay in question.  Rows
still in question at the end tie exactly and go by smaller id.

Scale: query blocks meet index blocks in groups (a number of index blocks by a number of query blocks),
each side copied only as often as the other has groups; a task holds one group, whose
size is bounded.  Each group gives k rows per query, and a ranked window keeps k.

Components may be as large as a double is: a block or query whose scores could pass 62 bits keeps its least values and weights as
integers of any length (the slices are bitmaps all the same, only more of them).  Only if one of the k best scores itself is no 64-bit
integer does the search stop, with an OverflowError.

Defined results: a vector that is null or empty, holds a null or non-finite component, or has no id takes no part.  A query meets vectors of its own
length.  Rows that repeat the query's id are its own; of several query rows of one id the least vector
asks.  Fewer than k candidates: all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import arrow_pass, prepare, stored

SCALE = 256
BLOCK_ROWS = 1 << 14
QUERY_ROWS = 256
#: Blocks of a side in one group.
GROUP_BLOCKS = 1
QUERY_BLOCKS = 16
#: Scores and values below this are added up in 64 bits.
NARROW = 1 << 62


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v): the vectors that take part, as arrays of doubles."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    # NaN is greater than any number, so it is not below infinity
    rows = rows.filter((F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    return rows.select("id", F.size("v").alias("dim"), "v")


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64, or Python integers where some need more than 62 bits."""
    with np.errstate(over="ignore"):
        q = np.floor(values * scale)
    if not len(q) or np.abs(q).max() < NARROW:
        return q.astype(np.int64)
    exact = lambda x, y: int(y) if math.isfinite(y) else int(x) * scale  # noqa: E731  so large a double is a whole number
    return np.array([exact(x, y) for x, y in zip(values.ravel().tolist(), q.ravel().tolist())], object).reshape(values.shape)


def packed(values: np.ndarray) -> bytes:
    """Integers as bytes: eight each, or behind a mark in decimal where they are of any length."""
    return b"w" + ",".join(map(str, values.ravel().tolist())).encode() if values.dtype == object else b"n" + np.ascontiguousarray(values).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if raw[:1] == b"n":
        return np.frombuffer(raw, np.int64, offset=1)
    return np.array([int(x) for x in raw[1:].split(b",")], object)


class Slices:
    """Bit slices of a block of integer vectors."""

    def __init__(self, least: np.ndarray, digits: np.ndarray, bits: np.ndarray, n: int):
        self.least, self.n = least, n
        self.attribute = np.repeat(np.arange(len(digits)), digits)
        self.place = np.arange(len(self.attribute)) - np.repeat(np.cumsum(digits) - digits, digits)
        valid = np.zeros(bits.shape[1] * 64, np.uint8)
        valid[:n] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)
        self.both = np.concatenate([bits, ~bits])  # slices, then their complements
        self.digits = digits
        self.bound = self.largest()

    @staticmethod
    def parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least value and number of digits by attribute, and the slices, of rows of int64."""
        least = values.min(axis=0)
        above = values - least if values.dtype == object or int(np.abs(values).max()) < NARROW // 2 else values.astype(object) - least.astype(object)
        digits = np.array([int(x).bit_length() for x in above.max(axis=0)], np.int64)
        padded = -(-len(values) // 64) * 64
        out = []
        for d, count in enumerate(digits):
            column = np.zeros(padded, above.dtype)
            column[: len(values)] = above[:, d]
            out += [np.packbits((column >> k & 1).astype(np.uint8), bitorder="little").view(np.uint64) for k in range(count)]
        bits = np.array(out, np.uint64).reshape(len(out), padded // 64)
        return least, digits, bits

    def largest(self) -> int:
        """A bound of the components' sizes."""
        return max((max(abs(int(x)), abs(int(x) + (1 << int(d)) - 1)) for x, d in zip(self.least, self.digits)), default=0)

    def scores(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the sum, least significant first, and the constant that completes it."""
        size = np.abs(weights)
        if int(size.max()) * self.bound * len(weights) < NARROW:
            full = (1 << self.digits) - 1
            shift = int((weights * self.least).sum()) - int((size * full)[weights < 0].sum())
        else:
            shift = sum(int(w) * int(x) - (-int(w) * ((1 << int(d)) - 1) if w < 0 else 0) for w, x, d in zip(weights, self.least, self.digits))
        n_digits = int(size.max()).bit_length()
        sign = np.where(weights < 0, len(self.attribute), 0)[self.attribute]
        ones = np.array([[int(w) >> k & 1 for k in range(n_digits)] for w in size], bool).reshape(len(size), n_digits)[self.attribute]
        total, carried, t = [], [], 0
        highest = n_digits + int(self.digits.max(initial=0))
        each = np.arange(len(self.attribute))
        while t < highest or carried:
            k = t - self.place
            inside = (k >= 0) & (k < n_digits)
            pick = np.flatnonzero(inside & ones[each, np.where(inside, k, 0)]) if n_digits else each[:0]
            stack = np.concatenate([*carried, self.both[pick + sign[pick]]])
            carried = []
            while len(stack) > 1:
                n = len(stack) // 3
                if n:
                    a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                    half = a ^ b
                    carried.append(a & b | half & c)
                    stack = np.concatenate([half ^ c, stack[3 * n :]])
                else:
                    carried.append(stack[:1] & stack[1:])
                    stack = stack[:1] ^ stack[1:]
            total.append(stack[0] if len(stack) else np.zeros_like(self.valid))
            t += 1
        return total, shift

    def best(self, weights: np.ndarray, barred: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows that are not at the places ``barred``; ties to smaller places."""
        total, shift = self.scores(weights)
        open_ = self.valid.copy()
        for at in barred:
            open_[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        taken, n_taken = np.zeros_like(open_), 0
        for digit in reversed(total):
            with_digit = open_ & digit
            n = int(np.bitwise_count(with_digit).sum())
            if n_taken + n > k:
                open_ = with_digit
            else:
                taken, n_taken, open_ = taken | with_digit, n_taken + n, open_ & ~digit
                if n_taken == k:
                    break
        places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        chosen = np.sort(np.concatenate([places(taken), places(open_)[: k - n_taken]]))
        word, bit = chosen // 64, (chosen % 64).astype(np.uint64)
        kind = np.int64 if len(total) < 62 and abs(shift) < NARROW else object
        score = np.full(len(chosen), shift, kind)
        for t, digit in enumerate(total):
            score += (digit[word] >> bit & np.uint64(1)).astype(kind) * (1 << t)
        return chosen, score


def _blocks(rows_max: int, sliced: bool, scale: int):
    """(id, dim, v) to blocks (block, dim, n, ids, least, digits, bits) or, not sliced, the plain values as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dim)))
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], quantised(values[order], scale)
            least, digits, bits = Slices.parts(values) if sliced else (np.empty(0, np.int64), np.empty(0, np.int64), None)
            made += 1
            raw = lambda x: pa.array([x], pa.binary())
            content = packed(values) if bits is None else np.ascontiguousarray(bits).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made]), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), raw(ids.tobytes()), raw(packed(least)), raw(digits.tobytes()), raw(content)],
                ["block", "dim", "n", "ids", "least", "digits", "bits"],
            )

        for b in batches:
            dims, ids = b.column(1).to_numpy(), b.column(0).to_numpy()
            q = b.column(2)
            ends = q.offsets.to_numpy()
            flat = q.values.to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                values = flat[ends[mine][:, None] + np.arange(dim)]
                for at in range(0, len(mine), rows_max):
                    room = rows_max - sum(len(x) for x, _ in held.get(dim, []))
                    part = slice(at, at + rows_max)
                    if len(ids[mine][part]) > room:
                        yield block(dim)
                    held.setdefault(dim, []).append((ids[mine][part], values[part]))
        for dim in list(held):
            yield block(dim)

    return run


BLOCK_SCHEMA = "block long, dim int, n int, ids binary, least binary, digits binary, bits binary"


def _search(k: int):
    """Index blocks and query blocks of a group to (query_id, vec_id, score), k for each query."""

    def longs(x) -> np.ndarray:
        return np.frombuffer(x.as_py(), np.int64)

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        asked, found, scored = [], [], []
        blocks = [(longs(r["ids"]), Slices(unpacked(r["least"].as_py()), longs(r["digits"]), np.frombuffer(r["bits"].as_py(), np.uint64).reshape(-1, -(-r["n"].as_py() // 64)), r["n"].as_py()))
                  for r in ({c: index[c][i] for c in index.column_names} for i in range(index.num_rows))]
        for i in range(queries.num_rows if blocks else 0):
            own = longs(queries["ids"][i])
            for query, weights in zip(own.tolist(), unpacked(queries["bits"][i].as_py()).reshape(len(own), -1)):
                ids, scores = [], []
                for row_ids, slices in blocks:
                    lo, hi = np.searchsorted(row_ids, [query, query + 1])
                    at, score = slices.best(weights, np.arange(lo, hi), k)
                    ids.append(row_ids[at]), scores.append(score)
                ids, scores = np.concatenate(ids), np.concatenate(scores)
                if scores.dtype == object:
                    order = sorted(range(len(ids)), key=lambda x: (-scores[x], ids[x]))[:k]
                else:
                    order = np.lexsort((ids, -scores))[:k]
                asked.append(np.full(len(order), query)), found.append(ids[order]), scored.append(scores[order].astype(np.int64))
        column = lambda xs: pa.array(np.concatenate(xs) if xs else np.empty(0, np.int64), pa.int64())
        return pa.table({"query_id": column(asked), "vec_id": column(found), "score": column(scored)})

    return run


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The bit-sliced index, a row per block, as a table in the shared scratch folder."""
    return stored(arrow_pass(taking_part(vectors, id_col, vector_col), _blocks(BLOCK_ROWS, True, scale), BLOCK_SCHEMA), "bit-slices")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of ``queries`` the k best rows of ``vectors``."""
    prepare(vectors.sparkSession)
    index = build_index(vectors, id_col, vector_col, scale)
    asking = taking_part(queries, id_col, vector_col).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.dim", "x.v")
    asking = stored(arrow_pass(asking, _blocks(QUERY_ROWS, False, scale), BLOCK_SCHEMA), "query-blocks")
    n_index, n_asking = max(1, -(-index.count() // GROUP_BLOCKS)), max(1, -(-asking.count() // QUERY_BLOCKS))
    of = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = index.withColumn("g", of(n_index)).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(n_asking - 1))))
    right = asking.withColumn("h", of(n_asking)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))))
    # a group is heavy however few bytes it has: a partition for each, which adaptive execution leaves alone
    left, right = (x.repartition(n_index * n_asking, "g", "h", "dim") for x in (left, right))
    pairs = left.groupBy("g", "h", "dim").cogroup(right.groupBy("g", "h", "dim"))
    found = pairs.applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
