"""Order statistics of many ranks and columns at once, exact, over all rows.

A double's bits, turned so that they sort as the numbers do, are a whole number.  The search keeps for each column the gaps of such numbers in
which wanted ranks lie; a pass over the rows counts each gap's values in ``PARTS`` equal parts, and the part of a rank is its next gap.  A gap
with at most ``FEW`` values has them listed, one that holds a single number is settled.  A pass leaves about 1 in 4,096 of the values of a gap, so
six passes are enough for any doubles and two or three do for most.  Every count is of whole numbers: no partitioning changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.common import ensure_parallel

PARTS = 1 << 12
FEW = 1 << 13
HELD = 1 << 20  # places that a task holds before it counts them
_TOP = np.uint64(1 << 63)

Gap = tuple[int, int, int, int, int]  # column, least and largest number, values below, values inside


def places(values: np.ndarray) -> np.ndarray:
    """Whole numbers that sort as the doubles do; -0 is 0."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def doubles(numbers: np.ndarray) -> np.ndarray:
    """The doubles of ``places``."""
    return np.where(numbers & _TOP, numbers ^ _TOP, ~numbers).view(np.float64)


def _pass(rows: DataFrame, gaps: list[Gap], few: int) -> dict[int, tuple[int, int, np.ndarray]]:
    """For each gap least and largest number and, as it has more than ``few`` or not, the counts of its parts or its numbers."""
    columns = sorted({g[0] for g in gaps})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: dict[int, list[np.ndarray]] = {}
        held: dict[int, list[np.ndarray]] = {}
        ends: dict[int, tuple[int, int]] = {}
        counts: dict[int, np.ndarray] = {}
        mine = {c: [i for i, g in enumerate(gaps) if g[0] == c] for c in columns}

        def settle(c: int) -> None:
            if c in held:
                v = np.sort(np.concatenate(held.pop(c)))
                for i in mine[c]:
                    _, low, high, _, inside = gaps[i]
                    a, b = np.searchsorted(v, np.array([low], np.uint64), "left")[0], np.searchsorted(v, np.array([high], np.uint64), "right")[0]
                    if b == a:
                        continue
                    if inside <= few:
                        listed.setdefault(i, []).append(v[a:b])
                    else:
                        part = ((v[a:b] - np.uint64(low)) // np.uint64((high - low) // PARTS + 1)).astype(np.int64)
                        counts[i] = counts.get(i, 0) + np.bincount(part, minlength=PARTS)
                    old = ends.get(i, (int(v[a]), int(v[a])))
                    ends[i] = min(old[0], int(v[a])), max(old[1], int(v[b - 1]))

        size = dict.fromkeys(columns, 0)
        for batch in batches:
            for c in columns:
                held.setdefault(c, []).append(places(batch.column(c).to_numpy(zero_copy_only=False)))
                size[c] += batch.num_rows
                if size[c] >= HELD:
                    settle(c)
                    size[c] = 0
        for c in columns:
            settle(c)
        for i, (low, high) in ends.items():
            cells = np.concatenate(listed[i]).tobytes() if i in listed else counts[i].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([str(low)]), pa.array([str(high)]), pa.array([cells], pa.binary())], ["gap", "low", "high", "cells"])

    def add(group: pa.Table) -> pa.Table:
        i, low, high = group["gap"][0].as_py(), min(map(int, group["low"].to_pylist())), max(map(int, group["high"].to_pylist()))
        cells = [np.frombuffer(c.as_buffer(), np.int64) for c in group["cells"]]
        cells = np.concatenate(cells) if gaps[i][4] <= few else sum(cells)
        return pa.Table.from_arrays([pa.array([i], pa.int32()), pa.array([str(low)]), pa.array([str(high)]), pa.array([cells.tobytes()], pa.binary())], ["gap", "low", "high", "cells"])

    names = "gap int, low string, high string, cells binary"
    found = rows.mapInArrow(count, names).groupBy("gap").applyInArrow(add, names).collect()
    return {r["gap"]: (int(r["low"]), int(r["high"]), np.frombuffer(r["cells"], np.int64)) for r in found}


def order_statistics(df: DataFrame, n: int, ranks: Sequence[int]) -> np.ndarray:
    """(column, rank) values of the ``ranks`` (from 0) of every column of ``df``: ``n`` > 0 rows of doubles, no nulls."""
    few, names = FEW, df.columns
    rows = ensure_parallel(df)
    ends = df.agg(*[f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("a", F.min), ("b", F.max))]).first()
    number = lambda v: int(places(np.array([v], float))[0])
    out = np.empty((len(names), len(ranks)))
    open_: dict[Gap, list[int]] = {(i, number(ends[f"a{i}"]), number(ends[f"b{i}"]), 0, n): list(range(len(ranks))) for i in range(len(names))}
    while open_:
        gaps, following = list(open_), {}
        for i, (least, largest, cells) in _pass(rows, gaps, few).items():
            column, low, high, below, inside = gaps[i]
            if least == largest:
                out[column, open_[gaps[i]]] = doubles(np.array([least], np.uint64))
            elif inside <= few:
                values = doubles(np.sort(cells.view(np.uint64)))
                for k in open_[gaps[i]]:
                    out[column, k] = values[ranks[k] - below]
            else:
                upto, width = np.cumsum(cells), (high - low) // PARTS + 1
                for k in open_[gaps[i]]:
                    j = int(np.searchsorted(upto, ranks[k] - below, "right"))
                    gap = (column, low + j * width, min(high, low + (j + 1) * width - 1), below + int(upto[j] - cells[j]), int(cells[j]))
                    following.setdefault(gap, []).append(k)
        open_ = following
    return out
