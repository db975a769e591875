"""Exact quantiles (linear interpolation, as pandas / DuckDB ``quantile_cont``) at scale.

Spark's exact ``percentile`` keeps every distinct value in one aggregation buffer.
Here each order statistic is enclosed between two values and the gap is narrowed:
``percentile_approx`` proposes two values close around the wanted rank, exact counts
say on which side of them (or on which of them) the rank lies, and the search goes on
strictly between them.  All columns and ranks share one wide aggregate per step, so a
step is one scan without a shuffle of rows, and the driver sees a few numbers per rank.
A step leaves about 4 values in 10,000, so a table of 10**12 rows takes four narrowings.
After the first step only the values that lie in an open gap are read on, from a small table of their own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.session import written

ACCURACY = 10_000


@dataclass
class _Rank:
    """The value of rank ``k`` (from 0) lies strictly between ``low`` and ``high`` (None: unbounded)."""

    column: str
    k: int
    low: float | None
    high: float | None
    below: int  # values at or below ``low``
    inside: int  # values strictly between
    near: tuple[float, float] | None = None
    value: float | None = None

    def between(self, x: Column) -> Column:
        low = F.lit(True) if self.low is None else x > F.lit(self.low)
        return low if self.high is None else low & (x < F.lit(self.high))

    def fractions(self, accuracy: int) -> list[float]:
        middle = (self.k - self.below + 0.5) / self.inside
        slack = 0.0 if self.few(accuracy) else 2.0 / accuracy
        return [max(0.0, middle - slack), min(1.0, middle + slack)]

    def few(self, accuracy: int) -> bool:
        """So few values that the sketch drops none and its answer is the order statistic."""
        return 4 * self.inside <= accuracy

    def settle(self, less: int, at_a: int, amid: int, at_b: int) -> None:
        """Take the exact counts around ``near`` = (a, b), of the values strictly between."""
        a, b = self.near
        less += self.below
        upto = [less, less + at_a, less + at_a + amid, less + at_a + amid + at_b]
        if self.k < upto[0]:
            self.high, self.inside = a, less - self.below
        elif self.k < upto[1]:
            self.value = a
        elif self.k < upto[2]:
            self.low, self.high, self.below, self.inside = a, b, upto[1], amid
        elif self.k < upto[3]:
            self.value = b
        else:
            self.low, self.inside, self.below = b, self.below + self.inside - upto[3], upto[3]


def _row(df: DataFrame, cells: Mapping[tuple, Column]) -> dict[tuple, object]:
    """One aggregate row, by cell."""
    keys = list(cells)
    row = df.agg(*[cells[c].alias(f"v{i}") for i, c in enumerate(keys)]).first()
    return {c: row[i] for i, c in enumerate(keys)}


def _inside(base: DataFrame, x: Mapping[str, Column], ranks: Sequence[_Rank]) -> DataFrame:
    """The values that lie in a gap of their column, others null; rows without any are left out."""
    held = {n: [r.between(c) for r in ranks if r.column == n] for n, c in x.items()}
    any_of = {n: reduce(lambda a, b: a | b, tests) for n, tests in held.items() if tests}
    rows = base.where(F.coalesce(reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), any_of.values(), F.lit(False)), F.lit(False)))
    return rows.select(*[F.when(any_of[n], c).alias(f"x{i}") if n in any_of else F.lit(None).cast("double").alias(f"x{i}") for i, (n, c) in enumerate(x.items())])


def exact_quantiles(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float], accuracy: int = ACCURACY) -> dict[str, list]:
    """{name: [q(p) for p in probs]} for the named expressions.

    NULL and NaN values are ignored; an expression without values maps to Nones.
    """
    names = list(values)
    if not names:
        return {}
    x = {n: F.col(f"x{i}") for i, n in enumerate(names)}
    base = df.select(*[F.nanvl(values[n].cast("double"), F.lit(None)).alias(f"x{i}") for i, n in enumerate(names)])

    around = [f for p in probs for f in (max(0.0, p - 2.0 / accuracy), min(1.0, p + 2.0 / accuracy))]
    first = _row(base, {(kind, n): agg for n in names for kind, agg in (
        ("n", F.count(x[n])), ("near", F.percentile_approx(x[n], around, accuracy)))})
    ranks: dict[tuple[str, int], _Rank] = {}
    wanted: dict[str, list] = {}
    for n in names:
        count = first["n", n]
        wanted[n] = []
        for i, p in enumerate(probs):
            if not count:
                wanted[n].append(None)
                continue
            place = (count - 1) * p
            lo = math.floor(place)
            hi = min(lo + 1, count - 1)
            wanted[n].append((lo, hi, place - lo))
            for k in (lo, hi):
                near = tuple(first["near", n][2 * i : 2 * i + 2])
                ranks.setdefault((n, k), _Rank(n, k, None, None, 0, count, near))

    narrowed = False
    while open_ := [r for r in ranks.values() if r.value is None]:
        counts: dict[tuple, Column] = {}
        for r in open_:
            v, (a, b) = x[r.column], r.near
            tests = (v < a, v == a, (v > a) & (v < b), (v == b) if b > a else F.lit(False))
            counts.update({(r.column, r.near, r.low, r.high, i): F.count_if(t & r.between(v)) for i, t in enumerate(tests)})
        found = _row(base, counts)
        for r in open_:
            r.settle(*(found[r.column, r.near, r.low, r.high, i] for i in range(4)))
        open_ = [r for r in open_ if r.value is None]
        if not open_:
            break
        if not narrowed:
            base, narrowed = written(_inside(base, x, open_), "quantiles"), True
        near = _row(base, {(r.column, r.k): F.percentile_approx(F.when(r.between(x[r.column]), x[r.column]), r.fractions(accuracy), accuracy)
                           for r in open_})
        for r in open_:
            r.near = tuple(near[r.column, r.k])
            if r.few(accuracy):
                r.value = r.near[0]

    value = lambda n, k: ranks[n, k].value
    mix = lambda a, b, part: a + part * (b - a) if part else a
    return {n: [w and mix(value(n, w[0]), value(n, w[1]), w[2]) for w in wanted[n]] for n in names}
