"""Substring dedup of word passages by difference-cover anchors.

A set D of residues is a difference cover of the period v if every residue is a
difference of two of its members.  Then for any two places i and j in texts there is a
shift below v that brings both onto a place whose number modulo v is in D.  So if only
runs of ``min_words - v + 1`` words that begin at such *cover places* are hashed, two equal
passages of ``min_words`` words share at least one aligned anchor: six hashes per 31
words find every match.

1. *Anchors*: hashes at cover places; an anchor is shared if two ids hold it.
2. *Extension*: a window of ``min_words`` words that has a shared anchor at an aligned
   place is hashed whole (128 bits); it is covered if its least holder has a smaller id.
3. *Removal*: the words of covered windows go; windows are judged on the input.

Exact copies of a text are set aside first: the least holder stands for them, and a copy
of at least ``min_words`` words loses all of them.

Scale: a task first combines what it has read.  Of the holders of an anchor (a window) in the
task's chunk only the least goes into the shuffle by hash; the others are already known
to be shared (covered) and go by their own id.  So a passage in a third of all documents puts
one row per chunk on its key, and no group of copies meets in one task.  Texts are
shuffled once: the joins before all three steps reuse one exchange.

Defined results: a null text has no words; rows without an id are no source for others
and stay whole; rows that repeat an id are no source for each other; texts below
``min_words`` words stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import arrow_pass, stored, text_or_empty

# Perfect difference sets by their period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Shortest anchor in words.
ANCHOR_WORDS = 8
#: Hashes that a task gathers before it combines them.
CHUNK = 1 << 20
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = 1 << 64


class Rolling:
    """Hashes of runs of words, equal for equal runs wherever they stand."""

    def __init__(self) -> None:
        self.powers = [np.ones(1, np.uint64)] * 2
        self.inverses = [np.ones(1, np.uint64)] * 2

    def _reach(self, n: int) -> None:
        have = len(self.powers[0])
        if have > n:
            return
        n = max(n + 1, 2 * have)
        for lane, base in enumerate(BASES):
            for kept, factor in ((self.powers, base), (self.inverses, pow(base, -1, _WORD))):
                more = np.empty(n, np.uint64)
                more[:have] = kept[lane]
                at = int(more[have - 1])
                for k in range(have, n):
                    at = at * factor % _WORD
                    more[k] = at
                kept[lane] = more

    def sums(self, words: list[bytes], lane: int, digests: np.ndarray) -> np.ndarray:
        n = len(words)
        self._reach(n)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(digests[:, lane] * self.powers[lane][:n], dtype=np.uint64)])

    def runs(self, sums: np.ndarray, lane: int, starts: np.ndarray, length: int) -> np.ndarray:
        return (sums[starts + length] - sums[starts]) * self.inverses[lane][starts]


def digests(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


class Cover:
    """Cover places and anchor length for passages of ``min_words`` words."""

    def __init__(self, min_words: int):
        fit = [v for v in COVERS if min_words - v + 1 >= ANCHOR_WORDS]
        self.min_words = min_words
        self.period = max(fit) if fit else 1
        self.residues = np.array(COVERS[self.period] if fit else (0,))
        self.anchor = min_words - self.period + 1

    def places(self, n_words: int) -> np.ndarray:
        last = n_words - self.anchor
        if n_words < self.min_words:
            return np.empty(0, np.int64)
        every = (np.arange(0, last + 1, self.period)[:, None] + self.residues).ravel()
        return every[every <= last]


def _progressions(keys: tuple[np.ndarray, ...], at: np.ndarray, step: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted places, by keys, as arithmetic progressions: their first rows, lengths and steps.

    A passage repeated on and on in a text has its windows at such places.  ``step``: only this one.
    """
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    same = np.r_[False, np.logical_and.reduce([k[1:] == k[:-1] for k in keys])]
    gap = np.r_[0, np.diff(at)]
    goes_on = same & (gap == step if step else ~np.r_[False, same[:-1]] | (gap == np.r_[0, gap[:-1]]))
    starts = np.flatnonzero(~goes_on)
    n = np.diff(np.r_[starts, len(at)])
    return starts, n, np.where(n > 1, gap[np.minimum(starts + 1, len(at) - 1)], 1)


def _column(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values)


def _anchor_pass(cover: Cover):
    """(id, text) to rows (h, id, known): anchors, each once per chunk, and known ones by id."""

    def combined(ids: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        doc, h = np.concatenate(ids), np.concatenate(hashes)
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        once = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        doc, h = doc[once], h[once]
        first = np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(first) - 1
        many = (np.bincount(group) > 1)[group]
        return pa.RecordBatch.from_arrays(
            [_column(np.r_[h[first], h[many]]), _column(np.r_[doc[first], doc[many]]), pa.array(np.r_[np.zeros(first.sum(), bool), np.ones(many.sum(), bool)])],
            ["h", "id", "known"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, ids, hashes, held = Rolling(), [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                if not text.is_valid:
                    continue
                words = text.as_py().split()
                places = cover.places(len(words))
                if not len(places):
                    continue
                h = rolling.runs(rolling.sums(words, 0, digests(words)), 0, places, cover.anchor)
                ids.append(np.full(len(h), doc, np.int64))
                hashes.append(h)
                held += len(h)
                if held >= CHUNK:
                    yield combined(ids, hashes)
                    ids, hashes, held = [], [], 0
        if held:
            yield combined(ids, hashes)

    return run


def _window_pass(cover: Cover):
    """(id, th, text or null, shared) to rows (k1, k2, id, th, at, n, step, known): windows to ask about, and covered ones."""

    def combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h1, h2, doc, th, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, th, doc, h2, h1))
        h1, h2, doc, th, at = h1[order], h2[order], doc[order], th[order], at[order]
        first = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        least = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
        known, ask = doc > least, doc == least
        order = np.lexsort((at[known], th[known], doc[known]))
        d, t, a = doc[known][order], th[known][order], at[known][order]
        starts, n, _ = _progressions((d, t), a, step=1)
        known_rows = (d[starts], t[starts], d[starts], t[starts], a[starts], n, np.ones_like(n), np.ones(len(n), bool))
        h1, h2, doc, th, at = h1[ask], h2[ask], doc[ask], th[ask], at[ask]
        starts, n, step = _progressions((h1, h2, doc, th), at)
        ask_rows = (h1[starts].view(np.int64), h2[starts].view(np.int64), doc[starts], th[starts], at[starts], n, step, np.zeros(len(n), bool))
        kinds = (np.int64,) * 4 + (np.int32,) * 3 + (bool,)
        return pa.RecordBatch.from_arrays([pa.array(np.r_[x, y].astype(k)) for x, y, k in zip(ask_rows, known_rows, kinds)], ["k1", "k2", "id", "th", "at", "n", "step", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, parts, held = Rolling(), [], 0
        for b in batches:
            for doc, th, text, shared in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if not text.is_valid:
                    continue
                words = text.as_py().split()
                places = cover.places(len(words))
                if not len(places):
                    continue
                both = digests(words)
                first = rolling.sums(words, 0, both)
                found = np.isin(rolling.runs(first, 0, places, cover.anchor).view(np.int64), shared.values.to_numpy())
                marks = np.zeros(len(words) + 1, np.int64)
                marks[places[found] + 1] = 1
                upto = np.cumsum(marks)
                starts = np.arange(len(words) - cover.min_words + 1)
                starts = starts[upto[starts + cover.period] > upto[starts]]
                if not len(starts):
                    continue
                h1 = rolling.runs(first, 0, starts, cover.min_words)
                h2 = rolling.runs(rolling.sums(words, 1, both), 1, starts, cover.min_words)
                parts.append((h1, h2, np.full(len(h1), doc, np.int64), np.full(len(h1), th, np.int64), starts))
                held += len(h1)
                if held >= CHUNK:
                    yield combined(parts)
                    parts, held = [], 0
        if held:
            yield combined(parts)

    return run


def _removal_pass(min_words: int):
    """(id, th, text, gone, copy) to rows (id, kept, n_words, n_removed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n_words, n_removed = [], [], []
            for th, text, gone, copy in zip(b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4).to_pylist()):
                words = text.as_py().split()
                n_words.append(len(words))
                if copy and len(words) >= min_words:
                    words = []
                elif gone.is_valid:
                    runs = gone.values
                    mine = runs.field("th").to_numpy() == th
                    at, n, step = (runs.field(c).to_numpy()[mine].astype(np.int64) for c in ("at", "n", "step"))
                    starts = np.repeat(at, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * np.repeat(step, n)
                    change = np.bincount(starts, minlength=len(words) + 1)
                    change -= np.bincount(starts + min_words, minlength=len(words) + 1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                kept.append(b" ".join(words))
                n_removed.append(n_words[-1] - len(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["id", "kept", "n_words", "n_removed"]
            )

    return run


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(id, kept, n_words, n_removed): each row's words without the covered ones, joined by one space."""
    cover = Cover(min_words)
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    firsts = _first_of_copies(docs, id_col, text_col)

    # outer joins on all ways and no filter beside them, so that the texts are shuffled once
    told = rows.join(firsts, "id", "left").select("id", F.when(F.array_contains("firsts", F.col("th")), F.col("text")).alias("text"))
    anchors = arrow_pass(told, _anchor_pass(cover), "h long, id long, known boolean")
    anchors = anchors.withColumn("key", F.when(F.col("known"), F.col("id")).otherwise(F.col("h")))
    key = Window.partitionBy("known", "key")
    shared = anchors.select("*", F.min("id").over(key).alias("lo"), F.max("id").over(key).alias("hi")).filter("known OR lo < hi")
    shared = shared.groupBy("id").agg(F.collect_set("h").alias("shared"))

    candidates = rows.join(shared, "id", "left").join(firsts, "id", "left")
    candidates = candidates.select("id", "th", F.when(F.col("shared").isNotNull() & F.array_contains("firsts", F.col("th")), F.col("text")).alias("text"), "shared")
    windows = arrow_pass(candidates, _window_pass(cover), "k1 long, k2 long, id long, th long, at int, n int, step int, known boolean")
    windows = windows.withColumn("lo", F.min("id").over(Window.partitionBy("known", "k1", "k2"))).filter("known OR id > lo")
    gone = windows.groupBy("id").agg(F.collect_list(F.struct("th", "at", "n", "step")).alias("gone"))

    last = rows.join(gone, "id", "left").join(firsts, "id", "left")
    copy = F.col("id").isNotNull() & ~F.coalesce(F.array_contains("firsts", F.col("th")), F.lit(False))
    return arrow_pass(last.select("id", "th", "text", "gone", copy.alias("copy")), _removal_pass(min_words), "id long, kept string, n_words long, n_removed long")


def _first_of_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, firsts): of each id the texts (by hash) of which it is the least holder.

    Any other row of such a text is a copy: all its windows start in the least holder, too.
    """
    text = text_or_empty(F.col(text_col))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(7), text).alias("th2"))
    least = narrow.filter("id IS NOT NULL").groupBy("th", "th2").agg(F.min("id").alias("id"))
    return stored(least.groupBy("id").agg(F.collect_set("th").alias("firsts")), "first-copies")
