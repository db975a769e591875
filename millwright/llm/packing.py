"""Token-id output: documents packed into fixed-length rows by best-fit decreasing.

A text becomes ids and one end mark; a run longer than a row is split losslessly into whole
rows and a rest (each part knows its document and its offset).  Parts are packed
longest first, each into the fullest row that still has room; that row is found by
a segment tree over capacities in about log2(row length) steps.  A packed row is written as
ids (padded to the row length), the cumulative lengths of its segments and the position of each id
in its segment.

Scale: a task packs what it reads, ``CHUNK_TOKENS`` at a time, so no token is shuffled and memory is bounded;
at most the last row of a chunk is far from full.  A lost task is run again on the
same split of the input.  Ids are stored in two bytes where the vocabulary allows it.

Defined results: a null or empty text is its end mark alone; rows are packed one by one, so null and
repeated ids need no rule; an empty table gives no packed rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import arrow_pass, ordinary_ids, text_or_empty

ROW = 2048
CHUNK_TOKENS = 1 << 21


class Rows:
    """Open rows by the room they have left, with a segment tree over the amounts of room."""

    def __init__(self, length: int):
        self.leaves = 1 << max(0, length).bit_length()
        self.any = bytearray(2 * self.leaves)  # whether a row with room in this part of the tree is open
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, row: int, room: int) -> None:
        self.open[room].append(row)
        k = self.leaves + room
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open row with the least room that is at least ``need``, and its room."""
        k = self.leaves + need
        while not self.any[k]:  # up, to the first part on the right that has one
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.leaves:  # down, leftmost
            k = 2 * k + (not self.any[2 * k])
        room = k - self.leaves
        row = self.open[room].pop()
        if not self.open[room]:
            while k and not (k < self.leaves and (self.any[2 * k] or self.any[2 * k + 1])):
                self.any[k] = 0
                k >>= 1
        return row, room


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Places of the lengths (1 to ``length``) in each row."""
    tree, rows = Rows(length), []
    for part in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[part])
        if found is None:
            found = len(rows), length
            rows.append([])
        row, room = found
        rows[row].append(part)
        if room > lengths[part]:
            tree.put(row, room - lengths[part])
    return rows


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack(docs: DataFrame, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = ROW) -> DataFrame:
    """Packed rows: pack (task and number), n_tokens, ids (binary, ``length`` ids of ``id_bytes`` each, little-endian), cu_seqlens,
    positions (binary, 32 bit), doc_ids and offsets of the segments.

    ``end_id``, a free id of the vocabulary, ends each document and fills the rest of a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, own = TaskContext.get().partitionId(), 0, _encoding(path, pattern)
        kind = np.dtype("<u2") if max(own.n_vocab, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        parts: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal made
            out: dict[str, list] = {c: [] for c in ("pack", "n_tokens", "id_bytes", "ids", "cu_seqlens", "positions", "doc_ids", "offsets")}
            for row in best_fit_decreasing([len(x) for _, _, x in parts], length):
                mine = [parts[k] for k in row]
                sizes = [len(x) for _, _, x in mine]
                n = sum(sizes)
                ids, positions = np.full(length, end_id, kind), np.zeros(length, "<i4")
                ids[:n] = np.concatenate([x for _, _, x in mine])
                positions[:n] = np.concatenate([np.arange(k) for k in sizes])
                values = ((task << 32) + made, n, kind.itemsize, ids.tobytes(), np.cumsum([0, *sizes], dtype=np.int32), positions.tobytes(), [d for d, _, _ in mine], [o for _, o, _ in mine])
                for c, v in zip(out, values):
                    out[c].append(v)
                made += 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*chain.from_iterable(ordinary_ids(own, text.as_py())), end_id], kind)
                parts += [(doc, at, ids[at : at + length]) for at in range(0, len(ids), length)]
                held += len(ids)
                if held >= CHUNK_TOKENS:
                    yield packed()
                    parts, held = [], 0
        if parts:
            yield packed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    schema = "pack long, n_tokens int, id_bytes int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, offsets array<long>"
    return arrow_pass(rows, run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet files under ``path``, in the order of ``pack`` inside a file."""
    packed.sortWithinPartitions("pack").write.parquet(path)


def unpack(packed: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, offset, piece): the bytes of each segment without end marks; joined by offset they are the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoding(path, pattern)
        for b in batches:
            docs, offsets, pieces = [], [], []
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").tolist()
                for doc, offset, a, e in zip(r["doc_ids"], r["offsets"], r["cu_seqlens"], r["cu_seqlens"][1:]):
                    docs.append(doc), offsets.append(offset)
                    pieces.append(own.decode_bytes([i for i in ids[a:e] if i < own.n_vocab]))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(offsets, pa.int64()), pa.array(pieces, pa.binary())], ["doc_id", "offset", "piece"])

    return arrow_pass(packed.select("ids", "id_bytes", "cu_seqlens", "doc_ids", "offsets"), run, "doc_id long, offset long, piece binary")
