"""Best-fit packing online, with a fixed number of open bins.

*Pieces.*  A text becomes ids and one end mark.  Only a longer run than a sequence is cut, into whole
sequences; what is left over is its first piece.

*Packing.*  Pieces come one by one, the longest of a packer first and equal ones by a hash.  The free room of the
open bins is a bitset, bit f for a room of f tokens, so the fullest bin that still has room for n
tokens is the lowest set bit from n up.  Where there is none a bin is opened; if ``open_bins`` are open already, the fullest
one closes first.  A piece gets its sequence and its place there at once and is never moved, so a packer
holds one number per open bin and no pieces.  The order is Spark's sort: on the pieces of sf0.1 eight times over, 79,004 sequences where
the tokens fill 78,961; in the order of a hash 79,859.

Scale: texts become ids in the tasks that read them; what is shuffled is one narrow row per piece.  A packer
gets about ``PIECES`` pieces whatever the corpus has, by a hash of a number that is each piece's own, so no document and no length
is hot.  All pieces are in a table before they are packed: a packer that is run again gets the same ones in the same order.

Defined results: a null or empty text is its end mark alone; rows are packed one by one, so null and repeated ids
need no rule; no rows give no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import arrow_pass, ordinary_ids, stored, text_or_empty

LENGTH = 1024
OPEN_BINS = 1 << 13
#: Pieces of one packer.
PIECES = 1 << 14
#: Characters that are turned into ids at once, and the least after which a text may be cut.
STRETCH = 1 << 18
#: Between a letter or digit and white space a text may be cut without any other ids: pieces of ``PATTERN`` that begin before end there.
SAFE = re.compile(r"(?<=[A-Za-z0-9])[\n ]")
# Fixed value: the pattern that the vocabulary's pre-tokenizer stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library, as its ``encode(text, add_special_tokens=False)``.

    The file's merges are in the order of their ids, so its tokens are ranks and the ids come from ``tiktoken``, five times as
    fast (tested to agree).  Added tokens are taken out of a text first, as the library does.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        steps = file["pre_tokenizer"]
        if file["model"]["type"] != "BPE" or steps["type"] != "ByteLevel" or steps["add_prefix_space"] or not steps["use_regex"] or file["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        to_byte = byte_of_char()
        self.added = {a["content"]: a["id"] for a in file["added_tokens"]}
        ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in file["model"]["vocab"].items() if t not in self.added}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        made = [file["model"]["vocab"]["".join(p)] for p in pairs]
        if made != sorted(made):
            raise ValueError(f"merges of {path} are not in the order of ids")
        self.size = max([*ranks.values(), *self.added.values()]) + 1
        self.own = tiktoken.Encoding("open-bins", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.apart = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def plain(self, text: str) -> Iterator[list[int]]:
        """Ids of a text without added tokens, a stretch at a time."""
        at = 0
        while len(text) - at > STRETCH and (m := SAFE.search(text, at + STRETCH)):
            yield from ordinary_ids(self.own, text[at : m.start()])
            at = m.start()
        yield from ordinary_ids(self.own, text[at:] if at else text)

    def ids(self, text: str, end_id: int) -> np.ndarray:
        """Ids of a text and the end mark, as unsigned 32-bit integers."""
        out, at = [], 0
        for m in self.apart.finditer(text) if self.apart else ():
            out += [np.array(x, "<u4") for x in self.plain(text[at : m.start()])] + [np.array([self.added[m[0]]], "<u4")]
            at = m.end()
        out += [np.array(x, "<u4") for x in self.plain(text[at:] if at else text)]
        return np.concatenate([*out, np.array([end_id], "<u4")])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(path)


def borders(n: int, length: int) -> list[int]:
    """Where the pieces of a run of ``n`` ids begin, and its end: whole lengths at the end, the rest first."""
    return [0, *range(n % length or length, n + 1, length)]


class OpenBins:
    """Online best fit into bins of ``length``, at most ``most`` of them open."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.rooms = 0  # bit f: a bin with f tokens free is open
        self.bins: list[list[int]] = [[] for _ in range(length)]  # open bins by free tokens
        self.n_open = self.made = 0

    def _taken(self, room: int) -> int:
        """An open bin with that room, no longer among the open ones."""
        found = self.bins[room].pop()
        if not self.bins[room]:
            self.rooms ^= 1 << room
        self.n_open -= 1
        return found

    def put(self, n: int) -> tuple[int, int]:
        """Bin and place of a piece of ``n`` tokens, 1 to ``length``."""
        fitting = self.rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            found = self._taken(room)
        else:
            found, room = self.made, self.length
            self.made += 1
        left = room - n
        if left:
            if self.n_open == self.most:
                self._taken((self.rooms & -self.rooms).bit_length() - 1)  # the fullest closes
            self.bins[left].append(found)
            self.rooms |= 1 << left
            self.n_open += 1
        return found, self.length - room


def pieces(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32, ids): the pieces of all documents, a table in the shared scratch folder.

    ``row`` numbers the pieces by task; ``ids`` are little-endian, 2 bytes each where the vocabulary allows it (null without ``with_ids``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = vocabulary(path), TaskContext.get().partitionId() << 40
        kind = "<u2" if max(own.size, end_id + 1) <= 1 << 16 else "<u4"
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        out: list[tuple] = []

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = own.ids(text.as_py(), end_id)
                places = borders(len(ids), length)
                for k, (a, b) in enumerate(zip(places, places[1:])):
                    part = ids[a:b]
                    out.append((row, doc, k, a, b - a, zlib.crc32(part.tobytes()), part.astype(kind).tobytes() if with_ids else None))
                    row += 1
                    if len(out) == PIECES:
                        yield sent()
                        out = []
        if out:
            yield sent()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return stored(arrow_pass(rows, run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"), "bin-pieces")


def place(cut: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, per_packer: int = PIECES) -> DataFrame:
    """``cut``, the result of ``pieces``, without ids, with sequence_id and offset."""
    packers = max(1, -(-cut.count() // per_packer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, bins = None, None
        for batch in batches:
            sequence, offset = [], []
            for mine, n in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist()):
                if mine != packer:
                    packer, bins = mine, OpenBins(length, open_bins)
                made, at = bins.put(n)
                sequence.append((mine << 40) + made)
                offset.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names[1:], "sequence_id", "offset"])

    columns = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    drawn = F.xxhash64("row")
    dealt = cut.select(F.pmod(drawn, F.lit(packers)).cast("long").alias("packer"), *columns)
    dealt = dealt.repartition(packers, "packer").sortWithinPartitions("packer", F.desc("length"), F.xxhash64("row", F.lit(1)))
    return arrow_pass(dealt, run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(pieces(docs, path, end_id, id_col, text_col, length, with_ids=False), length, open_bins).drop("row")


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, cu_seqlens, doc_ids): the packed sequences, joined from the pieces' ids in order of offset."""
    rows = placed.select("row", "sequence_id", "offset", "length").join(cut.select("row", "doc_id", "ids"), "row")
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", F.hex("ids").alias("ids"))))  # at most a sequence's tokens
    whole = rows.groupBy("sequence_id").agg(parts.alias("p"))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("p", lambda x: x["offset"] + x["length"]))
    return whole.select("sequence_id", "p", ends.alias("cu_seqlens")).select(
        "sequence_id", F.array_max("cu_seqlens").alias("n_tokens"), F.unhex(F.array_join(F.transform("p", lambda x: x["ids"]), "")).alias("ids"), "cu_seqlens",
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
    )
