"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

A piece is not merged pair by pair.  Two tokens may stand side by side in an encoding
exactly if BPE, run on their joined bytes, leaves the border between them; an encoding
of a piece is the one sequence of tokens whose neighbours all may.  It is found from
the left: take the longest token that matches, go to shorter ones while it may not
follow the last, step back where none does.  Places found to lead nowhere are never tried again and
verdicts on pairs of tokens are kept, so the work is linear in the piece.

The longest token at each place comes from one pass of an Aho-Corasick automaton over
the reversed piece.  pyahocorasick works on strings, so bytes are mapped to Latin-1,
one character each.

Ranks are read by each Python worker from a path, once.  Pieces met before are taken
from a bounded table.

Defined results: a null or empty text has no ids and decodes to nothing.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import arrow_pass, text_or_empty

#: Token pairs, and twice as many pieces, that a worker remembers; a table that is full is begun anew.
PIECES_KEPT = 1 << 18
PAIRS_KEPT = 1 << 19
#: Ids that an Arrow batch to Spark has before another one is begun.
IDS_SENT = 1 << 19
#: Longer pieces have their matches in an array.
SHORT_PIECE = 256
#: Longer pieces are not worth remembering.
PIECE_CHARS = 64


class FirstMatches:
    """The first match of each end of a long piece, with the reading side of a dictionary."""

    def __init__(self, n: int, matches: Iterator[tuple[int, int]]):
        self.tokens, last = array("i", [-1]) * n, -1
        for end, token in matches:
            if end != last:
                self.tokens[end] = token
                last = end

    def get(self, end: int, default: int) -> int:
        token = self.tokens[end]
        return default if token < 0 else token


class Codec:
    """Encoder for a table of ranks (bytes to id) and a pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.halves: dict[int, tuple[int, int]] = {}  # of each merged token the two tokens of its last merge
        self.merged: dict[tuple[int, int], int] = {}
        for token, i in ranks.items():
            if len(token) > 1 and (pair := self._last_merge(token, i)):
                self.halves[i] = pair
                self.merged[pair] = i
        usable = {t: i for t, i in ranks.items() if len(t) == 1 or i in self.halves}
        self.length = {i: len(t) for t, i in usable.items()}
        #: the longest token that is a proper prefix of a token
        self.shorter: dict[int, int] = {}
        for t, i in usable.items():
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in usable:
                    self.shorter[i] = usable[t[:n]]
                    break
        self.automaton = ahocorasick.Automaton()
        for t, i in usable.items():
            if len(t) > 1:
                self.automaton.add_word(t[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.single = [ranks[bytes([k])] for k in range(256)]
        self.fits: dict[int, int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.old_pieces: dict[str, tuple[int, ...]] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that BPE has before it makes ``token``; None if its merges never make it."""
        parts, ranks = [token[k : k + 1] for k in range(len(token))], self.ranks
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                if (r := ranks.get(parts[k] + parts[k + 1], rank)) < best:
                    best, at = r, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def _border_stays(self, left: int, right: int) -> bool:
        """Whether BPE on the bytes of both tokens leaves the border between them.

        Undoes the merges of both tokens, the latest (greatest id) first.  A merge across
        the border would have to come before the merges undone so far: ``bound`` is the
        least of them (from the left token: strictly before, as equal ranks merge from the left).
        """
        bound, merged, halves = 1 << 62, self.merged, self.halves
        while True:
            across = merged.get((left, right))
            if across is not None and across < bound:
                return False
            undo_left = left in halves and (left > right or right not in halves)
            if undo_left:
                bound, left = left, halves[left][1]
            elif right in halves:
                bound, right = right + 1, halves[right][0]
            else:
                return True

    def first_fit(self, left: int, token: int) -> int:
        """The first of a token, its longest prefix token, and so on, that may follow ``left``; -1: none."""
        key = left << 32 | token
        fit = self.fits.get(key)
        if fit is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            while token >= 0 and not self._border_stays(left, token):
                token = self.shorter.get(token, -1)
            fit = self.fits[key] = token
        return fit

    def piece_ids(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        matches = self.automaton.iter(piece[::-1].decode("latin-1"))
        if len(piece) <= SHORT_PIECE:
            # an end's matches come longest first, so of the reversed list the longest stays
            longest = dict(reversed(list(matches)))
        else:  # one number for each place, whatever the matches
            longest = FirstMatches(len(piece), matches)
        length, known, single, end = self.length, self.fits.get, self.single, len(piece) - 1
        n, at, out, last = len(piece), 0, [], -1
        dead: set[int] = set()  # places from which no encoding goes on
        token = longest.get(end, single[piece[0]])
        while at < n:
            if last >= 0 and token >= 0:
                fit = known(last << 32 | token)
                token = self.first_fit(last, token) if fit is None else fit
            if dead:
                while token >= 0 and at + length[token] in dead:
                    token = self.shorter.get(token, -1)
                    if last >= 0 and token >= 0:
                        token = self.first_fit(last, token)
            if token >= 0:
                out.append(token)
                last = token
                at += length[token]
                if at < n:
                    token = longest.get(end - at, -1)
                    if token < 0:
                        token = single[piece[at]]
            else:
                dead.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= length[token]
        return tuple(out)

    def _met(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece that was not in the table of new pieces."""
        ids = self.pieces.get(piece) or self.old_pieces.get(piece)
        if ids is None:
            ids = self.piece_ids(piece.encode())
        if len(piece) <= PIECE_CHARS:
            if len(self.pieces) >= PIECES_KEPT:  # pieces in use move to the new table, the others go
                self.old_pieces = dict(self.pieces)
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[tuple[int, ...]]:
        """Ids of a text, piece by piece."""
        pieces = self.split(text)
        found = list(map(self.pieces.get, pieces))
        k = -1
        for _ in range(found.count(None)):
            k = found.index(None, k + 1)
            found[k] = self._met(pieces[k])
        return found


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    own = Codec(read_ranks(path), pattern)
    gc.freeze()  # the tables stay; they need not be searched for garbage again and again
    return own


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[int, bytes]:
    """Bytes of each id; all that decoding needs."""
    return {i: t for t, i in read_ranks(path).items()}


def encode(docs: DataFrame, path: str, pattern: str, carry: list[str], text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The columns ``carry`` of ``docs`` as a struct ``doc``, and ``ids``, an array of the text's token ids.

    ``decoded``: also the bytes that the ids decode to, in the same pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        token = vocabulary(path).__getitem__ if decoded else None
        for b in batches:
            flat, ends, texts, first = array("i"), [0], [], 0
            for k, text in enumerate(b.column(1), 1):
                flat.extend(chain.from_iterable(own.encode(text.as_py())))
                if token:
                    texts.append(b"".join(map(token, flat[ends[-1] :])))
                ends.append(len(flat))
                if len(flat) >= IDS_SENT or k == b.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
                    columns = [b.column(0).slice(first, k - first), lists, *[pa.array(texts, pa.binary())] * decoded]
                    yield pa.RecordBatch.from_arrays(columns, ["doc", "ids", "decoded"][: len(columns)])
                    flat, ends, texts, first = array("i"), [0], [], k

    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("doc"), text_or_empty(F.col(text_col)).alias("text"))
    return arrow_pass(rows, run, f"doc {rows.schema['doc'].dataType.simpleString()}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc, ids) with ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(path).__getitem__
        for b in batches:
            ids = b.column(1)
            texts = pa.array([b"".join(map(token, x.values.to_numpy().tolist())) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, texts], ["doc", "ids", "decoded"])

    kind = encoded.schema["doc"].dataType.simpleString()
    return arrow_pass(encoded, run, f"doc {kind}, ids array<int>, decoded binary")
