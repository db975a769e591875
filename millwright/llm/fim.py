"""Fill-in-middle: texts cut at two unit borders and put together anew around sentinels.

*Borders by words.*  The UTF-8 bytes of a stretch of texts are read as 64-bit words.  Arithmetic on
whole words marks every byte that ends a unit (a code point, or a line), one mark bit per byte;
``bitwise_count`` of each word and a running sum give the number of units before it.  The
place after the k-th unit of a text is then a search of the running sums for its word, and a
select inside that word: one multiplication spreads the marks to a prefix count in each byte, one
subtraction compares them with k.  All cuts of a stretch are found at once and no text is decoded.

*Draws.*  Numbers h1 to h4 are the first four groups of 8 hex digits of sha256("seed:id"), so a document is cut alike in any
run and under any partitioning.  The prefix ends after the smaller of h1 % (n+1) and h2 % (n+1) units, the middle
after the larger.  ``h3 % 100 >= percent`` leaves a text plain; ``h4 % 100 < spm_percent`` puts the
suffix first (spm), else the prefix (psm).

Scale: a map over the texts; a stretch holds at most ``STRETCH_BYTES`` or one text.

Defined results: a null or empty text is plain and empty; a text that contains a sentinel is plain, so that
``restore`` has one answer; a null id is drawn as the empty string; rows are cut one by one, so repeated rows
need no rule; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import arrow_pass, text_or_empty

UNITS = ("chars", "lines")
STRETCH_BYTES = 1 << 24

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        """A sentinel put between texts must not make another one with what stands beside it."""
        marks = astuple(self)
        for a in marks:
            for b in marks:
                inside = a is not b and a in b
                if not a or inside or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"sentinels {marks} are empty or overlap")
        if len(set(marks)) < 3:
            raise ValueError(f"sentinels {marks} repeat")


class Borders:
    """Rank and select of unit ends over a buffer of UTF-8 bytes."""

    def __init__(self, data: np.ndarray, unit: str):
        """``data``: the bytes, zero or more."""
        self.size = len(data)
        words = np.zeros(self.size // 8 + 2, "<u8")
        words.view(np.uint8)[: self.size] = data
        if unit == "chars":
            # a byte ends a code point if the next one does not continue it (10xxxxxx); bytes behind the end are zero and do not
            starts = ~((words >> np.uint64(7)) & ~(words >> np.uint64(6))) & ONES
            ends = starts >> np.uint64(8)
            ends[:-1] |= starts[1:] << np.uint64(56)
        else:
            zero = words ^ NEWLINES  # its zero bytes are the newlines
            ends = (~(((zero & LOW7) + LOW7) | zero | LOW7) & HIGH) >> np.uint64(7)
        behind = np.arange(len(words)) * 8 - self.size  # marks of the bytes that are none go
        ends[behind >= 0] = 0
        if self.size % 8:
            ends[self.size // 8] &= (np.uint64(1) << np.uint64(8 * (self.size % 8))) - np.uint64(1)
        self.ends = ends
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(ends), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Unit ends among the bytes before each place."""
        word, byte = at // 8, (at % 8).astype(np.uint64)
        below = self.ends[word] & ((np.uint64(1) << (np.uint64(8) * byte)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place behind the k-th unit end (from 1) for each k that there is."""
        word = np.searchsorted(self.before, k, side="left") - 1
        rest = (k - self.before[word]).astype(np.uint64)
        upto = self.ends[word] * ONES  # byte i: marks in the bytes 0 to i
        reached = ((upto | HIGH) - rest * ONES) & HIGH  # high bit where the count is at least the rest
        return word * 8 + 9 - np.bitwise_count(reached).astype(np.int64)


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Units, code points of prefix and middle, and the two places to cut, of each text ``data[offsets[i]:offsets[i + 1]]``.

    The rest behind the last newline of a text is a line as well.
    """
    borders = Borders(data, unit)
    ranks = borders.rank(offsets)
    first, counted = ranks[:-1], np.diff(ranks)
    n = counted.copy()
    if unit == "lines":
        n += (np.diff(offsets) > 0) & (data[np.maximum(offsets[1:] - 1, 0)] != 10) if len(data) else 0
    a, b = h1 % (n + 1), h2 % (n + 1)
    places = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        place = np.where(k > counted, offsets[1:], offsets[:-1])
        inner = (k > 0) & (k <= counted)
        place[inner] = borders.select((first + k)[inner])
        places.append(place)
    chars = ranks if unit == "chars" else Borders(data, "chars").rank(offsets)
    points = borders if unit == "chars" else Borders(data, "chars")
    at = [points.rank(p) for p in places]
    return n, at[0] - chars[:-1], at[1] - at[0], places[0], places[1]


def draws(id_col: Column, seed: int) -> list[Column]:
    """h1 to h4."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20,
    sentinels: Sentinels = Sentinels(), unit: str = "chars",
) -> DataFrame:
    """A row per document: ``doc``, a struct of the columns in ``carry``, and ``fim``, a struct of n (units), form
    (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and output (the text put together anew).
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    marks = {k: v.encode() for k, v in zip("PSM", astuple(sentinels))}

    def stretches(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        start = 0
        while start < len(offsets) - 1:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + STRETCH_BYTES, side="right")) - 1)
            yield start, end
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, forms, h1, h2 = (batch.column(k) for k in range(1, 5))
            wide = pa.types.is_large_binary(texts.type)
            offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64)
            whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for s, e in stretches(offsets):
                lo, hi = int(offsets[s]), int(offsets[e])
                data = whole[lo:hi]
                n, prefix, middle, p, q = cuts(data, offsets[s : e + 1] - lo, h1.slice(s, e - s).to_numpy(), h2.slice(s, e - s).to_numpy(), unit)
                raw, form, out = data.tobytes(), forms.slice(s, e - s).to_pylist(), []
                for f, a, x, y, z in zip(form, (offsets[s:e] - lo).tolist(), p.tolist(), q.tolist(), (offsets[s + 1 : e + 1] - lo).tolist()):
                    if f == "plain":
                        out.append(raw[a:z])
                    elif f == "psm":
                        out.append(b"".join((marks["P"], raw[a:x], marks["S"], raw[y:z], marks["M"], raw[x:y])))
                    else:
                        out.append(b"".join((marks["S"], raw[y:z], marks["P"], raw[a:x], marks["M"], raw[x:y])))
                plain = np.array([f == "plain" for f in form])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), pa.array(n, pa.int64()), forms.slice(s, e - s), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(out, pa.binary())],
                    ["doc", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    text = text_or_empty(F.col(text_col))
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    holds = [F.contains(text, F.lit(m)) for m in astuple(sentinels)]
    plain = (text == "") | holds[0] | holds[1] | holds[2] | (h3 % 100 >= percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("doc"), text.cast("binary").alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary"
    found = arrow_pass(rows, run, schema)
    kept = [F.col(c) for c in ("n", "form", "prefix_chars", "middle_chars")]
    return found.select("doc", F.struct(*kept, F.col("output").cast("string").alias("output")).alias("fim"))


def restore(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text of an output, from the output and its form alone."""
    p, s, m = map(F.lit, astuple(sentinels))
    part = lambda text, mark, k: F.split_part(text, mark, F.lit(k))
    middle, before = part(output, m, 2), part(output, m, 1)
    psm = F.concat(part(part(before, s, 1), p, 2), middle, part(before, s, 2))
    spm = F.concat(part(before, p, 2), middle, part(part(before, p, 1), s, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
