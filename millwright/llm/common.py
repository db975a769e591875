"""Shared pieces of the training-data operators: words, scratch tables, Arrow passes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import ensure_checkpoint_dir, scratch_path, ship_package

#: Fixed by the contracts: white space between words, and a word.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
#: The same characters as a string, for trimming.
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: White space (Unicode) in runs too long for the backtracking of tiktoken's own split.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2048,}")


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder known, package importable in Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage at a table that every executor can read again, so a lost
    executor costs a re-read and not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: empty), for Arrow passes that work on bytes."""
    return text_or_empty(text).cast("binary")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text: Column) -> Column:
    """Words of a text as an array (null: empty array)."""
    return F.filter(F.split(text_or_empty(text), rf"[{SPACE_CLASS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without materialising them twice: pieces less the empty ones at both ends."""
    t = F.btrim(text_or_empty(text), F.lit(SPACE_CHARS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, rf"[{SPACE_CLASS}]+"))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also inside lambdas of ``body``."""
    return F.transform(F.array(value), body)[0]


def arrow_pass(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers."""
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def ordinary_ids(encoding: tiktoken.Encoding, text: str) -> Iterator[list[int]]:
    """``encode_ordinary`` in parts, for patterns that split white space by ``\\s+(?!\\S)|\\s+``, with runs of any length.

    Such a run is one piece up to its last character, which goes with what follows (at the end of the text: one piece).
    """
    at = 0
    for m in LONG_SPACE.finditer(text) if len(text) >= 2048 else ():
        end = m.end() - (m.end() < len(text))
        if at < m.start():
            yield encoding.encode_ordinary(text[at : m.start()])
        yield encoding._encode_single_piece(text[m.start() : end])
        at = end
    yield encoding.encode_ordinary(text[at:] if at else text)
