"""The corpus pipeline: five stages over ``documents``, each a table that the next one reads.

quality rules -> line dedup -> SimHash near-dedup -> mixing to target weights -> byte-level BPE.
All but the last stage return the columns of ``documents``; the last one returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import bpe, linedupe, mixing, quality, simhash
from millwright.llm.common import prepare, stored, text_bytes

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines removed from the texts; ``n_chars`` follows the text."""
    prepare(spark)
    out = linedupe.dedup_lines(docs, min_chars=40, min_docs=5)
    doc, changed = F.col("doc"), F.col("lines.n_dropped") > 0
    chars = F.when(changed, F.length(doc["text"]).cast("long")).otherwise(doc["n_chars"])
    return out.select(*[(chars if c == "n_chars" else doc[c]).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of 3 words, at most 3 bits."""
    prepare(spark)
    return simhash.one_of_each(docs, shingle=3, bits=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as often as it is drawn."""
    prepare(spark)
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    prepare(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = docs.select("doc_id", "lang", "source", "text", F.sha2(text_bytes(F.col("text")), 256).alias("digest"))
    out = bpe.encode(docs, path, pattern, ["doc_id", "lang", "source", "digest"], decoded=True)
    whole = F.sha2("decoded", 256) == F.col("doc.digest")
    return out.select("doc.doc_id", "doc.lang", "doc.source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte bpe", bpe_stage),
]

#: No SQL for fingerprints and token ids; tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is written and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k + 1}")
    return docs
