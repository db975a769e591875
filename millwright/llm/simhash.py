"""SimHash near-dedup: fingerprints linked within a few bits by a Gray-order hierarchical index.

1. *Fingerprints*: an Arrow pass over the texts hashes every shingle (XXH64, seed 42)
   and takes the majority of each bit.
2. *Groups*: two fingerprints that differ in at most ``bits`` of their 64 bits agree on
   one of ``bits + 1`` blocks of bits (pigeonhole), so only fingerprints equal on a block
   are compared.  A group above ``GROUP_MAX`` is dealt again by blocks of the bits that
   are still open, level by level, until each fits; a group with r open bits has at most
   2**r fingerprints, so this ends, and no pair is lost on the way.
3. *Index in each group*: fingerprints sorted by Gray rank (neighbours differ in few bits)
   are the leaves; each upper node of 8 holds the bits its members share.  A search goes
   down from the root, adds the differences on the bits that a node shares beyond its
   parent, and drops the whole node when the sum exceeds ``bits``.  All searches of an
   Arrow batch run level by level as numpy arrays.
4. *Components*: a group emits a spanning star of its links, never all pairs; star
   contraction finds the components.

Equal fingerprints are one node, so a group of copies of any size costs one row per task.

Defined results: a text without words (null, empty, white space) has fingerprint 0 and
links like any other; rows with a null id link others but are no component id (a component of
only such rows has a null id); rows that repeat an id are each returned.  ``one_of_each`` decides by
(id, text): of rows that repeat an id each goes or stays by the component of its own text, and rows
that repeat both share their verdict, so whole repeats of a least row all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import arrow_pass, stored, text_bytes, text_or_empty
from millwright.llm.components import smallest_reachable

FANOUT = 8
DEPTH = 3
#: Fingerprints in a group that one search takes: FANOUT ** DEPTH.
GROUP_MAX = FANOUT**DEPTH
#: Fingerprints searched at once; bounds the candidate arrays of a level.
SEARCH_ROWS = 4096
#: Shingle hashes held at once while a text is fingerprinted.
HASH_ROWS = 1 << 16
SHINGLE = 3
BITS = 3


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles of a text, unsigned."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    n, ones, hashed, digest = 0, np.zeros(64, np.int64), [], xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(p, 42) for p in pieces), np.uint64)
    n = len(hashed)
    for at in range(0, n, HASH_ROWS):
        part = hashed[at : at + HASH_ROWS].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long; ``keyed`` adds ``key``, the hash of the text."""
    key = [_text_key(F.col(text_col)).alias("key")] if keyed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["id", "fp", *["key"][: len(b.columns) - 2]])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("text"), *key)
    return arrow_pass(rows, run, "id long, fp long" + ", key long" * keyed)


def _text_key(text: Column) -> Column:
    return F.xxhash64(text_or_empty(text))


def _parts(mask: int, n: int) -> list[int]:
    """The bits outside ``mask`` in ``n`` blocks, each joined with ``mask``."""
    open_bits = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(open_bits) * k // n for k in range(n + 1)]
    return [mask | sum(1 << k for k in open_bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray code."""
    x = x.astype(np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def _shared(bits_and: np.ndarray, bits_or: np.ndarray) -> np.ndarray:
    """Mask of the bits in which all members agree."""
    return bits_and | ~bits_or


def linked_pairs(fps: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of members of one group within ``bits`` bits.

    ``group`` is sorted; within a group ``fps`` (uint64) is in Gray order, at most GROUP_MAX each.
    """
    n = len(fps)
    first = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
    size = np.diff(np.r_[first, n])
    rank = np.arange(n) - np.repeat(first, size)
    # nodes of a level: start and end of their leaves, shared mask, pattern, first child
    levels = []
    for depth in range(DEPTH, 0, -1):
        starts = np.flatnonzero(rank % FANOUT**depth == 0)
        a, o = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
        levels.append((starts, np.r_[starts[1:], n], _shared(a, o), a))
    levels.append((np.arange(n), np.arange(n) + 1, np.full(n, ~np.uint64(0)), fps))
    # every search begins at the root of its group, with nothing compared so far
    query, node, seen, parent = np.arange(n), np.repeat(np.arange(len(first)), size), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    for k, (starts, ends, mask, pattern) in enumerate(levels):
        beyond = mask[node] & ~parent
        seen = seen + np.bitwise_count((fps[query] ^ pattern[node]) & beyond)
        alive = (seen <= bits) & (ends[node] > query + 1)  # later members only: each pair once
        query, node, seen = query[alive], node[alive], seen[alive]
        if k == DEPTH:
            return query, node
        below = levels[k + 1][0]
        child = np.searchsorted(below, starts[node])
        many = np.searchsorted(below, ends[node]) - child
        parent = np.repeat(mask[node], many)
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        query, seen, node = np.repeat(query, many), np.repeat(seen, many), np.repeat(child, many) + within
    raise AssertionError("the leaves are the last level")


def spanning_star(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member) of the components of the pairs (i, j)."""
    label = np.arange(n)
    while True:
        was = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == was).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _search(bits: int):
    """Arrow pass over rows (mask, value, fp) sorted by (mask, value)."""

    def found(mask: np.ndarray, value: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
        many = np.bincount(group)[group] > 1
        fps, group = fps[many].view(np.uint64), group[many]
        order = np.lexsort((gray_rank(fps), group))
        fps, group = fps[order], group[order]
        a, b = [], []
        at = 0
        while at < len(fps):  # whole groups, about SEARCH_ROWS rows
            end = min(at + SEARCH_ROWS, len(fps))
            end = int(np.searchsorted(group, group[end - 1], side="right"))
            part = fps[at:end]
            x, y = spanning_star(len(part), *linked_pairs(part, group[at:end], bits))
            a.append(part[x]), b.append(part[y])
            at = end
        join = lambda xs: pa.array(np.concatenate(xs).view(np.int64) if xs else np.empty(0, np.int64))
        return pa.RecordBatch.from_arrays([join(a), join(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([k, batch.column(c).to_numpy(zero_copy_only=False)]) for c, k in enumerate(kept)]
            if not len(rows[0]):
                continue
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = len(last) - int(last.sum())  # the last group may go on in the next batch
            kept = [r[cut:] for r in rows]
            if cut:
                yield found(*(r[:cut] for r in rows))
        if len(kept[0]):
            yield found(*kept)

    return run


def link_edges(nodes: DataFrame, bits: int = BITS, group_max: int = GROUP_MAX) -> DataFrame:
    """Edges (a, b) that connect all ``fp`` within ``bits`` bits; ``nodes`` has each fp once."""
    spark, n_parts = nodes.sparkSession, bits + 1
    signed = lambda mask: [_signed(p) for p in _parts(mask, n_parts)]
    if group_max > GROUP_MAX:
        raise ValueError(f"a search takes at most {GROUP_MAX} fingerprints")
    dealt, edges = nodes.select("fp", F.explode(F.array(*[F.lit(p).cast("long") for p in signed(0)])).alias("mask")), None
    while True:
        dealt = dealt.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
        large = stored(dealt.groupBy("mask", "value").count().filter(F.col("count") > group_max).select("mask", "value"), "large-groups")
        done = large.isEmpty()
        small = dealt if done else dealt.join(large, ["mask", "value"], "left_anti")
        sorted_groups = small.repartition("mask", "value").sortWithinPartitions("mask", "value")
        found = stored(arrow_pass(sorted_groups, _search(bits), "a long, b long").distinct(), "links")
        edges = found if edges is None else edges.unionByName(found)
        if done:
            return edges
        masks = [r["mask"] % (1 << 64) for r in large.select("mask").distinct().collect()]  # 4 ** level at most, whatever the data
        deal = spark.createDataFrame([(_signed(m), signed(m)) for m in masks], "mask long, parts array<long>")
        open_ = stored(dealt.join(large, ["mask", "value"], "left_semi").select("fp", "mask"), "open-groups")
        dealt = open_.join(F.broadcast(deal), "mask").select("fp", F.explode("parts").alias("mask"))  # a row per mask


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, keyed: bool) -> tuple[DataFrame, DataFrame]:
    """The rows' ``fingerprints`` and, for each fingerprint, component_id and (keyed) head: the least (id, key) of its component."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle, keyed), "fingerprints")
    least = {"component_id": F.min("id")} | ({"head": F.min(F.when(F.col("id").isNotNull(), F.struct("id", "key")))} if keyed else {})
    nodes = stored(marked.groupBy("fp").agg(*[c.alias(n) for n, c in least.items()]), "fingerprint-nodes")
    roots = smallest_reachable(link_edges(nodes.select("fp"), bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", *least, F.coalesce("root", "fp").alias("root"))
    heads = stored(rooted.groupBy("root").agg(*[F.min(n).alias(n) for n in least]), "component-ids")
    return marked, rooted.select("fp", "root").join(heads, "root").select("fp", *least)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(id, fp, component_id): each row's fingerprint and the least id that its links reach."""
    marked, named = _components(docs, id_col, text_col, shingle, bits, keyed=False)
    return marked.join(named, "fp").select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of each component: the one of least (id, text key), of rows equal in both any one; rows without an id stay."""
    marked, named = _components(docs, id_col, text_col, shingle, bits, keyed=True)
    gone = marked.filter("id is not null").join(named, "fp").filter(F.struct("id", "key") != F.col("head")).select(F.col("id").alias("_n_id"), F.col("key").alias("_n_key"))
    left = docs.join(gone, (docs[id_col] == gone["_n_id"]) & (_text_key(docs[text_col]) == gone["_n_key"]), "left_anti")
    # whole rows that repeat: met as (id, key) with more than one row, so that texts are grouped only there
    again = stored(marked.filter("id is not null").groupBy("id", "key").count().filter("count > 1").select(F.col("id").alias("_n_id"), F.col("key").alias("_n_key")), "repeated-rows")
    if again.isEmpty():
        return left
    held = left.select(F.struct(*[left[c] for c in docs.columns]).alias("doc"))  # no column of the documents can clash
    same = (held["doc"][id_col] == again["_n_id"]) & (_text_key(held["doc"][text_col]) == again["_n_key"])
    once = held.join(again, same).dropDuplicates(["_n_id", "_n_key"]).select("doc")
    return held.join(again, same, "left_anti").unionByName(once).select("doc.*")
