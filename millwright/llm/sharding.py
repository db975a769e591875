"""Sharding over fixed virtual slots (DataFrame and SQL functions only).

Every record is hashed by its id and text into one of ``slots`` virtual slots, a number that never
changes; rows equal in both, which nothing tells apart, are dealt over the slots one by one, so that no id and no text is hot.  Bytes are summed by slot, and a *slot map* says which shard holds a slot.
Maps are versioned tables: version 1 deals the slots out, largest first, each to the
shard that has least so far (law ``bytes``: shard sizes near equal); ``rebalance`` edits a
map for another number of shards and moves as few bytes as it can.  Records only ever look up their slot.

Scale: the corpus is read once into a narrow table (id, size, checksum); sums by slot are
combined before the shuffle.  The slot map has ``slots`` rows whatever the corpus
has, so dealing it is one small row's work and joining it a broadcast of known size.  Places in a
shard are numbered by slot: a slot's first place is the count of the rows in the shard's
slots before it, so no task sees more than a slot.

Defined results: a null text has 0 bytes (size 1, checksum 0); a null id is hashed like any other; rows that repeat an id
go where their texts lead, whole rows that repeat are spread, all with places of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import prepare, stored

SLOTS = 4096
SHARDS = 16


def slot_of(key: Column, copy: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record: by the hash of its id and text, and by a number of its own (0: it has no equals)."""
    return F.pmod(F.xxhash64(key, copy), F.lit(slots)).cast("int")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, vslot) of every row, from one read of the texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(F.col(id_col), text).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    narrow = stored(narrow, "shard-rows")
    repeated = narrow.groupBy("key").count().filter("count > 1").select("key", F.lit(True).alias("repeated"))
    copy = F.when(F.col("repeated"), F.col("row") + 1).otherwise(F.lit(0).cast("long"))
    marked = narrow.join(repeated, "key", "left").select("id", "size", "text_crc32", slot_of(F.col("key"), copy, slots).alias("vslot"))
    return stored(marked, "shard-records")


def slot_sizes(records: DataFrame) -> DataFrame:
    """(vslot, bytes, n): at most a row per slot."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def _least(loads: Column) -> Column:
    """Index of the first shard with the least load."""
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def _loaded(loads: Column, shard: Column, more: Column) -> Column:
    return F.transform(loads, lambda x, i: F.when(i == shard, x + more).otherwise(x))


def _dealt(loads: Column, slots: Column) -> Column:
    """Structs (vslot, shard): slots, an array of (bytes, vslot) in order, each to the least loaded shard."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("out"))

    def put(a: Column, s: Column) -> Column:
        shard = _least(a["loads"])
        return F.struct(_loaded(a["loads"], shard, s["bytes"]).alias("loads"), F.concat(a["out"], F.array(F.struct(s["vslot"].alias("vslot"), shard.alias("shard")))).alias("out"))

    return F.aggregate(slots, start, put, lambda a: a["out"])


def _with_version(rows: DataFrame, version: int) -> DataFrame:
    return rows.select(F.lit(version).alias("version"), "vslot", "shard", "bytes", "n")


def slot_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1: (version, vslot, shard, bytes, n)."""
    largest_first = F.sort_array(F.collect_list(F.struct("bytes", "vslot")), asc=False)  # at most SLOTS structs
    dealt = sizes.agg(largest_first.alias("slots")).select(F.inline(_dealt(F.array_repeat(F.lit(0).cast("long"), shards), F.col("slots"))))
    return stored(_with_version(dealt.join(sizes, "vslot"), 1), "slot-map")


def rebalance(old: DataFrame, shards: int, version: int) -> DataFrame:
    """The map edited for ``shards`` shards; slots move only where they have to.

    A shard keeps its slots, largest first, while they fit into an equal share; the others
    (all slots of a shard that is gone among them) are dealt to the least loaded shards.
    """
    share = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    own = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    stays = (F.col("shard") < shards) & (F.sum("bytes").over(own) <= share)
    marked = old.withColumn("stays", stays)  # the map has SLOTS rows at most
    loads = F.array(*[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)).cast("long") for k in range(shards)])
    moving = F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "vslot"))), asc=False)
    dealt = marked.agg(loads.alias("loads"), moving.alias("slots")).select(F.inline(_dealt(F.col("loads"), F.col("slots"))))
    dealt = dealt.select("vslot", F.col("shard").alias("moved_to"))
    new = marked.join(dealt, "vslot", "left").select("vslot", F.coalesce("moved_to", "shard").alias("shard"), "bytes", "n")
    return stored(_with_version(new, version), "slot-map")


def placed(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """``records`` with their shard and their place in it, gapless from 0."""
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("n")
    firsts = mapping.select("vslot", "shard", before.alias("first"))
    in_slot = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "text_crc32", "size"))
    numbered = records.withColumn("at", in_slot)
    joined = numbered.join(F.broadcast(firsts), "vslot")  # SLOTS rows at most
    return joined.select("id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("place"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, vslot, shard, place) of every row by version 1 of the slot map."""
    prepare(docs.sparkSession)
    records = measured(docs, id_col, text_col, slots)
    return placed(records, slot_map(slot_sizes(records), shards))
