"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

*Targets.*  Sources in code-point order (null last) get weights in turn and share a
percentage of all words; a target stops at ``max_epochs`` times its source's words and
what is above is shared again by weight.

*Blocks.*  The rows of a source are hashed into blocks of about ``block_rows``; block
numbers in order are a random permutation of the source.  A source's draws are all its
blocks once for each whole epoch in its target, then blocks in order until the rest of
the target is met; of the last one only rows that still fit are drawn.

*Splitting tree.*  The draws of each source are exact quotas.  The root holds them all;
a node hands each half of its shards its share of the draws, the sources' parts of the
left half being one multivariate hypergeometric sample.  A leaf is a shard.  A source's
draws, permuted anew in each epoch, are dealt to the shards in runs of these quotas, so
shards are disjoint; inside a shard rows are put in the order of a hash.

Scale: sources are a table, numbered by range.  Water-filling is a few aggregates over it that
bring two sums each to the driver.  Quotas are drawn for groups of ``SOURCES`` sources first (the
driver sees a row per group) and then, inside a task, for the sources of a group: parts of a
multivariate hypergeometric sample are such samples.  Running sums along a source's blocks go over
``STRETCHES`` stretches and then inside each, so a hot source is no single task.  Rows meet the
table of blocks (1/``block_rows`` of the rows) in an equi-join on (source, block).

Defined results: a null or empty text has size 0 and its ``taken`` is 0; null is a
source of its own; rows equal in id and text fall into one block and are drawn alike;
an empty table gives an empty mix.  Reruns agree: every choice hangs on ``seed`` and the row.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import prepare, stored, word_count


#: Sources in a group of the splitting tree, and stretches of a running sum along one source.
SOURCES = 4096
STRETCHES = 4096


@dataclass(frozen=True)
class Mix:
    """Production parameters."""

    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 150
    max_epochs: int = 2
    shards: int = 16
    block_rows: int = 512
    seed: int = 20240


def shared_targets(sizes: list[int], mix: Mix = Mix()) -> list[Fraction]:
    """Target of each source, in the order of ``sizes``: the rule in exact fractions, which ``_with_targets`` follows on a table."""
    weights = [mix.weights[k % len(mix.weights)] for k in range(len(sizes))]
    left, targets, open_ = Fraction(sum(sizes) * mix.percent, 100), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while open_:
        each = left / sum(weights[k] for k in open_)
        above = {k for k in open_ if each * weights[k] > mix.max_epochs * sizes[k]}
        if not above:
            return [each * weights[k] if k in open_ else t for k, t in enumerate(targets)]
        for k in above:
            targets[k] = Fraction(mix.max_epochs * sizes[k])
            left -= targets[k]
        open_ -= above
    return targets


def split_quotas(draws: list[int], shards: int, seed: int, totals: list[int] | None = None) -> np.ndarray:
    """(source, shard) quotas of draws; rows sum to ``draws``.

    Columns sum to ``totals`` where these are given; else shards differ by one draw at most for 2**k shards.
    """
    rng, out = np.random.default_rng(seed), np.zeros((len(draws), shards), np.int64)

    def node(counts: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            out[:, first] = counts
            return
        half = n // 2
        total = int(counts.sum())
        share = total * half // n if totals is None else sum(totals[first : first + half])
        left = rng.multivariate_hypergeometric(counts, share, method="marginals") if total else counts
        node(left, first, half)
        node(counts - left, first + half, n - half)

    if draws:
        node(np.array(draws, np.int64), 0, shards)
    return out


def fill(rows: list[tuple[int, int, int]], room: float) -> list[int]:
    """Of rows (words, hash, copies) the hashes that come nearest to ``room`` words, large ones first."""
    taken, rest = [], []
    for words, h, copies in sorted(rows, key=lambda r: (-r[0] * r[2], r[1])):
        if 0 < words * copies <= room:
            taken.append(h)
            room -= words * copies
        elif words:
            rest.append((words * copies, h))
    if rest and min(rest)[0] - room < room:  # one too many is nearer than one too few
        taken.append(min(rest)[1])
    return taken


def _block(h: Column, n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), h), n_blocks)


def _numbered(found: DataFrame) -> DataFrame:
    """Adds ``s``: the place of each source in code-point order, null last, from 0."""
    null = F.col("source").isNull()
    ranged = found.repartitionByRange(null, F.col("source")).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "mix-sources")
    before = F.sum("count").over(Window.orderBy("part")) - F.col("count")  # a row per partition
    offsets = ranged.groupBy("part").count().select("part", before.alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(null, "source")) - 1
    return ranged.join(offsets, "part").select((F.col("before") + at).alias("s"), "source", "n", "words")


def _with_targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """Adds target, whole epochs and the rest of the target to numbered sources; all sums are of whole numbers.

    The level (words for a weight of one) only rises from step to step, so a source above its
    bound stays above it, and a step needs two sums of those above, not their list.
    """
    exact = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    weights = F.array(*[F.lit(w) for w in mix.weights])
    table = sources.withColumn("weight", F.get(weights, (F.col("s") % len(mix.weights)).cast("int")))
    table = stored(table, "mix-weights")
    wide = {c: F.col(c).cast("decimal(20,0)") for c in ("weight", "words")}
    sums = lambda df: [int(x or 0) for x in df.agg(F.sum(wide["weight"]), F.sum(wide["words"])).first()]
    all_weight, all_words = sums(table)
    above_weight, level, per = 0, mix.percent * all_words, 100 * all_weight  # level / per: words for a weight of one
    while True:
        above = wide["weight"] * exact(level) > wide["words"] * exact(mix.max_epochs * per)
        weight, words = sums(table.filter(above))
        if weight in (above_weight, all_weight):
            break
        above_weight, level, per = weight, mix.percent * all_words - 100 * mix.max_epochs * words, 100 * (all_weight - weight)
    table = table.withColumns({"above": above, "share": wide["weight"] * exact(level), "full": wide["words"] * exact(per)})
    whole = F.when(F.col("words") == 0, F.lit(0)).when(F.col("above"), F.lit(mix.max_epochs)).otherwise(F.expr("share div full"))
    table = table.withColumn("whole", whole.cast("int"))
    target = F.when(F.col("above"), mix.max_epochs * F.col("words").cast("double")).otherwise(F.col("share").cast("double") / per)
    rest = F.when(F.col("above"), F.lit(0.0)).otherwise((F.col("share") - F.col("whole") * F.col("full")).cast("double") / per)
    table = table.withColumns({"target": target, "rest": rest})
    n_blocks = F.ceil(F.col("n") / mix.block_rows)
    return table.select("s", "source", F.col("words").alias("source_size"), "target", "whole", "rest", n_blocks.alias("n_blocks"))


def _running(df: DataFrame, value: Column, keys: list[str], stretch: list[str], order: list[str]) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of ``keys`` ahead of this one by (stretch, order)."""
    df = df.withColumn("value", value)
    along = Window.partitionBy(*keys).orderBy(*stretch)
    parts = df.groupBy(*keys, *stretch).agg(F.sum("value").alias("part"))
    parts = parts.select(*keys, *stretch, (F.sum("part").over(along) - F.col("part")).alias("ahead"))
    inside = F.sum("value").over(Window.partitionBy(*keys, *stretch).orderBy(*order)) - F.col("value")
    return df.join(parts, [*keys, *stretch]).withColumn("before", F.col("ahead") + inside).drop("value", "ahead")


def _runs(blocks: DataFrame, mix: Mix) -> DataFrame:
    """(s, ends): of each source the last draw of each shard, drawn for groups of sources and then inside them."""
    times = F.sum(F.col("whole") + (F.col("full") | F.col("cut")).cast("int"))
    counts = blocks.groupBy("s").agg(times.alias("draws")).filter("draws > 0").withColumn("g", F.floor(F.col("s") / SOURCES))
    counts = stored(counts, "mix-counts")
    groups = counts.groupBy("g").agg(F.sum("draws").alias("draws")).orderBy("g").collect()  # a row per SOURCES sources
    quotas = split_quotas([r["draws"] for r in groups], mix.shards, mix.seed)
    totals = counts.sparkSession.createDataFrame([(r["g"], q.tolist()) for r, q in zip(groups, quotas)], "g long, totals array<long>")
    shards, seed = mix.shards, mix.seed

    def inside(group: pa.Table) -> pa.Table:
        """Quotas of one group's sources, at most ``SOURCES``."""
        group = group.sort_by("s")
        quotas = split_quotas(group["draws"].to_pylist(), shards, seed + group["g"][0].as_py(), group["totals"][0].as_py())
        return pa.table({"s": group["s"], "ends": pa.array(np.cumsum(quotas, axis=1).tolist(), pa.list_(pa.int64()))})

    return stored(counts.join(totals, "g").groupBy("g").applyInArrow(inside, "s long, ends array<long>"), "mix-quotas")


def drawn(docs: DataFrame, carry: list[str], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", mix: Mix = Mix()) -> DataFrame:
    """A row per row of ``docs``: ``doc`` (struct of ``carry``), size, source_size, target and ``draws``.

    ``draws`` has a struct (epoch, shard, place) for each time the row is drawn; rows of a
    shard in the order of ``place`` are the shard's shuffled rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("doc"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        F.xxhash64(F.lit(mix.seed), F.col(id_col), text).alias("h"),
    )
    rows = stored(rows, "mix-rows")

    found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    plan = stored(_with_targets(_numbered(found), mix), "mix-targets")
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop("source")
    rows = rows.withColumn("block", _block(F.col("h"), F.col("n_blocks")))

    blocks = rows.groupBy("s", "block").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("whole", "rest", "n_blocks")])
    blocks = blocks.withColumn("stretch", F.floor(F.col("block") / F.col("n_blocks") * STRETCHES))
    blocks = _running(blocks, F.col("words"), ["s"], ["stretch"], ["block"])
    blocks = blocks.withColumn("room", F.col("rest") - F.col("before")).select(
        "s", "block", "whole", "room", (F.col("room") >= F.col("words")).alias("full"), ((F.col("room") > 0) & (F.col("room") < F.col("words"))).alias("cut")
    )
    blocks = stored(blocks, "mix-blocks")
    last = blocks.filter("cut").select("s", "block", "room")  # one block per source at most
    ends = rows.join(last, ["s", "block"]).groupBy("s", "room", "size", "h").count()

    def picked_of(group: pa.Table) -> pa.Table:
        """The rows of one source's cut block that are taken; a block has about ``block_rows`` different ones."""
        hashes = fill(list(zip(group["size"].to_pylist(), group["h"].to_pylist(), group["count"].to_pylist())), group["room"][0].as_py())
        return pa.table({"s": pa.array([group["s"][0].as_py()] * len(hashes), pa.int64()), "h": pa.array(hashes, pa.int64())})

    picks = ends.groupBy("s").applyInArrow(picked_of, "s long, h long")

    epochs = F.expr("sequence(0, whole + int(full or cut) - 1)")
    draws = blocks.filter("whole > 0 OR full OR cut").select("s", "block", "whole", "cut", F.explode(epochs).alias("epoch"))
    draws = draws.withColumn("lot", F.xxhash64(F.lit(mix.seed), "epoch", "block")).withColumn("stretch", F.shiftright("lot", 64 - STRETCHES.bit_length() + 1))
    draws = _running(draws, F.lit(1), ["s"], ["epoch", "stretch"], ["lot", "block"]).withColumn("at", F.col("before") + 1)
    draws = draws.withColumn("part", F.col("cut") & (F.col("epoch") == F.col("whole")))
    runs = _runs(blocks, mix)
    dealt = draws.join(runs, "s").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("at"))))
    dealt = dealt.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "part"))).alias("dealt"))
    dealt = stored(dealt, "mix-draws")

    picked = stored(picks, "mix-picks").withColumn("picked", F.lit(True))
    rows = rows.join(dealt, ["s", "block"], "left").join(picked, ["s", "h"], "left")
    place = lambda d: F.xxhash64(F.lit(mix.seed + 1), d["epoch"], d["shard"], F.col("h"))
    mine = F.filter(F.coalesce("dealt", F.array().cast("array<struct<epoch:int,shard:int,part:boolean>>")), lambda d: ~d["part"] | F.coalesce("picked", F.lit(False)))
    mine = F.transform(mine, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), place(d).alias("place")))
    return rows.select("doc", "size", "source_size", "target", mine.alias("draws"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", mix: Mix = Mix()) -> DataFrame:
    """The mix: the columns of ``docs``, a row for each draw, by shard and shuffled inside it."""
    out = drawn(docs, docs.columns, id_col, source_col, text_col, mix).select("doc", F.explode("draws").alias("d"))
    return out.sortWithinPartitions("d.shard", "d.place").select("doc.*")


def write_mix(docs: DataFrame, path: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", mix: Mix = Mix()) -> None:
    """A folder ``shard=k`` for each shard under ``path``, rows in the shard's shuffled order."""
    out = drawn(docs, docs.columns, id_col, source_col, text_col, mix).select("doc", F.explode("draws").alias("d"))
    out = out.repartitionByRange(F.col("d.shard"), F.col("d.place")).sortWithinPartitions("d.shard", "d.place")
    out.select("doc.*", F.col("d.shard").alias("shard")).write.partitionBy("shard").parquet(path)
