r"""Line dedup over levelled sorted runs of line hashes.

The line index is a set of *runs*: tables of (k1, k2, n_docs, keeper), one row per line key, bucketed and sorted by key,
in one shared folder.  A batch of documents is reduced to one row per key, merge-anti-joined with every run (what is left
is new: ``fresh``), and added as a run of level 0 of its own; keys that the runs know are in it as counts.  When a level holds
``fanout`` runs they are merged, two by two, into one run of the next level (counts summed, greatest keeper).

All runs have the same buckets, one file each, so a join of runs reads bucket by bucket in key order: no exchange and no sort
stands above a run.  The rows of a batch are exchanged once, by the aggregate that reduces them.  Runs are never united before
an aggregate (they meet in joins alone).

A manifest in the folder names the runs of each level; a new one is written for each batch under the next number, and writing a
number that exists fails.  ``LineRuns.open`` reads the newest, so a batch of a later session meets the runs of earlier ones, and of
two writers that began from the same state the second is refused.  A write that broke off leaves tables that no manifest names.

A key found in at least ``min_docs`` documents loses all its lines except in its
keeper, the greatest id that holds it.

Scale: a document counts a key once, inside the row; rows of a key are combined before
they are shuffled, so a line that stands in a third of all documents costs one row per
task.  Where lines are matched with the verdicts, a hot key is on the many side of a
join whose other side has one row per key, which AQE splits.  Keys are 128 bits wide.

Defined results: a null or empty text is one empty line and stays as it is; a null id is
a document like any other but never the keeper (if no holder has an id, nothing goes);
rows that repeat an id count as documents of their own, and all rows of the greatest id
keep their lines.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import SPACE_CHARS, let, lower_ascii, prepare, stored, text_or_empty
from millwright.session import scratch_path


def line_key(line: Column) -> Column:
    """What two equal lines have in common: stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE_CHARS)))


def _hashed(key: Column) -> list[Column]:
    """A 128-bit key: two XXH64 of different seeds (a chained hash is seeded with what came before)."""
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7), key).alias("k2")]


class LineRuns:
    """The levelled runs of one folder; the driver keeps the names of the runs by level."""

    MANIFEST = "levels array<array<string>>, buckets int, fanout int, keeper string"

    def __init__(self, spark: SparkSession, folder: str, keeper: str, buckets: int | None = None, fanout: int = 4):
        """No runs yet.  ``keeper``: SQL type of the ids; ``buckets`` of a run: the session's shuffle partitions unless given."""
        prepare(spark)
        # a bucket of one file is known to be sorted
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.spark, self.folder, self.keeper, self.fanout = spark, folder.rstrip("/"), keeper, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.levels = 0, []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The runs that the newest manifest of ``folder`` names."""
        try:
            rows = spark.read.schema(cls.MANIFEST).option("recursiveFileLookup", "true").parquet(f"{folder.rstrip('/')}/manifest")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                raise ValueError(f"no line runs in {folder}") from e
            raise
        number = F.element_at(F.split("_metadata.file_path", "/"), -2).cast("long").alias("number")
        newest = rows.select(number, "*").orderBy(F.desc("number")).first()
        runs = cls(spark, folder, newest["keeper"], newest["buckets"], newest["fanout"])
        runs.version, runs.levels = newest["number"], [list(level) for level in newest["levels"]]
        return runs

    def _commit(self) -> None:
        row = self.spark.createDataFrame([(self.levels, self.buckets, self.fanout, self.keeper)], self.MANIFEST).coalesce(1)
        row.write.mode("errorifexists").parquet(f"{self.folder}/manifest/{self.version + 1:012d}")
        self.version += 1

    def sorted_table(self, rows: DataFrame, name: str) -> str:
        """Write ``rows`` by bucket, sorted by key; the tasks of ``rows`` must hold whole buckets.  Returns the path."""
        path, table = f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}", f"millwright_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", path).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the catalog's entry; the files of a table with a path stay
        return path

    def read(self, path: str, columns: str | None = None) -> DataFrame:
        """A sorted table, by what the folder says of it alone."""
        table = f"millwright_{uuid.uuid4().hex}"
        columns = columns or f"k1 bigint, k2 bigint, n_docs bigint, keeper {self.keeper}, fresh boolean"
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        found = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return found

    def runs(self) -> list[DataFrame]:
        return [self.read(path) for level in self.levels for path in level]

    def known(self) -> DataFrame | None:
        """Keys of all runs; a key is fresh in the run that saw it first, so each comes once."""
        fresh = [r.filter("fresh").select("k1", "k2") for r in self.runs()]
        # a plain table: see the module's text on unions
        return stored(reduce(DataFrame.unionByName, fresh), "line-keys") if fresh else None

    def add(self, batch: DataFrame) -> None:
        """Add a batch, one row per key: (k1, k2, n_docs, keeper)."""
        self.add_sorted(batch.repartition(self.buckets, "k1", "k2"))

    def add_sorted(self, batch: DataFrame) -> None:
        """The same for rows that are parted like the buckets."""
        new = batch.select("k1", "k2")
        for run in self.runs():
            new = new.join(run.select("k1", "k2").hint("merge"), ["k1", "k2"], "left_anti")
        marked = batch.join(new.withColumn("fresh", F.lit(True)).hint("merge"), ["k1", "k2"], "left")
        marked = marked.select("k1", "k2", "n_docs", "keeper", F.coalesce("fresh", F.lit(False)).alias("fresh"))
        self._put(0, self.sorted_table(marked, "run-l0"))
        self._commit()

    def _put(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merging, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(merging, f"run-l{level + 1}"))

    def _merged(self, paths: list[str], name: str) -> str:
        """One run of several, merged two by two."""
        while len(paths) > 1:
            paths = [self.sorted_table(self._pair(*paths[i : i + 2]), name) if i + 1 < len(paths) else paths[i] for i in range(0, len(paths), 2)]
        return paths[0]

    def _pair(self, left: str, right: str) -> DataFrame:
        a, b = self.read(left), self.read(right).hint("merge")
        both = a.join(b, (a["k1"] == b["k1"]) & (a["k2"] == b["k2"]), "full")
        one = lambda c: F.coalesce(a[c], b[c]).alias(c)
        n_docs = (F.coalesce(a["n_docs"], F.lit(0)) + F.coalesce(b["n_docs"], F.lit(0))).alias("n_docs")
        fresh = (F.coalesce(a["fresh"], F.lit(False)) | F.coalesce(b["fresh"], F.lit(False))).alias("fresh")
        return both.select(one("k1"), one("k2"), n_docs, F.greatest(a["keeper"], b["keeper"]).alias("keeper"), fresh)

    def verdicts(self, min_docs: int) -> DataFrame | None:
        """Keys that lose lines, with their keeper."""
        paths = [path for level in self.levels for path in level]
        if not paths:
            return None
        merged = self.read(self._merged(paths, "all"))
        return merged.filter((F.col("n_docs") >= min_docs) & F.col("keeper").isNotNull()).select("k1", "k2", "keeper")


def _lines(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def batch_keys(docs: DataFrame, min_chars: int, batches: int = 1) -> DataFrame:
    """One row per key, with columns ``n_docs_<b>`` (documents that hold it) and ``keeper_<b>`` (greatest id) for each batch b."""
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars))
    held = docs.select("id", F.pmod(F.xxhash64("id"), F.lit(batches)).alias("batch"), F.explode(keys).alias("key"))
    held = held.select("id", "batch", *_hashed(F.col("key")))
    mine = [F.col("batch") == b for b in range(batches)]
    counts = [F.count(F.when(m, 1)).alias(f"n_docs_{b}") for b, m in enumerate(mine)]
    return held.groupBy("k1", "k2").agg(*counts, *[F.max(F.when(m, F.col("id"))).alias(f"keeper_{b}") for b, m in enumerate(mine)])


def one_batch(keys: DataFrame, b: int) -> DataFrame:
    """The rows of a batch of ``batch_keys``, as ``LineRuns.add`` takes them."""
    return keys.filter(F.col(f"n_docs_{b}") > 0).select("k1", "k2", F.col(f"n_docs_{b}").alias("n_docs"), F.col(f"keeper_{b}").alias("keeper"))


def line_runs(docs: DataFrame, min_chars: int = 40, batches: int = 4, fanout: int = 4, folder: str | None = None) -> LineRuns:
    """The runs over all ``docs`` (id, text), added batch by batch.

    One pass over the texts reduces all batches at once into one sorted table.  ``folder`` (a new one in the shared scratch folder
    unless given) is where the runs stay.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, folder or scratch_path(spark, "line-runs"), docs.schema["id"].dataType.simpleString(), fanout=fanout)
    keys = batch_keys(docs, min_chars, batches)
    path = runs.sorted_table(keys.repartition(runs.buckets, "k1", "k2"), "batches")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
    for b in range(batches):
        runs.add_sorted(one_batch(runs.read(path, columns), b))
    return runs


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 4) -> DataFrame:
    """A row per row of ``docs``: ``doc``, a struct of its columns with the repeated lines removed from the text, and
    ``lines``, a struct of n_lines and n_dropped.
    """
    text = F.col(text_col).cast("string")
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    flat = whole.select("id", "text")
    # a table of its own: AQE splits a hot key only where both sides of the join are plain exchanges
    verdicts = stored(line_runs(flat, min_chars, batches, fanout).verdicts(min_docs), "line-verdicts")
    long_lines = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("at"))), lambda x: F.length(x["key"]) >= min_chars)
    found = flat.select("id", F.xxhash64("text").alias("th"), F.explode(long_lines).alias("x")).select("id", "th", "x.at", *_hashed(F.col("x.key")))
    gone = found.join(verdicts, ["k1", "k2"]).filter(F.col("id").isNull() | (F.col("id") != F.col("keeper")))
    gone = gone.groupBy(F.col("id").alias("g_id"), F.col("th").alias("g_th")).agg(F.collect_set("at").alias("gone"))
    joined = whole.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & F.col("th").eqNullSafe(F.col("g_th")), "left")
    n_lines = F.size(_lines(F.col("text"))).cast("long")
    n_gone = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    left = let(_lines(F.col("text")), lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("gone")), lambda i: F.get(a, i)), "\n"))
    kept = F.when(n_gone == 0, F.col("text")).otherwise(left)
    doc = F.struct(*[(kept if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])
    return joined.select(doc.alias("doc"), F.struct(n_lines.alias("n_lines"), n_gone.alias("n_dropped")).alias("lines"))
