"""A keyed Parquet table with upserts: change sets that are only ever added, and versions that name them.

An upsert writes a folder of changes and then a version: a one-row table that names the folders which count.  A version's name is
its number, and writing one that exists fails, so of two writers that started from the same version the later one is told to
start anew, and a write that broke off left a folder that no version names.  A reader takes the folders of the newest whole version and
nothing else.  ``compact`` writes the latest row of each key as one folder and a version that names only that.

Every step is a Spark job over keyed rows; the driver sees folder names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """Rows of ``schema`` under ``path`` (a folder that driver and executors share), the latest one by ``order`` for each ``key``.

    Rows with a null key are kept like any other key; of rows equal in key and order the one with the greatest values counts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: str):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order

    def _version_path(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}"

    def _versions(self) -> DataFrame | None:
        """(number, folders) of the whole versions: a version is one file, there or not."""
        try:
            rows = self.spark.read.schema("folders array<string>").option("recursiveFileLookup", "true").parquet(f"{self.path}/versions")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.select(F.element_at(F.split("_metadata.file_path", "/"), -2).cast("long").alias("number"), "folders")

    def version(self) -> int:
        """The newest version; 0: the store is empty."""
        found = self._versions()
        return 0 if found is None else found.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]

    def folders(self, number: int) -> list[str]:
        """Folders that a version names."""
        return list(self.spark.read.schema("folders array<string>").parquet(self._version_path(number)).first()["folders"]) if number else []

    def _commit(self, seen: int, folders: list[str]) -> int:
        row = self.spark.createDataFrame([(folders,)], "folders array<string>").coalesce(1)
        row.write.mode("errorifexists").parquet(self._version_path(seen + 1))
        return seen + 1

    def _written(self, rows: DataFrame) -> str:
        name = f"{self.path}/changes/{uuid.uuid4().hex}"
        rows.write.parquet(name)
        return name

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row for each key, by an aggregate that is combined before the shuffle."""
        rest = [c for c in rows.columns if c not in (*self.key, self.order)]
        newest = F.max(F.struct(self.order, *rest)).alias("_newest")
        return rows.groupBy(*self.key).agg(newest).select(*[F.col(k) if k in self.key else F.col("_newest")[k].alias(k) for k in rows.columns])

    def _rows(self, number: int) -> DataFrame:
        folders = self.folders(number)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, seen: int | None = None) -> int:
        """Add ``rows`` (columns of the schema) as a new version and return its number; ``seen``: the version that it must follow."""
        seen = self.version() if seen is None else seen
        columns = self.spark.createDataFrame([], self.schema).columns
        return self._commit(seen, [*self.folders(seen), self._written(self._latest(rows.select(*columns)))])

    def read(self, number: int | None = None) -> DataFrame:
        """The latest row of each key, as of a version."""
        return self._latest(self._rows(self.version() if number is None else number))

    def listing(self) -> DataFrame:
        """All rows ever saved, newest first by ``order``, with whether they are the latest of their key."""
        rows = self._rows(self.version())
        latest = self.read().select(*self.key, F.col(self.order).alias("_newest"))
        same = [rows[k].eqNullSafe(latest[k]) for k in self.key]
        joined = rows.join(latest, same)
        return joined.select(*[rows[c] for c in rows.columns], (rows[self.order] == F.col("_newest")).alias("is_latest")).orderBy(F.desc(self.order), *[rows[k] for k in self.key])

    def compact(self) -> int:
        """A version with one folder that has the latest row of each key."""
        seen = self.version()
        return self._commit(seen, [self._written(self.read(seen))]) if seen else 0
