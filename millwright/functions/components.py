"""Connected components of an edge table, by alternating large and small stars (Kiveris et al. 2014).

A large star links each node's greater neighbours to its least neighbour, a small star its smaller ones and itself.
Both are one aggregate and one explode; a node's neighbours are never gathered.  The rounds end when the edges stay the same;
their number grows with the logarithm of the longest chain.  Every round is a table in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.session import ensure_checkpoint_dir, scratch_path


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "components")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _checksum(edges: DataFrame) -> tuple:
    """Count and sum of hashes: the same for the same set of edges."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """(u, v) with v < u: every neighbour greater than u goes to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """(u, v) with v < u: u and its smaller neighbours go to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def component_of(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): the least node of its component for every node of an edge that is not the root itself."""
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col("u") != F.col("v")).distinct()
    pairs = _written(pairs)
    before = _checksum(pairs)
    while True:
        pairs = _written(_small_star(_large_star(pairs)))
        after = _checksum(pairs)
        if after == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
