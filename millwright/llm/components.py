"""Connected components of a large edge list by alternating star contractions.

Each round is two joins and two aggregates on the edges; after each the edges are a
table in the shared scratch folder.  A hub's edges lie on the many side of a join with
a table of one row per node, which AQE splits, and its neighbours are reduced before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs the rows (node, root): root is the least node of its component; roots themselves have no row."""
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _signature(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        wide = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        wide = stored(wide, "edges")
        down = stored(wide.groupBy("a").agg(F.min("b").alias("m")), "least")
        narrow = wide.join(down, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(narrow.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        was, seen = seen, _signature(now)
        if seen == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
