"""DBSCAN of two standardised columns, exact, by a grid.

*Cells* have the side eps / sqrt(2), so any two points of one cell are neighbours: a cell with ``min_points`` or more points is all core
points.  Only points of sparser cells (fewer than ``min_points`` of them in a cell) count neighbours, in the 21 cells that can hold some.

*Hot cells.*  Equal points are one row with a weight from the start.  What is left of a cell is cut into parts of about
``PART_POINTS`` points by a hash; the few points that ask (at most ``min_points`` - 1 from each of 20 cells) go to all its parts.  So
a cell with a third of all points is many small joins, and a point takes part in at most 20 * (``min_points`` - 1) comparisons.

*Clusters* are connected components of core cells, with an edge where two of their core points are neighbours.  Whether two cells have such
a pair is decided by boxes: the tight boxes of the points in halves, quarters and so on of both cells.  Boxes so close that their
corners are neighbours decide it, boxes too far apart drop out, only what lies between is cut further; a box of a single point is
exact.  No pairs of points of two dense cells are formed.

Rows with a null or non-finite value in either column take no part (as rows with a gap do not in the data-quality check).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.components import component_of
from millwright.operators.ml.cluster import standardize
from millwright.session import ensure_checkpoint_dir, scratch_path

# The check's distance and neighbourhood, and the rows that it needs.
EPS, MIN_POINTS, LEAST_ROWS = 0.8, 5, 20
PART_POINTS = 1 << 14
#: Cells around one that may hold neighbours of its points: all within two steps but the corners.
AROUND = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) < 4]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _square(x: Column) -> Column:
    return x * x


def _near(ax: Column, ay: Column, bx: Column, by: Column, eps: float) -> Column:
    return _square(ax - bx) + _square(ay - by) <= F.lit(eps * eps)


def points_of(df: DataFrame, x: str, y: str, eps: float) -> DataFrame:
    """(x, y, w, cx, cy): distinct standardised points with their number of rows and their cell."""
    num = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    num = num.where(F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False)))
    distinct = standardize(num, ["x", "y"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    side = eps / math.sqrt(2.0)
    return distinct.select("x", "y", "w", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))


def label(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """``points`` with ``dense`` (of its cell) and ``kind``: core, border or noise."""
    cells = points.groupBy("cx", "cy").agg(F.sum("w").alias("cell_w"), F.count(F.lit(1)).alias("cell_n"))
    cells = _written(cells.withColumn("parts", F.ceil(F.col("cell_n") / PART_POINTS).cast("int")), "dbscan-cells")
    dense_cell = F.col("cell_w") >= min_points
    marked = _written(points.join(cells.select("cx", "cy", dense_cell.alias("dense"), "parts"), ["cx", "cy"]), "dbscan-points")
    # asking: points of sparse cells, once for each cell around, and once for each of its parts
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in AROUND]))
    asking = marked.where(~F.col("dense")).select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("cx").alias("qcx"), F.col("cy").alias("qcy"), around.alias("s"))
    asking = asking.select("qx", "qy", (F.col("qcx") + F.col("s.a")).alias("cx"), (F.col("qcy") + F.col("s.b")).alias("cy"))
    asking = asking.join(cells.select("cx", "cy", "parts"), ["cx", "cy"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = marked.select("x", "y", "w", "cx", "cy", "dense", F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int").alias("part"))
    pairs = asking.join(dealt, ["cx", "cy", "part"]).where(_near(F.col("qx"), F.col("qy"), F.col("x"), F.col("y"), eps))
    # of neighbours in dense cells only the number counts, they are core; those in sparse cells are few and kept
    seen = pairs.groupBy("qx", "qy").agg(
        F.sum("w").alias("n"), F.max("dense").alias("by_dense"),
        F.collect_list(F.when(~F.col("dense"), F.struct("x", "y"))).alias("sparse"),  # at most 21 * (min_points - 1)
    )
    seen = _written(seen.withColumn("core", F.col("n") >= min_points), "dbscan-sparse")
    cores = seen.where("core").select(F.col("qx").alias("x"), F.col("qy").alias("y"))
    others = seen.where(~F.col("core"))
    by_sparse = others.select("qx", "qy", F.explode("sparse").alias("p")).select("qx", "qy", "p.x", "p.y").join(cores, ["x", "y"], "left_semi").select("qx", "qy").distinct()
    border = others.join(by_sparse.withColumn("hit", F.lit(True)), ["qx", "qy"], "left")
    border = border.select(F.col("qx").alias("x"), F.col("qy").alias("y"), F.when(F.col("by_dense") | F.col("hit"), "border").otherwise("noise").alias("kind"))
    kinds = border.unionByName(cores.withColumn("kind", F.lit("core")))
    sparse = marked.where(~F.col("dense")).join(kinds, ["x", "y"])
    columns = ["x", "y", "w", "cx", "cy", "dense", "kind"]
    return _written(marked.where("dense").withColumn("kind", F.lit("core")).select(*columns).unionByName(sparse.select(*columns)), "dbscan-labelled")


def _boxes(core: DataFrame, side: float, level: int) -> DataFrame:
    """(cx, cy, sx, sy, box): tight boxes of the core points in the parts of a cell, 2**level to a side."""
    scale = (1 << level) / side
    part = lambda v, c: F.floor((F.col(v) - F.col(c) * side) * scale)
    box = F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return core.groupBy("cx", "cy", part("x", "cx").alias("sx"), part("y", "cy").alias("sy")).agg(box.alias("box"))


def _least(a: Column, b: Column) -> Column:
    """Square of the least distance of two boxes; of points in them exactly the distance where both are points."""
    gap = lambda lo, hi: F.greatest(F.lit(0.0), b[lo] - a[hi], a[lo] - b[hi])
    return _square(gap("x0", "x1")) + _square(gap("y0", "y1"))


def _most(a: Column, b: Column) -> Column:
    far = lambda lo, hi: F.greatest(F.abs(b[hi] - a[lo]), F.abs(a[hi] - b[lo]))
    return _square(far("x0", "x1")) + _square(far("y0", "y1"))


def cell_edges(labelled: DataFrame, eps: float) -> DataFrame:
    """(u, v): names "cx,cy" of core cells that have two core points within eps of each other."""
    side, limit = eps / math.sqrt(2.0), F.lit(eps * eps)
    core = _written(labelled.where(F.col("kind") == "core").select("cx", "cy", "x", "y"), "dbscan-core")
    # level 0: each pair of cells once, by the half of the cells around that come later
    ahead = [(a, b) for a, b in AROUND if (a, b) > (0, 0)]
    boxes = _written(_boxes(core, side, 0).select("cx", "cy", "box"), "dbscan-boxes")
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ahead]))
    left = boxes.select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("box").alias("p"), step.alias("s"))
    left = left.select("ax", "ay", "p", (F.col("ax") + F.col("s.a")).alias("bx"), (F.col("ay") + F.col("s.b")).alias("by"))
    right = boxes.select(F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("box").alias("q"))
    zero = F.lit(0).cast("bigint")
    pairs = left.join(right, ["bx", "by"]).select("ax", "ay", "bx", "by", *[zero.alias(c) for c in ("asx", "asy", "bsx", "bsy")], "p", "q")
    linked, level, cells = [], 0, ["ax", "ay", "bx", "by"]
    while True:
        one = (F.col("p.x0") == F.col("p.x1")) & (F.col("p.y0") == F.col("p.y1")) & (F.col("q.x0") == F.col("q.x1")) & (F.col("q.y0") == F.col("q.y1"))
        judged = pairs.where(_least(F.col("p"), F.col("q")) <= limit).withColumn("sure", (_most(F.col("p"), F.col("q")) <= limit) | one)
        judged = _written(judged, "dbscan-pairs")
        sure = judged.where("sure").select(*cells).distinct()
        linked.append(sure)
        open_ = judged.where(~F.col("sure")).join(sure, cells, "left_anti")
        if open_.isEmpty():
            break
        level += 1
        finer = _written(_boxes(core.join(_named(open_).distinct(), ["cx", "cy"], "left_semi"), side, level), "dbscan-boxes")
        for mine, box in (("a", "p"), ("b", "q")):  # a part's boxes are those of its four quarters
            fine = finer.select(F.col("cx").alias(f"{mine}x"), F.col("cy").alias(f"{mine}y"), F.shiftright("sx", 1).alias(f"{mine}sx"), F.shiftright("sy", 1).alias(f"{mine}sy"),
                                F.col("sx").alias("fx"), F.col("sy").alias("fy"), F.col("box").alias("fine"))
            open_ = open_.join(fine, [f"{mine}x", f"{mine}y", f"{mine}sx", f"{mine}sy"]).withColumns({f"{mine}sx": F.col("fx"), f"{mine}sy": F.col("fy"), box: F.col("fine")}).drop("fx", "fy", "fine")
        pairs = open_.drop("sure")
    name = lambda c: F.concat_ws(",", f"{c}x", f"{c}y")
    out = linked[0]
    for more in linked[1:]:
        out = out.unionByName(more)
    return out.select(name("a").alias("u"), name("b").alias("v")).distinct()


def _named(pairs: DataFrame) -> DataFrame:
    """(cx, cy) of both sides of cell pairs."""
    side = lambda c: pairs.select(F.col(f"{c}x").alias("cx"), F.col(f"{c}y").alias("cy"))
    return side("a").unionByName(side("b"))


def dbscan(df: DataFrame, x: str, y: str, eps: float = EPS, min_points: int = MIN_POINTS) -> tuple[DataFrame, DataFrame]:
    """V8: (labelled distinct points, cells with their cluster): ``x``, ``y``, ``w``, ``cx``, ``cy``, ``dense``, ``kind``;
    ``cell`` ("cx,cy"), ``cluster`` (name of the cluster's least cell) of every cell with core points."""
    ensure_checkpoint_dir(df.sparkSession)
    labelled = label(_written(points_of(df, x, y, eps), "dbscan-distinct"), eps, min_points)
    cells = labelled.where(F.col("kind") == "core").select(F.concat_ws(",", "cx", "cy").alias("cell")).distinct()
    roots = component_of(cell_edges(labelled, eps))
    clusters = cells.join(roots, cells["cell"] == roots["node"], "left").select("cell", F.coalesce("root", "cell").alias("cluster"))
    return labelled, clusters


def counts(labelled: DataFrame) -> DataFrame:
    """One row: rows and rows by kind."""
    rows = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("w"))), F.lit(0)).alias(f"{kind}_points")
    return labelled.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("rows"), rows("core"), rows("border"), rows("noise"))


def summary(df: DataFrame, x: str, y: str, eps: float = EPS, min_points: int = MIN_POINTS) -> DataFrame:
    """One row: rows, core_points, border_points, noise_points, clusters and ok (enough rows; else the counts are null)."""
    labelled, clusters = dbscan(df, x, y, eps, min_points)
    found = counts(labelled).crossJoin(clusters.agg(F.count_distinct("cluster").alias("clusters")))  # one row each
    ok = F.col("rows") >= LEAST_ROWS
    return found.select("rows", *[F.when(ok, F.col(c)).alias(c) for c in ("core_points", "border_points", "noise_points", "clusters")], ok.alias("ok"))
