"""Data-quality report checks on a plant frame.

Each check is one or two aggregates over the frame (no per-column jobs):
column statistics come from a single wide aggregate, hits from a second one.
Row-order checks deal the rows by range of (machine, time order), use ``lag`` inside
each range and stitch its first row to the last row of the range before it, so one
busy machine, day or shift never lands in a single task.
"""

from __future__ import annotations

from functools import reduce
from typing import Optional

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.quantiles import exact_quantiles
from millwright.functions.resolve import find_col
from millwright.session import scratch_path

NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)
# Fixed values from the reference: thresholds and name tokens.
MISSING_FAIL, MISSING_WARN = 0.20, 0.05
ZERO_WARN = 0.30
Z_LIMIT, IQR_K, JUMP_K = 3.0, 1.5, 5.0
JUMP_TOKENS = ("rate", "count", "minutes", "scrap", "oee", "speed", "output")
RANGE_RULES = [("availability", 0.0, 1.5), ("performance", 0.0, 1.5), ("quality", 0.0, 1.5), ("oee", 0.0, 1.5),
               ("scrap_rate", 0.0, 1.0), ("ideal_rate", 0.0, None)]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _long(one_row: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Wide one-row result -> (column_name, value) rows."""
    return one_row.unpivot([], cols, "column_name", name)


def missing(df: DataFrame) -> DataFrame:
    """V1: share of NULL cells; FAIL > 20 %, WARN > 5 %."""
    cols = df.columns
    g = df.agg(F.count(F.lit(1)).alias("rows"),
               *[F.count(F.when(_q(c).isNull(), 1)).alias(f"_m{i}") for i, c in enumerate(cols)])
    miss = reduce(lambda a, b: a + b, [F.col(f"_m{i}") for i in range(len(cols))])
    cells = F.col("rows") * len(cols)
    pct = F.when(cells > 0, miss / cells).otherwise(0.0)
    status = F.when(pct > MISSING_FAIL, "FAIL").when(pct > MISSING_WARN, "WARN").otherwise("PASS")
    return g.select("rows", F.lit(len(cols)).alias("cols"), miss.alias("missing_cells"), pct.alias("missing_pct"),
                    status.alias("status"))


def constant(df: DataFrame) -> DataFrame:
    """V2: columns with at most one distinct non-null value (min <=> max, cheaper than distinct)."""
    cols = df.columns
    g = df.agg(*[((F.count(_q(c)) == 0) | (F.min(_q(c)) == F.max(_q(c)))).alias(c) for c in cols])
    return _long(g, cols, "is_constant")


def zeros(df: DataFrame) -> DataFrame:
    """V3: share of zero cells among numeric cells; WARN > 30 %."""
    nums = numeric_columns(df)
    g = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(_q(c) == 0, 1)).alias(f"_z{i}") for i, c in enumerate(nums)])
    z = reduce(lambda a, b: a + b, [F.col(f"_z{i}") for i in range(len(nums))], F.lit(0).cast("bigint"))
    cells = F.col("rows") * len(nums)
    pct = F.when(cells > 0, z / cells).otherwise(0.0)
    return g.select(z.alias("zero_cells"), cells.alias("numeric_cells"), pct.alias("zero_pct"),
                    F.when(pct > ZERO_WARN, "WARN").otherwise("PASS").alias("status"))


def duplicates(df: DataFrame) -> DataFrame:
    """V4: number of rows that repeat an earlier identical row."""
    g = df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    d = g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("dup_rows"))
    return d.select("dup_rows", F.when(F.col("dup_rows") > 0, "WARN").otherwise("PASS").alias("status"))


def zscore(df: DataFrame, cols: Optional[list[str]] = None) -> DataFrame:
    """V5: per numeric column, values with |x - mean| / (sd + 1e-9) > 3 (sample sd, >= 5 values)."""
    cols = cols or numeric_columns(df)
    st = df.select(F.struct(*[F.struct(F.avg(_q(c)).alias("m"), F.stddev_samp(_q(c)).alias("s"),
                                       F.count(_q(c)).alias("n")).alias(f"c{i}") for i, c in enumerate(cols)])).scalar()
    parts = []
    for i, c in enumerate(cols):
        s = st.getField(f"c{i}")
        z = F.abs((_q(c).cast("double") - s.getField("m")) / (s.getField("s") + F.lit(1e-9)))
        parts.append(F.struct(F.lit(c).alias("column_name"), s.getField("n").alias("n"),
                              F.when(s.getField("n") >= 5, F.count(F.when(z > Z_LIMIT, 1))).otherwise(F.lit(0)).cast("bigint").alias("hits")))
    g = df.agg(F.array(*parts).alias("a"))
    return g.select(F.explode("a").alias("r")).select("r.*")


def iqr(df: DataFrame, cols: Optional[list[str]] = None, quartiles: Optional[dict[str, list]] = None) -> DataFrame:
    """V6: values outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR] per column; skipped when IQR = 0.

    Quartiles are exact (linear interpolation) via distributed selection, unless given.
    """
    cols = cols or numeric_columns(df)
    qs = quartiles or exact_quantiles(df, {c: _q(c) for c in cols}, [0.25, 0.75])
    parts = []
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            hits = F.lit(0).cast("bigint")
        else:
            rng = q3 - q1
            lo, hi = q1 - IQR_K * rng, q3 + IQR_K * rng
            x = _q(c).cast("double")
            hits = F.count(F.when((x < lo) | (x > hi), 1)) if rng else F.lit(0).cast("bigint")
        parts.append(F.struct(F.lit(c).alias("column_name"), F.lit(q1).cast("double").alias("q1"),
                              F.lit(q3).cast("double").alias("q3"), hits.cast("bigint").alias("hits")))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def _ranged(df: DataFrame, keys: list[str], partitions: Optional[int] = None) -> tuple[DataFrame, WindowSpec, tuple[Column, Column]]:
    """Rows dealt by range of ``keys`` with the range's number ``_p``; the window of a range; whether a row is its first, its last.

    A range holds about as many rows as any other, however often one machine or day occurs,
    as long as ``keys`` tell rows apart.
    """
    rows = df.repartitionByRange(*([partitions] if partitions else []), *keys).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(*keys)
    return rows, w, (F.lag(F.lit(True)).over(w).isNull(), F.lead(F.lit(True)).over(w).isNull())


def lag_stitched(df: DataFrame, part: str, blocks: str | list[str], order: list[str], cols: list[str], partitions: Optional[int] = None) -> DataFrame:
    """Adds ``_prev_<c>``: the value of ``c`` in the previous row of ``part`` ordered by (*blocks, *order).

    Rows are dealt by range of (part, *blocks, *order) and written once; windows run per
    range, and the first row of a range takes the last row of the range before it from a
    table of one row per range.
    """
    keys = [part, *([blocks] if isinstance(blocks, str) else blocks), *order]
    ranged, w, (first, last) = _ranged(df, keys, partitions)
    path = scratch_path(df.sparkSession, "lag-ranges")
    ranged.write.parquet(path)
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(path)
    ends = ranged.select("_p", part, *cols, last.alias("_last")).filter("_last")
    over = Window.orderBy("_p")  # a row per range
    carry = ends.select("_p", *[F.lag(_q(c)).over(over).alias(f"_carry{k}") for k, c in enumerate([part, *cols])])
    inner = ranged.withColumns({"_first": first, "_part_before": F.lag(_q(part)).over(w), **{f"_prev_{c}": F.lag(_q(c)).over(w) for c in cols}})
    j = inner.join(carry, "_p", "left")
    before = lambda k, c: F.when(F.col("_first"), F.col(f"_carry{k}")).otherwise(F.col(f"_prev_{c}"))
    same = _q(part).eqNullSafe(F.when(F.col("_first"), F.col("_carry0")).otherwise(F.col("_part_before")))
    j = j.withColumns({f"_prev_{c}": F.when(same, before(k, c)) for k, c in enumerate(cols, 1)})
    return j.drop("_p", "_first", "_part_before", *[f"_carry{k}" for k in range(len(cols) + 1)])


def jumps(df: DataFrame, order: list[str], part: Optional[str] = None, day: Optional[str] = None,
          cols: Optional[list[str]] = None, partitions: Optional[int] = None) -> DataFrame:
    """|x - previous x| > 5 sd (sd 0 -> 1) for rate/count/minutes/... columns, per machine in time order.

    Rows are dealt by range of (machine, *order); each range counts its own jumps and keeps its
    first and last row, and the rows of one such table (a row per range) are compared at the borders.
    """
    part = part or find_col(df.columns, "machine_id", "machine", "asset_id")
    day = day or find_col(df.columns, "shift_date", "date")
    cols = cols or [c for c in numeric_columns(df, exclude=order) if any(t in c.lower() for t in JUMP_TOKENS)]
    sd = df.select(F.struct(*[F.stddev_samp(_q(c)).alias(f"c{i}") for i, c in enumerate(cols)])).scalar()
    thr = {c: F.lit(JUMP_K) * F.coalesce(F.when(sd.getField(f"c{i}") != 0, sd.getField(f"c{i}")), F.lit(1.0))
           for i, c in enumerate(cols)}
    keys = list(dict.fromkeys([part, day, *order]))
    rows, w, (first, last) = _ranged(df.select(*dict.fromkeys([*keys, *cols])), keys, partitions)
    same = ~F.col("_first") & _q(part).eqNullSafe(F.col("_part_before"))
    rows = rows.withColumns({"_first": first, "_last": last, "_part_before": F.lag(_q(part)).over(w), **{f"_prev_{c}": F.lag(_q(c)).over(w) for c in cols}})
    edge = lambda c, side: F.max(F.when(F.col(f"_{side}"), _q(c)))
    ranges = rows.groupBy("_p").agg(
        *[F.count(F.when(same & (F.abs(_q(c) - F.col(f"_prev_{c}")) > thr[c]), 1)).alias(f"_n{i}") for i, c in enumerate(cols)],
        *[edge(c, side).alias(f"_{side}{i}") for i, c in enumerate([*cols, part]) for side in ("first", "last")],
    )
    over, mine = Window.orderBy("_p"), len(cols)
    ranges = ranges.withColumns({f"_before{i}": F.lag(f"_last{i}").over(over) for i in range(mine + 1)} | {"_any": F.lag(F.lit(True)).over(over)})
    joined = F.col("_any") & F.col(f"_first{mine}").eqNullSafe(F.col(f"_before{mine}"))
    parts = []
    for i, c in enumerate(cols):
        across = F.when(joined & (F.abs(F.col(f"_first{i}") - F.col(f"_before{i}")) > thr[c]), 1).otherwise(0)
        total = F.coalesce(F.sum(F.col(f"_n{i}") + across), F.lit(0)).cast("bigint")
        parts.append(F.struct(F.lit(c).alias("column_name"), thr[c].alias("threshold"), total.alias("jumps")))
    return ranges.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def domain_rules(df: DataFrame) -> DataFrame:
    """Range rules on OEE columns plus downtime > planned and good > total rows (one row per rule)."""
    rules = []
    for name, lo, hi in RANGE_RULES:
        c = find_col(df.columns, name, exact_only=True)
        if not c:
            continue
        x = _q(c).try_cast("double")
        if lo is not None:
            rules.append((f"{c} below {lo:g}", c, F.count(F.when(x < lo, 1))))
        if hi is not None:
            rules.append((f"{c} above {hi:g}", c, F.count(F.when(x > hi, 1))))
    dt = find_col(df.columns, "downtime_minutes", "downtime_min", exact_only=True)
    pt = find_col(df.columns, "planned_time_min", "planned_minutes", "available_time_min", exact_only=True)
    if dt and pt:
        rules.append(("downtime exceeds planned time", dt, F.count(F.when(_q(dt).try_cast("double") > _q(pt).try_cast("double"), 1))))
    good = find_col(df.columns, "good_count", "good_units", exact_only=True)
    total = find_col(df.columns, "total_count", "total_units", "produced_count", exact_only=True)
    if good and total:
        rules.append(("good count > total count", good, F.count(F.when(_q(good).try_cast("double") > _q(total).try_cast("double"), 1))))
    parts = [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column_name"), e.alias("violations")) for r, c, e in rules]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def presence(df: DataFrame) -> DataFrame:
    """Machine id and date columns present; row and column counts."""
    mid = find_col(df.columns, "machine_id", "machine", "asset_id")
    ts = find_col(df.columns, "timestamp", "shift_date", "date", "time", "datetime")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(mid).cast("string").alias("machine_col"), F.lit(ts).cast("string").alias("date_col"),
        "rows", F.lit(len(df.columns)).alias("cols"),
    )


#: Items in one long of a basket.
WORD_BITS = 62


def assoc_rules(df: DataFrame, cats: Optional[list[str]] = None, nums: Optional[list[str]] = None, max_distinct: int = 12,
                min_support: float = 0.05, min_conf: float = 0.55, suspicious_conf: float = 0.7,
                marks: Optional[dict[str, list]] = None) -> DataFrame:
    """Pair rules over baskets of ``col=value`` and ``col=HIGH`` items.

    ``cats`` and ``nums`` name the columns to use; unnamed, every string column with at
    most ``max_distinct`` values and every numeric column.  All rows count, and every pair
    that meets support and confidence is returned; ``marks`` are the 90 % quantiles where they are known.  A row becomes one bit per item in a few longs; rows collapse to their
    distinct baskets by these before items and pairs are counted, so no string is shuffled and no row is paired with another.
    """
    str_cols = cats if cats is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    nd = df.agg(*[F.approx_count_distinct(_q(c)).alias(c) for c in str_cols]).collect()[0] if str_cols else {}
    # approximate count first (cheap), the values only of columns near the limit
    near = [c for c in str_cols if nd[c] <= max_distinct * 2]
    values = df.agg(*[F.collect_set(_q(c).cast("string")).alias(c) for c in near]).collect()[0] if near else {}
    cats = [c for c in near if len(values[c]) <= max_distinct]
    nums = nums if nums is not None else numeric_columns(df)
    q90 = marks or exact_quantiles(df, {c: _q(c) for c in nums}, [0.9])
    items = [(f"{c}={v}", _q(c).cast("string") == F.lit(v)) for c in cats for v in sorted(values[c])]
    items += [(f"{c}=HIGH", _q(c).cast("double") >= F.lit(q90[c][0])) for c in nums if q90[c][0] is not None]
    if not items:
        return df.sparkSession.createDataFrame([], "rule string, a string, b string, pair_count bigint, support double, "
                                                    "confidence double, baskets bigint, suspicious boolean")
    words = [items[i : i + WORD_BITS] for i in range(0, len(items), WORD_BITS)]
    bits = [reduce(lambda x, y: x.bitwiseOR(y), [F.when(test, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, test) in enumerate(word)])
            for word in words]
    names = [f"_w{i}" for i in range(len(words))]
    size = reduce(lambda x, y: x + y, [F.bit_count(n) for n in names])
    baskets = df.select(*[x.alias(n) for x, n in zip(bits, names)]).where(size >= 2).groupBy(*names).agg(F.count(F.lit(1)).alias("_w"))
    held = [F.when(F.getbit(F.col(names[k // WORD_BITS]), F.lit(k % WORD_BITS)) == 1, F.lit(k)) for k in range(len(items))]
    present = F.array_compact(F.array(*held))
    # a basket counts for itself (-1, -1), its items (i, i) and its pairs (i, j)
    firsts = baskets.select("_w", present.alias("p")).select("_w", "p", F.posexplode(F.concat(F.array(F.lit(-1)), "p")).alias("at", "i"))
    rest = F.when(F.col("i") < 0, F.array(F.lit(-1))).otherwise(F.slice("p", F.greatest(F.col("at"), F.lit(1)), F.size("p")))
    counts = firsts.select("_w", "i", F.explode(rest).alias("j")).groupBy("i", "j").agg(F.sum("_w").alias("cnt"))
    # at most 1 + m + m(m-1)/2 rows for m = len(cats) * max_distinct + len(nums) items: collect once
    small = counts.collect()
    spark = df.sparkSession
    n = next((r["cnt"] for r in small if r["i"] < 0), 0)
    named = [(1 if r["i"] == r["j"] else 2, *sorted((items[r["i"]][0], items[r["j"]][0])), r["cnt"]) for r in small if r["i"] >= 0]
    tbl = spark.createDataFrame(named, "kind int, a string, b string, cnt bigint").withColumn("n", F.lit(n).cast("bigint"))
    singles = tbl.where(F.col("kind") == 1).select(F.col("a").alias("item"), F.col("cnt").alias("item_count"))
    top = tbl.where(F.col("kind") == 2).select("a", "b", F.col("cnt").alias("pair_count"), "n")
    ia, ib = singles.alias("ia"), singles.alias("ib")
    j = top.join(ia, top["a"] == F.col("ia.item"), "left").join(ib, top["b"] == F.col("ib.item"), "left")
    conf = F.greatest(F.col("pair_count") / F.greatest(F.col("ia.item_count"), F.lit(1)),
                      F.col("pair_count") / F.greatest(F.col("ib.item_count"), F.lit(1)))
    out = j.select(
        F.concat_ws(" => ", "a", "b").alias("rule"), "a", "b", "pair_count",
        (F.col("pair_count") / F.col("n")).alias("support"), conf.alias("confidence"), F.col("n").alias("baskets"),
    ).where((F.col("support") >= min_support) & (F.col("confidence") >= min_conf) & (F.col("baskets") >= 20))
    return out.withColumn("suspicious", F.col("rule").contains("HIGH") & (F.col("confidence") >= suspicious_conf))


def _row(spark_df: DataFrame, check: str, status: Column, detail: Column) -> DataFrame:
    return spark_df.select(F.lit(check).alias("check"), status.alias("status"), detail.alias("detail"))


def _varying(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with at least two values."""
    flat = {r["column_name"] for r in constant(df.select(*[_q(c) for c in cols])).where("is_constant").collect()} if cols else set()
    return [c for c in cols if c not in flat]


def report(df: DataFrame, order: list[str], key: list[str], iforest_cols: Optional[list[str]] = None,
           dbscan_cols: Optional[tuple[str, str]] = None) -> DataFrame:
    """The 16 checks as (check, status, detail) rows.

    ``df`` carries the order / key columns used by the jump check and the
    isolation forest; they are excluded from the column-wise checks.
    DBSCAN looks at the two columns ``dbscan_cols`` (unnamed: the first two numeric ones that vary).
    """
    from millwright.operators.ml import cluster, dbscan, iforest

    keep = {"shift_date", "shift", "machine_id", "total_count"}
    frame = df.drop(*[c for c in set(order + key) if c in df.columns and c not in keep])
    nums = numeric_columns(frame)
    spark = df.sparkSession
    one = spark.range(1)
    m = missing(frame)
    rows = [
        _row(m, "NULLS / Missing%", F.col("status"), F.format_string("%.2f%% missing", F.col("missing_pct") * 100)),
        _row(constant(frame).agg(F.sort_array(F.collect_list(F.when(F.col("is_constant"), F.col("column_name")))).alias("c")),
             "CONSTANT", F.when(F.size("c") > 0, "FAIL").otherwise("PASS"),
             F.when(F.size("c") > 0, F.array_join("c", ", ")).otherwise("none")),
        _row(zeros(frame), "ZEROS", F.col("status"), F.format_string("%.1f%% zeros", F.col("zero_pct") * 100)),
        _row(duplicates(frame), "DUPLICATES", F.col("status"), F.format_string("%d dup rows", F.col("dup_rows"))),
    ]
    z = zscore(frame, nums).agg(F.sum("hits").alias("h"))
    rows.append(_row(z, "Z-SCORE (>3σ)", F.when(F.col("h") > 0, "WARN").otherwise("PASS"), F.format_string("%d hits", F.col("h"))))
    qs = exact_quantiles(frame, {c: _q(c) for c in nums}, [0.25, 0.75, 0.9])  # one search for both checks
    q = iqr(frame, nums, {c: v[:2] for c, v in qs.items()}).agg(F.sum("hits").alias("h"))
    rows.append(_row(q, "IQR OUTLIER", F.when(F.col("h") > 0, "WARN").otherwise("PASS"), F.format_string("%d hits", F.col("h"))))
    cols = iforest_cols or nums
    complete = df.select(*key, *cols).dropna()
    if len(cols) >= 2 and complete.limit(15).count() >= 15:
        s = iforest.fit_score(complete, cols, key, keep=[]).agg(F.count(F.when(F.col("anomaly"), 1)).alias("a"), F.count(F.lit(1)).alias("n"))
        rows.append(_row(s, "ISOLATION FOREST", F.when(F.col("a") > 0, "WARN").otherwise("PASS"),
                         F.format_string("%d anomalies, %.2f%%", F.col("a"), F.col("a") / F.col("n") * 100)))
    else:
        rows.append(_row(one, "ISOLATION FOREST", F.lit("INFO"), F.lit("need >=2 numeric cols & 15 rows")))
    pair = dbscan_cols or _varying(frame, nums)[:2]
    if len(pair) == 2:
        db = dbscan.summary(frame, *pair)
        rows.append(_row(db, "DBSCAN NOISE", F.when(F.col("noise_points") > 0, "WARN").when(F.col("ok"), "PASS").otherwise("INFO"),
                         F.when(F.col("ok"), F.format_string("%d noise points, %d clusters", F.col("noise_points"), F.col("clusters"))).otherwise("need more numeric rows")))
    else:
        rows.append(_row(one, "DBSCAN NOISE", F.lit("INFO"), F.lit("need >=2 numeric cols that vary")))
    km = cluster.kmeans_far(frame, nums)
    rows.append(_row(km, "KMEANS DISTANCE", F.when(F.col("far_from_cluster") > 0, "WARN").when(F.col("ok"), "PASS").otherwise("INFO"),
                     F.format_string("%d far from cluster", F.coalesce(F.col("far_from_cluster"), F.lit(0)))))
    j = jumps(df, order=order, cols=[c for c in nums if any(t in c.lower() for t in JUMP_TOKENS)]).agg(F.sum("jumps").alias("j"))
    rows.append(_row(j, "ROLLING IMPOSSIBLE JUMP", F.when(F.col("j") > 0, "FAIL").otherwise("PASS"), F.format_string("%d jumps", F.col("j"))))
    dr = domain_rules(frame).agg(F.sort_array(F.collect_list(F.when(F.col("violations") > 0, F.col("rule")))).alias("r"))
    rows.append(_row(dr, "OEE DOMAIN RULES", F.when(F.size("r") > 0, "FAIL").otherwise("PASS"),
                     F.when(F.size("r") > 0, F.array_join("r", "; ")).otherwise("no domain violations")))
    date_col = find_col(df.columns, "shift_date", "date")
    pca = cluster.pca_drift(frame, nums, date_col) if date_col else None
    if pca is not None:
        rows.append(_row(pca, "PCA / CONCEPT DRIFT", F.when(F.col("concept_drift"), "WARN").when(F.col("ok"), "PASS").otherwise("INFO"),
                         F.format_string("drift %.3f", F.coalesce(F.col("drift_score"), F.lit(0.0)))))
    else:
        rows.append(_row(one, "PCA / CONCEPT DRIFT", F.lit("INFO"), F.lit("no order column")))
    ar = assoc_rules(frame, marks={c: v[2:] for c, v in qs.items()}).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("suspicious"), 1)).alias("s"))
    rows.append(_row(ar, "ASSOCIATION RULE MINING", F.when(F.col("s") > 0, "WARN").otherwise("PASS"),
                     F.format_string("%d rules, %d suspicious", F.col("n"), F.col("s"))))
    pr = presence(frame)
    rows.append(_row(pr, "MACHINE ID PRESENT", F.when(F.col("machine_col").isNotNull(), "PASS").otherwise("WARN"),
                     F.coalesce(F.col("machine_col"), F.lit("missing"))))
    rows.append(_row(pr, "TIMESTAMP / SHIFT DATE", F.when(F.col("date_col").isNotNull(), "PASS").otherwise("WARN"),
                     F.coalesce(F.col("date_col"), F.lit("missing"))))
    rows.append(_row(pr, "SCHEMA / ROWCOUNT", F.when(F.col("rows") > 0, "PASS").otherwise("FAIL"),
                     F.format_string("%d rows x %d cols", F.col("rows"), F.col("cols"))))
    return reduce(DataFrame.unionByName, rows)


def report_summary(rep: DataFrame) -> DataFrame:
    """V15 summary: pass (INFO counts as pass), warn, fail, info, total."""
    return rep.agg(
        F.count(F.when(F.col("status") == "FAIL", 1)).alias("fail"),
        F.count(F.when(F.col("status") == "WARN", 1)).alias("warn"),
        F.count(F.when(F.col("status") == "INFO", 1)).alias("info"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("pass", F.col("total") - F.col("fail") - F.col("warn"))
