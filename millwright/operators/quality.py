"""Quality overlay: scrap / FPY, defect Pareto, SPC (I-MR) and Cp/Cpk.

SPC is computed at subgroup grain (date x shift x line), then the control
charts run windows over that small table: the plant chart over dates, the
line charts partitioned by line.  Row-grain data is never windowed.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.common import clip, num, num0, trailing_window
from millwright.functions.quantiles import exact_quantiles
from millwright.functions.resolve import find_col
from millwright.operators.downtime import pareto_table

# Fixed values from the reference: synthetic defect codes, I-MR constant,
# minimum sample sizes.
SYNTH_DEFECTS = ("DIM", "SCRATCH", "CONTAM", "OTHER")
IMR_K = 2.66
MIN_SPC_POINTS = 5
MIN_CPK_PLANT, MIN_CPK_LINE = 10, 8


def counts(df: DataFrame) -> DataFrame:
    """Q1: derive the missing one of total/good/rejects; scrap_rate and fpy per row.

    Adds canonical columns good_count, reject_count, total_count, scrap_rate, fpy.
    """
    cols = df.columns
    good = find_col(cols, "good_count", "good_units", "good_output")
    rej = find_col(cols, "reject_count", "rejects", "scrap_count", "defect_count")
    total = find_col(cols, "total_count", "total_units", "produced_count")
    scrap = find_col(cols, "scrap_rate", "reject_rate")
    z = F.lit(0.0)
    if total:
        total_c = num0(total)
    elif good and rej:
        total_c = num0(good) + num0(rej)
    else:
        total_c = z
    if good:
        good_c = num0(good)
    elif total and rej:
        good_c = F.greatest(num0(total) - num0(rej), z)
    else:
        good_c = z
    if rej:
        rej_c = num0(rej)
    elif total and good:
        rej_c = F.greatest(num0(total) - num0(good), z)
    else:
        rej_c = z
    computed = clip(F.coalesce(F.try_divide(rej_c, F.when(total_c != 0, total_c)), z), 0, 1)
    scrap_c = F.coalesce(num(scrap), computed) if scrap else computed
    w = df.withColumns({"good_count": good_c, "reject_count": rej_c, "total_count": total_c})
    w = w.withColumn("scrap_rate", scrap_c)
    return w.withColumn("fpy", clip(F.lit(1.0) - F.col("scrap_rate"), 0, 1))


def scrap_fpy(df: DataFrame) -> DataFrame:
    """Q2: plant good, rejects, total, scrap rate and FPY (one row)."""
    w = counts(df)
    g = w.agg(F.sum("good_count").alias("good"), F.sum("reject_count").alias("rejects"), F.sum("total_count").alias("_t"))
    total = F.when(F.col("_t") <= 0, F.col("good") + F.col("rejects")).otherwise(F.col("_t"))
    g = g.withColumn("total", total)
    nz = F.col("total") != 0
    return g.select(
        "good", "rejects", "total",
        F.when(nz, F.col("rejects") / F.col("total")).otherwise(0.0).alias("scrap_rate"),
        F.when(nz, 1.0 - F.col("rejects") / F.col("total")).otherwise(0.0).alias("fpy"),
    )


def scrap_by_line(df: DataFrame) -> DataFrame:
    """Q3: per line sums, mean and weighted scrap / FPY, share of plant rejects."""
    w = counts(df)
    line = find_col(w.columns, "line_id", "line")
    g = w.groupBy(F.col(line).alias("line_id")).agg(
        F.sum("good_count").alias("good"),
        F.sum("reject_count").alias("rejects"),
        F.sum("total_count").alias("total"),
        F.avg("scrap_rate").alias("scrap_rate"),
        F.avg("fpy").alias("fpy"),
    )
    plant_rej = F.sum("rejects").over(Window.partitionBy())  # sum over the per-line table
    weighted = F.when(F.col("total") > 0, F.col("rejects") / F.col("total")).otherwise(F.col("scrap_rate"))
    return g.withColumn("scrap_rate_weighted", weighted).withColumns(
        {
            "fpy_weighted": F.lit(1.0) - F.col("scrap_rate_weighted"),
            "reject_share": F.col("rejects") / F.greatest(F.coalesce(plant_rej, F.lit(0.0)), F.lit(1.0)),
        }
    )


def quality_oee_link(plant_oee: DataFrame) -> DataFrame:
    """Q4: quality pillar of plant OEE and its loss in OEE points."""
    return plant_oee.select(
        F.col("quality").alias("quality_oee"),
        (F.col("availability") * F.col("performance") * (F.lit(1.0) - F.col("quality"))).alias("quality_loss_oee_pts"),
    )


def synthetic_defect(seed: Column) -> Column:
    """Stable bucket md5(seed) mod 4 over SYNTH_DEFECTS (the last hex digit decides mod 4)."""
    arr = F.array(*[F.lit(c) for c in SYNTH_DEFECTS])
    idx = F.conv(F.substring(F.md5(seed), 32, 1), 16, 10).cast("int") % 4
    return F.element_at(arr, idx + 1)


def defect_codes(df: DataFrame) -> tuple[DataFrame, bool]:
    """Q5: defect_code from a column (null -> UNSPECIFIED) or synthesized from machine+line."""
    code = find_col(df.columns, "defect_code", "defect_type", "defect", "reject_code", "nc_code")
    if code:
        return df.withColumn("defect_code", F.coalesce(F.col(code).cast("string"), F.lit("UNSPECIFIED"))), False
    machine = find_col(df.columns, "machine_id", "machine")
    line = find_col(df.columns, "line_id", "line")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in (machine, line) if c]
    seed = F.concat(*parts) if parts else F.lit("")
    return df.withColumn("defect_code", synthetic_defect(seed)), True


def defect_pareto(df: DataFrame, top_n: int = 10) -> DataFrame:
    """Q6: events, rejects, pct, cum_pct per defect code, top 10, synthesized flag."""
    w, synth = defect_codes(df)
    w = counts(w)
    g = w.groupBy(F.col("defect_code").alias("cause")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("reject_count").alias("rejects")
    )
    out = pareto_table(g, "rejects", top_n)
    return out.withColumnRenamed("cause", "defect_code").withColumn("synthesized", F.lit(synth))


def spc_subgroups(df: DataFrame) -> DataFrame:
    """Q7: mean scrap rate per (date, shift, line); reject count if < 5 scrap values."""
    w = counts(df)
    cols = w.columns
    date_col = find_col(cols, "shift_date", "date", "timestamp")
    line = find_col(cols, "line_id", "line")
    shift = find_col(cols, "shift", exact_only=True)
    n_scrap = w.select(F.count("scrap_rate")).scalar()
    metric = F.when(n_scrap >= MIN_SPC_POINTS, F.col("scrap_rate")).otherwise(F.col("reject_count"))
    keys = [c for c in (date_col, shift, line) if c]
    return w.groupBy(*[F.col(c) for c in keys]).agg(F.avg(metric).alias("xbar")).select(
        F.col(date_col).alias("shift_date") if date_col else F.lit(None).cast("date").alias("shift_date"),
        F.col(shift).alias("shift") if shift else F.lit(None).cast("string").alias("shift"),
        F.col(line).alias("line_id") if line else F.lit(None).cast("string").alias("line_id"),
        "xbar",
    )


def _imr(points: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """I-MR limits over an ordered series (per partition), with point numbers and ooc flags."""
    w = Window.partitionBy(*part).orderBy(*order) if part else Window.orderBy(*order)
    wall = Window.partitionBy(*part) if part else Window.partitionBy()
    s = points.withColumns(
        {
            "point": F.row_number().over(w).cast("bigint"),
            "_mr": F.abs(F.col("xbar") - F.lag("xbar").over(w)),
        }
    )
    s = s.withColumns(
        {
            "_n": F.count("xbar").over(wall),
            "cl": F.avg("xbar").over(wall),
            "mr_bar": F.coalesce(F.avg("_mr").over(wall), F.lit(0.0)),
        }
    )
    ok = F.col("_n") >= MIN_SPC_POINTS
    s = s.withColumns(
        {
            "cl": F.when(ok, F.col("cl")),
            "mr_bar": F.when(ok, F.col("mr_bar")),
        }
    ).withColumns(
        {
            "ucl": F.col("cl") + IMR_K * F.col("mr_bar"),
            "lcl": F.greatest(F.lit(0.0), F.col("cl") - IMR_K * F.col("mr_bar")),
        }
    )
    ooc = F.coalesce(ok & ((F.col("xbar") > F.col("ucl")) | (F.col("xbar") < F.col("lcl"))), F.lit(False))
    return s.withColumn("ooc", ooc).drop("_mr", "_n")


def spc_plant(df: DataFrame) -> DataFrame:
    """Q8: plant I-MR chart on daily means of subgroup means (needs >= 5 points)."""
    sg = spc_subgroups(df)
    daily = sg.where(F.col("shift_date").isNotNull()).groupBy("shift_date").agg(F.avg("xbar").alias("xbar"))
    chart = _imr(daily, [], ["shift_date"])
    return chart.where(F.col("cl").isNotNull()).select("shift_date", "point", "xbar", "cl", "ucl", "lcl", "mr_bar", "ooc")


def spc_by_line(df: DataFrame) -> DataFrame:
    """Q9: I-MR chart per line over (date, shift) subgroups, all lines in one result."""
    sg = spc_subgroups(df)
    chart = _imr(sg, ["line_id"], ["shift_date", "shift"])
    return chart.select("line_id", "shift_date", "shift", "point", "xbar", "cl", "ucl", "lcl", "ooc")


def _spec_cols(cols):
    meas = find_col(cols, "measurement_mm", "measurement", "measured_value", "dimension", "thickness", "weight", "spec_value")
    usl = find_col(cols, "usl", "spec_usl", "upper_spec", "usl_mm")
    lsl = find_col(cols, "lsl", "spec_lsl", "lower_spec", "lsl_mm")
    return meas, lsl, usl


def spec_limits(df: DataFrame) -> tuple[Optional[float], Optional[float]]:
    """LSL / USL as the exact medians of their columns (driver scalars)."""
    _, lsl, usl = _spec_cols(df.columns)
    present = [(k, c) for k, c in (("lsl", lsl), ("usl", usl)) if c]
    if not present:
        return None, None
    med = exact_quantiles(df, {k: num(c) for k, c in present}, [0.5])
    return med.get("lsl", [None])[0], med.get("usl", [None])[0]


def _cap(n: Column, m: Column, s: Column, lo: Column, hi: Column) -> dict[str, Column]:
    return {
        "cp": (hi - lo) / (F.lit(6.0) * s),
        "cpk": F.least((hi - m) / (F.lit(3.0) * s), (m - lo) / (F.lit(3.0) * s)),
    }


def cpk_plant(df: DataFrame) -> DataFrame:
    """Q10: Cp / Cpk with medians of LSL/USL, sample sd; ok flag and reason (one row)."""
    meas, lsl, usl = _spec_cols(df.columns)
    if not (meas and lsl and usl):
        return df.sparkSession.createDataFrame([(False, "no spec-like columns")], "ok boolean, reason string")
    lo, hi = spec_limits(df)
    x = num(meas)
    g = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    lo_c, hi_c = F.lit(lo).cast("double"), F.lit(hi).cast("double")
    reason = (
        F.when(F.col("n") < MIN_CPK_PLANT, "need >=10 numeric measurements")
        .when(lo_c.isNull() | hi_c.isNull(), "LSL/USL could not be parsed")
        .when(hi_c <= lo_c, "invalid spec window (USL <= LSL)")
        .when(F.col("std") <= 1e-12, "measurement has no variation")
    )
    ok = reason.isNull()
    cap = _cap(F.col("n"), F.col("mean"), F.col("std"), lo_c, hi_c)
    return g.select(
        F.lit(meas).alias("measurement"), lo_c.alias("lsl"), hi_c.alias("usl"), "mean", "std", "n",
        F.when(ok, cap["cp"]).alias("cp"), F.when(ok, cap["cpk"]).alias("cpk"), ok.alias("ok"), reason.alias("reason"),
    )


def cpk_by_line(df: DataFrame) -> DataFrame:
    """Q11: Cp / Cpk per line with the plant limits (>= 8 values, sd > 1e-12)."""
    meas, lsl, usl = _spec_cols(df.columns)
    line = find_col(df.columns, "line_id", "line")
    lo, hi = spec_limits(df)
    x = num(meas)
    g = df.groupBy(F.col(line).alias("line_id")).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")
    )
    g = g.where((F.col("n") >= MIN_CPK_LINE) & (F.col("std") > 1e-12))
    cap = _cap(F.col("n"), F.col("mean"), F.col("std"), F.lit(lo).cast("double"), F.lit(hi).cast("double"))
    return g.select("line_id", "n", "mean", "std", cap["cp"].alias("cp"), cap["cpk"].alias("cpk"))


def killer_line(df: DataFrame, days: int = 7) -> DataFrame:
    """Q12: worst and best line by weighted scrap in the trailing window (one row).

    One pass: the per-line table is aggregated once more into the single row.
    """
    date_col = find_col(df.columns, "shift_date", "date", "timestamp")
    week = trailing_window(df, date_col, days)
    b = scrap_by_line(week)
    sw = F.col("scrap_rate_weighted")
    # ties go to the smaller line id
    high = F.when(sw.isNotNull(), F.struct((-sw).alias("v"), F.col("line_id")))
    low = F.when(sw.isNotNull(), F.struct(sw.alias("v"), F.col("line_id")))
    tot = F.when(F.sum("total") <= 0, F.sum("good") + F.sum("rejects")).otherwise(F.sum("total"))
    return b.agg(
        F.min_by("line_id", high).alias("worst_line"),
        F.max(sw).alias("worst_scrap_rate"),
        F.min_by("fpy_weighted", high).alias("worst_fpy"),
        F.min_by("reject_share", high).alias("worst_reject_share"),
        F.min_by("line_id", low).alias("best_line"),
        F.min(sw).alias("best_scrap_rate"),
        F.when(tot != 0, F.sum("rejects") / tot).otherwise(0.0).alias("plant_scrap_rate"),
    )
