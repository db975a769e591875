"""OEE pillar expressions (availability x performance x quality) as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values from the reference: performance cap, world-class OEE, defaults.
PERFORMANCE_CAP = 1.5
WORLD_CLASS_OEE = 0.85
DEFAULT_PLANNED_MIN = 480.0
DEFAULT_DOWNTIME_MIN = 0.0
DEFAULT_IDEAL_RATE = 10.0


def pillars(planned: Column, downtime: Column, ideal: Column, total: Column, good: Column) -> dict[str, Column]:
    """Unrounded pillars from (planned, downtime, ideal rate, total, good).

    Negatives are read as 0, good is capped at total, zero denominators give 0.
    """
    z = F.lit(0.0)
    p = F.greatest(F.coalesce(planned, z), z)
    d = F.greatest(F.coalesce(downtime, z), z)
    run = F.greatest(p - d, z)
    i = F.greatest(F.coalesce(ideal, z), z)
    t = F.greatest(F.coalesce(total, z), z)
    g = F.least(F.greatest(F.coalesce(good, z), z), t)
    a = F.when(p > 0, F.try_divide(run, p)).otherwise(z)
    perf = F.least(F.when((run > 0) & (i > 0), F.try_divide(t, run * i)).otherwise(z), F.lit(PERFORMANCE_CAP))
    q = F.when(t > 0, F.try_divide(g, t)).otherwise(z)
    return {"run_time_min": run, "availability": a, "performance": perf, "quality": q, "oee": a * perf * q}


def losses(a: Column, p: Column, q: Column) -> dict[str, Column]:
    z = F.lit(0.0)
    return {
        "loss_availability": F.greatest(F.lit(1.0) - a, z),
        "loss_performance": F.greatest(a * (F.lit(1.0) - p), z),
        "loss_quality": F.greatest(a * p * (F.lit(1.0) - q), z),
    }
