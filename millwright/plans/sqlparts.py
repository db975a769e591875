"""DuckDB SQL building blocks for the oracle queries.

The adapter CTEs here mirror ``millwright.sources.testdata`` expression by
expression, so an oracle query is ``WITH <adapter>, <query CTEs> SELECT ...``.
"""

PLANT = """plant AS (
  SELECT
    concat('L', CAST(l_suppkey % 5 + 1 AS VARCHAR)) AS line_id,
    concat('M', CAST(l_suppkey AS VARCHAR)) AS machine_id,
    CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS shift,
    CAST(l_shipdate AS DATE) AS shift_date,
    CAST(480 AS DOUBLE) AS planned_time_min,
    CAST(8 + 2 * (l_partkey % 3) AS DOUBLE) AS ideal_rate,
    l_quantity * 100 AS total_count,
    l_quantity * round(l_tax * 100) AS reject_count,
    l_quantity * 100 - l_quantity * round(l_tax * 100) AS good_count,
    l_discount * 1000 AS downtime_minutes,
    CAST(1 AS DOUBLE) + l_extendedprice / 20000 AS vibration_rms,
    CAST(40 AS DOUBLE) + l_quantity / 2 AS temp_c,
    CAST(10 AS DOUBLE) + l_discount * 50 AS motor_current_a,
    CASE l_returnflag WHEN 'A' THEN 'DIM' WHEN 'R' THEN 'SCRATCH' ELSE 'CONTAM' END AS defect_code,
    CAST(10 AS DOUBLE) + (l_quantity - CAST(25.5 AS DOUBLE)) / 100 AS measurement_mm,
    CAST(9.5 AS DOUBLE) AS lsl,
    CAST(10.5 AS DOUBLE) AS usl,
    l_orderkey, l_linenumber, l_partkey
  FROM lineitem
)"""

DOWNTIME = """downtime AS (
  SELECT
    event_id,
    concat('L', CAST(user_id % 5 + 1 AS VARCHAR)) AS line_id,
    concat('M', CAST(user_id AS VARCHAR)) AS machine_id,
    CASE WHEN hour(ts) < 8 THEN 'A' WHEN hour(ts) < 16 THEN 'B' ELSE 'C' END AS shift,
    date '1999-06-01' + CAST(date_diff('day', date '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS shift_date,
    CASE event_type WHEN 'error' THEN 'BRK02' WHEN 'purchase' THEN 'CHG01' WHEN 'signup' THEN 'PM07'
                    WHEN 'view' THEN 'MAT04' WHEN 'click' THEN 'STP08' END AS downtime_code,
    CASE event_type WHEN 'error' THEN 'Breakdown — mechanical' WHEN 'purchase' THEN 'Changeover'
                    WHEN 'signup' THEN 'Planned maintenance' WHEN 'view' THEN 'Material shortage'
                    WHEN 'click' THEN 'Minor stoppage' END AS downtime_category,
    value AS downtime_minutes,
    ts AS start_time,
    ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS end_time,
    event_type IN ('purchase', 'signup') AS is_planned
  FROM events
)"""

CELL_KEYS = "shift_date, shift, line_id, machine_id"


def pillars(p: str, d: str, i: str, t: str, g: str) -> dict[str, str]:
    """Unrounded OEE pillar SQL over input expressions (mirrors functions.oee.pillars)."""
    P = f"greatest(coalesce({p}, 0.0::DOUBLE), 0.0::DOUBLE)"
    D = f"greatest(coalesce({d}, 0.0::DOUBLE), 0.0::DOUBLE)"
    RUN = f"greatest({P} - {D}, 0.0::DOUBLE)"
    I = f"greatest(coalesce({i}, 0.0::DOUBLE), 0.0::DOUBLE)"
    T = f"greatest(coalesce({t}, 0.0::DOUBLE), 0.0::DOUBLE)"
    G = f"least(greatest(coalesce({g}, 0.0::DOUBLE), 0.0::DOUBLE), {T})"
    A = f"(CASE WHEN {P} > 0 THEN {RUN} / {P} ELSE 0.0::DOUBLE END)"
    PERF = f"least(CASE WHEN {RUN} > 0 AND {I} > 0 THEN {T} / ({RUN} * {I}) ELSE 0.0::DOUBLE END, 1.5::DOUBLE)"
    Q = f"(CASE WHEN {T} > 0 THEN {G} / {T} ELSE 0.0::DOUBLE END)"
    return {"run_time_min": RUN, "availability": A, "performance": PERF, "quality": Q,
            "oee": f"({A} * {PERF} * {Q})"}


def r4(expr: str, digits: int = 4) -> str:
    """Tie-robust rounding, same formula as functions.common.round_half_away."""
    return f"round(CAST({expr} AS DOUBLE) + sign(CAST({expr} AS DOUBLE)) * 1e-9, {digits})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def oee_group_select(keys: str, src: str = "plant", extra: str = "") -> str:
    """SELECT of weighted OEE per group over an adapter CTE."""
    m = pillars("_p", "_d", "_i", "_t", "_g")
    k = f"{keys}, " if keys else ""
    gb = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}{r4(m['run_time_min'])} AS run_time_min, {r4(m['availability'])} AS availability,
  {r4(m['performance'])} AS performance, {r4(m['quality'])} AS quality, {r4(m['oee'])} AS oee,
  shifts, {r4('_t')} AS total_count, {r4('_g')} AS good_count, {r4('_d')} AS downtime_minutes{extra}
FROM (SELECT {k}sum(planned_time_min) AS _p, sum(downtime_minutes) AS _d, avg(ideal_rate) AS _i,
             sum(total_count) AS _t, sum(good_count) AS _g, count(*) AS shifts
      FROM {src} {gb})"""


def fixed(x: str, digits: int = 1) -> str:
    """``x`` as text with that many decimals, halves of its shortest decimal form rounded up (as Java formats; C rounds the binary value)."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 15)), {digits}) AS VARCHAR)"


def percent(x: str) -> str:
    return f"{fixed(f'({x}) * 100')} || '%'"


def dollars(x: str) -> str:
    """``x`` in whole dollars with thousands separators."""
    return f"'$' || format('{{:,}}', CAST({fixed(x, 0)} AS BIGINT))"
