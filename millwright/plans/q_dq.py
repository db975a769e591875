"""Data-quality queries (V1-V6, V10, V11, V13, V14) over the integrated plant frame."""

from __future__ import annotations

from millwright.operators import dq
from millwright.operators import oee
from millwright.operators.ml import dbscan
from millwright.plans.catalog import register
from millwright.plans.sqlparts import PLANT, pillars, r4, with_
from millwright.sources import testdata as td

ROW_ORDER = ["shift_date", "shift", "l_orderkey", "l_linenumber", "l_partkey", "total_count"]  # total order of rows
DQ_COLS = ["line_id", "machine_id", "shift", "shift_date", "planned_time_min", "ideal_rate", "total_count", "reject_count",
           "good_count", "downtime_minutes", "vibration_rms", "temp_c", "motor_current_a", "defect_code", "measurement_mm",
           "lsl", "usl"]
NUMS = ["planned_time_min", "ideal_rate", "total_count", "reject_count", "good_count", "downtime_minutes", "vibration_rms",
        "temp_c", "motor_current_a", "measurement_mm", "lsl", "usl"]
DQF = "dqf AS (SELECT " + ", ".join(DQ_COLS) + " FROM plant)"


def dq_frame(spark, sf):
    return td.plant_rows(spark, sf).select(*DQ_COLS)


def _plus(parts):
    return " + ".join(parts)


_MISS = _plus([f"count(*) FILTER (WHERE {c} IS NULL)" for c in DQ_COLS])
_CELLS = f"count(*) * {len(DQ_COLS)}"


@register("dq_missing", with_(PLANT, DQF) + f"""SELECT count(*) AS rows, {len(DQ_COLS)} AS cols, {_MISS} AS missing_cells,
  {r4(f'CASE WHEN {_CELLS} > 0 THEN ({_MISS}) / ({_CELLS}) ELSE 0.0 END')} AS missing_pct,
  CASE WHEN ({_MISS}) / ({_CELLS}) > 0.2 THEN 'FAIL' WHEN ({_MISS}) / ({_CELLS}) > 0.05 THEN 'WARN' ELSE 'PASS' END AS status FROM dqf""")
def dq_missing(spark, sf):
    """V1: share of missing cells."""
    return dq.missing(dq_frame(spark, sf))


@register("dq_constant", with_(PLANT, DQF) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (count({c}) = 0 OR min({c}) = max({c})) AS is_constant FROM dqf" for c in DQ_COLS))
def dq_constant(spark, sf):
    """V2: columns with at most one distinct value."""
    return dq.constant(dq_frame(spark, sf))


_Z = _plus([f"count(*) FILTER (WHERE {c} = 0)" for c in NUMS])


@register("dq_zeros", with_(PLANT, DQF) + f"""SELECT {_Z} AS zero_cells, count(*) * {len(NUMS)} AS numeric_cells,
  {r4(f'CASE WHEN count(*) > 0 THEN ({_Z}) / (count(*) * {len(NUMS)}) ELSE 0.0 END')} AS zero_pct,
  CASE WHEN ({_Z}) / (count(*) * {len(NUMS)}) > 0.3 THEN 'WARN' ELSE 'PASS' END AS status FROM dqf""")
def dq_zeros(spark, sf):
    """V3: share of zero numeric cells."""
    return dq.zeros(dq_frame(spark, sf))


@register("dq_duplicates", with_(PLANT, DQF) + f"""SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS dup_rows,
  CASE WHEN coalesce(sum(n - 1), 0) > 0 THEN 'WARN' ELSE 'PASS' END AS status
FROM (SELECT count(*) AS n FROM dqf GROUP BY """ + ", ".join(DQ_COLS) + ")")
def dq_duplicates(spark, sf):
    """V4: duplicate row count."""
    return dq.duplicates(dq_frame(spark, sf))


def _z_sql(c):
    return (f"SELECT '{c}' AS column_name, n, CAST(CASE WHEN n >= 5 THEN h ELSE 0 END AS BIGINT) AS hits FROM "
            f"(SELECT count({c}) AS n, count(*) FILTER (WHERE abs(({c} - m) / (s + 1e-9)) > 3) AS h "
            f"FROM dqf, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM dqf))")


@register("dq_zscore", with_(PLANT, DQF) + " UNION ALL ".join(_z_sql(c) for c in NUMS))
def dq_zscore(spark, sf):
    """V5: z-score (> 3 sd) hits per numeric column."""
    return dq.zscore(dq_frame(spark, sf))


def _iqr_sql(c):
    return (f"SELECT '{c}' AS column_name, {r4('q1')} AS q1, {r4('q3')} AS q3, CAST(CASE WHEN q3 - q1 = 0 THEN 0 ELSE "
            f"(SELECT count(*) FROM dqf WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) END AS BIGINT) AS hits "
            f"FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM dqf)")


@register("dq_iqr", with_(PLANT, DQF) + " UNION ALL ".join(_iqr_sql(c) for c in NUMS))
def dq_iqr(spark, sf):
    """V6: IQR outliers per numeric column (exact quartiles)."""
    return dq.iqr(dq_frame(spark, sf))


JUMP_COLS = [c for c in NUMS if any(t in c for t in dq.JUMP_TOKENS)]
_ORD = "shift_date, shift, l_orderkey, l_linenumber, l_partkey, total_count"  # a total order of lineitem rows


def _jump_sql(c):
    return (f"SELECT '{c}' AS column_name, {r4('t')} AS threshold, count(*) FILTER (WHERE abs(d) > t) AS jumps FROM "
            f"(SELECT {c} - lag({c}) OVER (PARTITION BY machine_id ORDER BY {_ORD}) AS d FROM plant), "
            f"(SELECT 5.0 * coalesce(nullif(stddev_samp({c}), 0), 1.0) AS t FROM plant) GROUP BY t")


@register("dq_jumps", with_(PLANT) + " UNION ALL ".join(_jump_sql(c) for c in JUMP_COLS))
def dq_jumps(spark, sf):
    """Impossible jumps between consecutive shift rows of a machine."""
    p = td.plant_rows(spark, sf)
    return dq.jumps(p, order=ROW_ORDER, part="machine_id", day="shift_date", cols=JUMP_COLS)


_pm = pillars("planned_time_min", "downtime_minutes", "ideal_rate", "total_count", "good_count")
_RULES = [(f"{n} below 0", n, f"{_pm.get(n, n)} < 0") for n in ("availability", "performance", "quality", "oee")]
_RULE_SQL = []
for _n in ("availability", "performance", "quality", "oee"):
    _e = _pm[_n]
    _RULE_SQL += [(f"{_n} below 0", _n, f"{_e} < 0"), (f"{_n} above 1.5", _n, f"{_e} > 1.5")]
_RULE_SQL += [("ideal_rate below 0", "ideal_rate", "ideal_rate < 0"),
              ("downtime exceeds planned time", "downtime_minutes", "downtime_minutes > planned_time_min"),
              ("good count > total count", "good_count", "good_count > total_count")]


@register("dq_domain_rules", with_(PLANT) + " UNION ALL ".join(
    f"SELECT '{r}' AS rule, '{c}' AS column_name, count(*) FILTER (WHERE {e}) AS violations FROM plant" for r, c, e in _RULE_SQL))
def dq_domain_rules(spark, sf):
    """OEE range rules and impossible-count rules."""
    return dq.domain_rules(oee.rows(dq_frame(spark, sf)))


@register("dq_presence", with_(PLANT, DQF) + f"SELECT 'machine_id' AS machine_col, 'shift_date' AS date_col, count(*) AS rows, {len(DQ_COLS)} AS cols FROM dqf")
def dq_presence(spark, sf):
    """Machine id and date present; shape."""
    return dq.presence(dq_frame(spark, sf))


_CATS = ["line_id", "machine_id", "shift", "defect_code"]  # string columns in frame order; kept when <= 12 distinct
_ANUMS = NUMS
_ITEMS = ", ".join([f"CASE WHEN {c} IS NOT NULL AND nd_{c} <= 12 THEN '{c}=' || CAST({c} AS VARCHAR) END" for c in _CATS]
                   + [f"CASE WHEN {c} >= t_{c} THEN '{c}=HIGH' END" for c in _ANUMS])
_THR = ", ".join([f"quantile_cont({c}, 0.9) AS t_{c}" for c in _ANUMS] + [f"count(DISTINCT {c}) AS nd_{c}" for c in _CATS])
ASSOC_SQL = with_(
    PLANT, DQF,
    f"th AS (SELECT {_THR} FROM dqf)",
    f"bk AS (SELECT row_number() OVER () AS rid, list_sort(list_filter([{_ITEMS}], lambda x: x IS NOT NULL)) AS items FROM dqf, th)",
    "b2 AS (SELECT * FROM bk WHERE len(items) >= 2)",
    "nb AS (SELECT count(*) AS n FROM b2)",
    "it AS (SELECT rid, unnest(items) AS item, unnest(generate_series(1, len(items))) AS pos FROM b2)",
    "ic AS (SELECT item, count(*) AS item_count FROM it GROUP BY item)",
    "pc AS (SELECT x.item AS a, y.item AS b, count(*) AS pair_count FROM it x JOIN it y ON x.rid = y.rid AND x.pos < y.pos GROUP BY 1, 2)",
) + f"""SELECT a || ' => ' || b AS rule, a, b, pair_count, {r4('pair_count / n')} AS support,
  {r4('greatest(pair_count / greatest(ia.item_count, 1), pair_count / greatest(ib.item_count, 1))')} AS confidence, n AS baskets,
  (contains(a || ' => ' || b, 'HIGH') AND greatest(pair_count / greatest(ia.item_count, 1), pair_count / greatest(ib.item_count, 1)) >= 0.7) AS suspicious
FROM pc LEFT JOIN ic ia ON pc.a = ia.item LEFT JOIN ic ib ON pc.b = ib.item, nb
WHERE pair_count / n >= 0.05 AND greatest(pair_count / greatest(ia.item_count, 1), pair_count / greatest(ib.item_count, 1)) >= 0.55 AND n >= 20"""


@register("dq_assoc_rules", ASSOC_SQL)
def dq_assoc_rules(spark, sf):
    """Association rules over col=value / col=HIGH baskets of every row."""
    return dq.assoc_rules(dq_frame(spark, sf))


DBSCAN_EPS = 0.005  # of the continuous column: some points are core, some border, some noise
_NEAR = f"(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {DBSCAN_EPS} * {DBSCAN_EPS}"
_PAIRS = f"""a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy)
  JOIN p b ON b.cx = a.cx + dx AND b.cy = a.cy + dy AND {_NEAR}"""


@register("dq_dbscan_noise", with_(
    PLANT, DQF,
    "st AS (SELECT avg(vibration_rms) AS mx, stddev_pop(vibration_rms) AS sx, avg(temp_c) AS my, stddev_pop(temp_c) AS sy FROM dqf)",
    "z AS (SELECT (vibration_rms - mx) / sx AS x, (temp_c - my) / sy AS y FROM dqf, st WHERE vibration_rms IS NOT NULL AND temp_c IS NOT NULL)",
    f"p AS (SELECT x, y, count(*) AS w, floor(x / {DBSCAN_EPS}) AS cx, floor(y / {DBSCAN_EPS}) AS cy FROM z GROUP BY x, y)",
    f"n AS (SELECT a.x, a.y, a.w, a.cx, a.cy, sum(b.w) >= 5 AS core FROM p {_PAIRS} GROUP BY ALL)",
    f"b AS (SELECT DISTINCT a.x, a.y FROM (SELECT * FROM n WHERE NOT core) {_PAIRS.replace('JOIN p b', 'JOIN (SELECT * FROM n WHERE core) b')})",
) + """SELECT CAST(sum(w) AS BIGINT) AS rows, CAST(sum(w) FILTER (WHERE core) AS BIGINT) AS core_points,
  CAST(coalesce(sum(w) FILTER (WHERE NOT core AND b.x IS NOT NULL), 0) AS BIGINT) AS border_points,
  CAST(coalesce(sum(w) FILTER (WHERE NOT core AND b.x IS NULL), 0) AS BIGINT) AS noise_points
FROM n LEFT JOIN b ON n.x = b.x AND n.y = b.y""")
def dq_dbscan_noise(spark, sf):
    """V8: core, border and noise rows of DBSCAN on vibration and temperature, with a small eps."""
    points = dbscan.points_of(dq_frame(spark, sf), "vibration_rms", "temp_c", DBSCAN_EPS)
    return dbscan.counts(dbscan.label(points, DBSCAN_EPS, dbscan.MIN_POINTS))


@register("dq_dbscan")
def dq_dbscan(spark, sf):
    """V8: DBSCAN (eps 0.8, 5 points) on standardised vibration and temperature: noise points and clusters."""
    return dbscan.summary(dq_frame(spark, sf), "vibration_rms", "temp_c")


@register("dq_report")
def dq_report(spark, sf):
    """The 16-check data-quality report (rows-only check)."""
    p = td.plant_rows(spark, sf)
    return dq.report(p, order=ROW_ORDER, key=["l_orderkey", "l_linenumber", "l_partkey"])


@register("dq_summary")
def dq_summary(spark, sf):
    """Pass / warn / fail / info counts of the report."""
    p = td.plant_rows(spark, sf)
    rep = dq.report(p, order=ROW_ORDER, key=["l_orderkey", "l_linenumber", "l_partkey"])
    return dq.report_summary(rep)
