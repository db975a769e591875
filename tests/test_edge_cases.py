"""Hand-made edge fixtures with literal expected values (FIXTURES.md section 5) and invariants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millwright.functions.quantiles import exact_quantiles
from millwright.operators import clean, dq, finance, forecast, joins, maintenance, mapping, oee, quality
from millwright.operators import downtime as dtm
from millwright.operators.ml import cluster, iforest


def _one(df):
    return df.first().asDict()


def test_planned_zero_gives_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 100.0, 90.0)], "planned_time_min double, downtime_minutes double, ideal_rate double, total_count double, good_count double")
    r = _one(oee.rows(df))
    assert r["availability"] == 0.0 and r["oee"] == 0.0


def test_downtime_over_planned_and_good_over_total(spark):
    df = spark.createDataFrame([(480.0, 500.0, 10.0, 100.0, 120.0)], "planned_time_min double, downtime_minutes double, ideal_rate double, total_count double, good_count double")
    r = _one(oee.rows(df))
    assert r["run_time_min"] == 0.0 and r["performance"] == 0.0 and r["quality"] == 1.0
    rules = {x["rule"]: x["violations"] for x in dq.domain_rules(df).collect()}
    assert rules["downtime exceeds planned time"] == 1 and rules["good count > total count"] == 1


def test_performance_cap(spark):
    df = spark.createDataFrame([(100.0, 0.0, 1.0, 200.0, 200.0)], "planned_time_min double, downtime_minutes double, ideal_rate double, total_count double, good_count double")
    r = _one(oee.rows(df))
    assert r["performance"] == 1.5 and r["loss_performance"] == 0.0


def test_ideal_null_and_defaults(spark):
    df = spark.createDataFrame([(480.0, 0.0, None, 100.0, 100.0)], "planned_time_min double, downtime_minutes double, ideal_rate double, total_count double, good_count double")
    assert _one(oee.rows(df))["performance"] == 0.0
    bare = spark.createDataFrame([(100.0,)], "total_count double")
    r = _one(oee.prepare(bare))
    assert r["planned_time_min"] == 480.0 and r["ideal_rate"] == 10.0 and r["good_count"] == 100.0


def test_event_class_unplanned_text_is_unplanned(spark):
    df = spark.createDataFrame([("Unplanned", 5.0), ("planned stop", 3.0)], "event_class string, downtime_minutes double")
    got = [r["is_planned"] for r in maintenance.classify(df).collect()]
    assert got == [False, True]


def test_null_cause_kept_null_machine_dropped(spark):
    df = spark.createDataFrame([(None, "M1", 10.0), ("A", None, 5.0)], "downtime_code string, machine_id string, downtime_minutes double")
    causes = {r["cause"] for r in dtm.pareto(df).collect()}
    assert causes == {None, "A"}
    assert [r["machine_id"] for r in dtm.chronic_machines(df).collect()] == ["M1"]


def test_machine_on_two_lines_and_single_event(spark):
    ts = dt.datetime(2024, 1, 1)
    rows = [(1, "M1", "L1", ts, 10.0, False), (2, "M1", "L2", ts, 20.0, False), (3, "M1", "L2", ts + dt.timedelta(hours=2), 5.0, True)]
    df = spark.createDataFrame(rows, "event_id long, machine_id string, line_id string, start_time timestamp, downtime_minutes double, is_planned boolean")
    risk = {(r["machine_id"], r["line_id"]): r for r in maintenance.asset_risk(df).collect()}
    assert set(risk) == {("M1", "L1"), ("M1", "L2")}
    assert risk[("M1", "L1")]["mtbf_min"] is None
    assert risk[("M1", "L2")]["mtbf_min"] == pytest.approx(max(120.0 - 12.5, 0.0))
    rem = maintenance.remaining_risk(df, top_n=None)
    assert rem.count() == 2


def test_all_assets_equal_score_zero(spark):
    rows = [(i, f"M{i}", "L1", 10.0, False) for i in range(4)]
    df = spark.createDataFrame(rows, "event_id long, machine_id string, line_id string, downtime_minutes double, is_planned boolean")
    scores = {r["rule_score"] for r in maintenance.asset_risk(df).collect()}
    assert scores == {20.0}  # norms 0, unplanned share 1 -> 20


def test_string_cleaning(spark):
    df = spark.createDataFrame([(" 12 ",), ("nan",), ("None",), ("",)], "good_count string")
    got = [r["good_count"] for r in clean.coerce_by_name(clean.clean_strings(df)).collect()]
    assert got == [12.0, None, None, None]


def test_two_duplicates_one_removed(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "machine_id string, downtime_minutes double")
    log = _one(clean.clean_log(df))
    assert (log["rows_in"], log["duplicates_removed"], log["rows_out"]) == (3, 1, 2)


def test_spc_and_cpk_not_ok_on_small_inputs(spark):
    rows = [(dt.date(2024, 1, d), "A", "L1", 1.0, 10.0 + d / 100, 9.5, 10.5) for d in range(1, 5)]
    df = spark.createDataFrame(rows, "shift_date date, shift string, line_id string, reject_count double, measurement_mm double, lsl double, usl double")
    df = df.withColumn("total_count", F.lit(100.0))
    assert quality.spc_plant(df).count() == 0
    assert _one(quality.cpk_plant(df))["ok"] is False
    bad = spark.createDataFrame([(10.0, 10.5, 9.5)] * 12, "measurement_mm double, lsl double, usl double")
    assert "USL <= LSL" in _one(quality.cpk_plant(bad))["reason"]


def test_rates_default_on_bad_values():
    r = finance.normalize_rates({"plant_usd_per_hour": -5, "line_usd_per_hour": {"L1": "text"}})
    assert r["plant_usd_per_hour"] == 850.0 and r["line_usd_per_hour"]["L1"] == 850.0


def test_empty_downtime_gives_empty_results(spark):
    df = spark.createDataFrame([], "event_id long, machine_id string, line_id string, downtime_code string, downtime_minutes double, is_planned boolean")
    assert dtm.pareto(df).count() == 0
    assert maintenance.asset_risk(df).count() == 0


def test_sap_headers_resolve(spark):
    names = ["WERKS", "ARBPL", "EQUNR", "BUDAT", "SCHICHT", "VGW02", "ISTDZ", "GAMNG", "LMNGA", "XMNGA"]
    m = {r["canonical"]: r["header"] for r in mapping.suggest_mapping(spark.createDataFrame([(n,) for n in names], "header string")).collect()}
    assert m["line_id"] == "ARBPL" and m["machine_id"] == "EQUNR" and m["shift_date"] == "BUDAT"
    assert len(set(m.values())) == len(m)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), rng.integers(0, 5, 800).astype(float)])
    df = spark.createDataFrame([(float(v), "g" + str(i % 3)) for i, v in enumerate(vals)], "v double, g string")
    got = exact_quantiles(df, {"v": F.col("v")}, [0.1, 0.5, 0.9], accuracy=20)["v"]
    assert got == pytest.approx(list(np.quantile(vals, [0.1, 0.5, 0.9])), abs=0, rel=1e-12)
    parts = {k: F.when(F.col("g") == k, F.col("v")) for k in ("g0", "g1", "g2")}
    per = exact_quantiles(df, parts, [0.25])
    for k in parts:
        sub = vals[[i for i in range(len(vals)) if "g" + str(i % 3) == k]]
        assert per[k][0] == pytest.approx(float(np.quantile(sub, 0.25)), rel=1e-12)


def test_exact_quantiles_ties_ends_and_nothing(spark):
    two = [480.0] * 500 + [500.0] * 500  # the median lies between two heavy values
    rows = [(v, float("nan") if i % 2 else None, float(i % 7), 3.5) for i, v in enumerate(two)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    probs = [0.0, 0.3, 0.5, 1.0]
    got = exact_quantiles(df, {c: F.col(c) for c in "abcd"}, probs, accuracy=10)
    assert got["a"] == [480.0, 480.0, 490.0, 500.0] and got["b"] == [None] * 4 and got["d"] == [3.5] * 4
    assert got["c"] == pytest.approx(list(np.quantile([i % 7 for i in range(1000)], probs)))
    assert exact_quantiles(df, {}, probs) == {}


def _days(spark, machines=4, days=25):
    """(machine, day) features with a scrap rate that follows the day before; one machine's last day is incomplete."""
    rng = np.random.default_rng(11)
    rows = []
    for m in range(machines):
        x = rng.uniform(0.01, 0.2, days)
        for d in range(1, days):
            feats = [float(x[d - 1])] + [float(v) for v in rng.uniform(size=8)]
            rows.append((f"M{m}", dt.date(2024, 1, 1) + dt.timedelta(days=d), float(x[d - 1] / 2), *feats))
    schema = "machine_id string, shift_date date, target double, " + ", ".join(f"{c} double" for c in forecast.FEATURES)
    feat = spark.createDataFrame(rows, schema)
    last = [r for r in rows if r[1] == dt.date(2024, 1, days)]
    last[0] = last[0][:4] + (None,) + last[0][5:]
    return feat, spark.createDataFrame(last, schema)


def test_rate_model_is_the_same_for_any_partitioning(spark):
    feat, _ = _days(spark)
    a, b = (forecast.rate_model(feat.repartition(n), trees=10, depth=4) for n in (4, 16))
    assert a[1] == b[1] and forecast.feature_importance(a[0]) == forecast.feature_importance(b[0])
    assert forecast.feature_importance(a[0])[0][0] == "prev_target" and a[1] < 0.02


def test_rate_tuning_runs_every_trial(spark):
    feat, _ = _days(spark)
    _, error, rows = forecast.rate_tuning(feat, n_trials=3)
    assert len({r[:3] for r in rows}) == 3 and error < 0.05
    for r in rows:
        assert all(lo <= v <= hi for v, (lo, hi) in zip(r, forecast.SEARCH.values()))


def test_rate_forecast_lists_every_machine(spark):
    feat, latest = _days(spark)
    model, _ = forecast.rate_model(feat, trees=10, depth=4)
    rows = {r["machine_id"]: r for r in forecast.rate_forecast(latest, feat, model).collect()}
    assert sorted(rows) == ["M0", "M1", "M2", "M3"]
    assert rows["M0"]["forecast"] is None and rows["M0"]["reason"] and rows["M0"]["recent_mean"] is not None
    assert all(rows[m]["forecast"] is not None and rows[m]["reason"] is None for m in ("M1", "M2", "M3"))


def test_stitched_lag_equals_plain_lag(spark):
    rng = np.random.default_rng(3)
    rows = [(f"M{int(m)}", dt.date(2024, 1, int(d)), int(i), float(v)) for i, (m, d, v) in
            enumerate(zip(rng.integers(0, 3, 400), rng.integers(1, 20, 400), rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "machine_id string, shift_date date, k long, x double")
    got = {r["k"]: r["_prev_x"] for r in dq.lag_stitched(df, "machine_id", "shift_date", ["k"], ["x"]).collect()}
    w = Window.partitionBy("machine_id").orderBy("shift_date", "k")
    want = {r["k"]: r["p"] for r in df.withColumn("p", F.lag("x").over(w)).collect()}
    assert got == want


def test_mtbf_telescoped_equals_mean_gap(spark):
    ts = dt.datetime(2024, 1, 1)
    offs = {"M1": [0, 30, 100, 160], "M2": [5, 50]}
    rows = [(m, ts + dt.timedelta(minutes=o), 10.0) for m, os_ in offs.items() for o in os_]
    df = spark.createDataFrame(rows, "machine_id string, start_time timestamp, downtime_minutes double")
    gaps = [30, 70, 60, 45]
    r = _one(dtm.mtbf_gaps(df))
    assert r["gaps"] == 4 and r["mean_interarrival_min"] == pytest.approx(np.mean(gaps))


def test_iforest_contamination_and_partition_invariance(spark, sf):
    from millwright.sources import testdata as td

    key = ["l_orderkey", "l_linenumber", "l_partkey", "total_count"]
    p = td.plant_rows(spark, sf).select(*key, "vibration_rms", "temp_c", "motor_current_a")
    feats = ["vibration_rms", "temp_c", "motor_current_a"]
    a = iforest.fit_score(p, feats, key)
    b = iforest.fit_score(p.repartition(7), feats, key)
    n = a.count()
    flagged = a.where("anomaly").count()
    assert abs(flagged - 0.08 * n) <= 0.01 * n
    ka = {tuple(r[:4]): round(r[4], 12) for r in a.select(*key, "anomaly_score").collect()}
    kb = {tuple(r[:4]): round(r[4], 12) for r in b.select(*key, "anomaly_score").collect()}
    assert ka == kb


def test_stitched_lag_two_block_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(f"M{int(m)}", dt.date(2024, 1, int(d)), "ABC"[int(s)], int(i), float(v)) for i, (m, d, s, v) in
            enumerate(zip(rng.integers(0, 2, 500), rng.integers(1, 8, 500), rng.integers(0, 3, 500), rng.normal(size=500)))]
    df = spark.createDataFrame(rows, "machine_id string, shift_date date, shift string, k long, x double")
    got = {r["k"]: r["_prev_x"] for r in dq.lag_stitched(df, "machine_id", ["shift_date", "shift"], ["k"], ["x"]).collect()}
    w = Window.partitionBy("machine_id").orderBy("shift_date", "shift", "k")
    want = {r["k"]: r["p"] for r in df.withColumn("p", F.lag("x").over(w)).collect()}
    assert got == want


def test_jumps_by_range_where_one_block_holds_half_of_the_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(6000):
        hot = k % 2 == 0
        m = "M1" if hot else (f"M{int(rng.integers(0, 40))}" if k % 7 else None)
        x = None if k % 11 == 0 else float(rng.normal() + 100 * (rng.random() < 0.01))
        rows.append((m, dt.date(2024, 1, 1 if hot else int(rng.integers(1, 28))), "A" if hot else "ABC"[k % 3], k, x, float(rng.integers(0, 3))))
    df = spark.createDataFrame(rows, "machine_id string, shift_date date, shift string, k long, rate double, part double").repartition(5)
    order, cols = ["shift_date", "shift", "k"], ["rate", "part"]
    ranges = [r["count"] for r in dq._ranged(df, ["machine_id", *order], 8)[0].groupBy("_p").count().collect()]
    assert len(ranges) == 8 and max(ranges) < 1.6 * sum(ranges) / 8  # the hot block is several tasks
    w = Window.partitionBy("machine_id").orderBy(*order)
    lagged = df.select("k", *cols, *[F.lag(c).over(w).alias(f"_prev_{c}") for c in cols]).collect()
    sd = {c: 5 * np.std([r[c] for r in lagged if r[c] is not None], ddof=1) for c in cols}
    want = {c: sum(r[c] is not None and r[f"_prev_{c}"] is not None and abs(r[c] - r[f"_prev_{c}"]) > sd[c] for r in lagged) for c in cols}
    assert want["rate"] > 20
    for n in (1, 8, 61):
        assert {r["column_name"]: r["jumps"] for r in dq.jumps(df, order, "machine_id", "shift_date", cols, partitions=n).collect()} == want
        got = {r["k"]: (r["_prev_rate"], r["_prev_part"]) for r in dq.lag_stitched(df, "machine_id", ["shift_date", "shift"], ["k"], cols, n).collect()}
        assert got == {r["k"]: (r["_prev_rate"], r["_prev_part"]) for r in lagged}
    assert {r["column_name"]: r["jumps"] for r in dq.jumps(df.limit(0), order, "machine_id", "shift_date", cols).collect()} == dict.fromkeys(cols, 0)


def test_plant_safe_keys_missing_on_one_side(spark):
    keys = "machine_id string, line_id string, shift_date date, shift string"
    day = dt.date(2024, 1, 1)
    p = spark.createDataFrame([("M1", "L", day, "A", 1.0), ("M2", "L", day, "A", 2.0), (None, "L", day, "B", 3.0), ("M4", "L", day, "A", 4.0)], keys + ", total_count double")
    q = spark.createDataFrame([("M1", "L", day, "A", 5, "DIM", 1.0), ("M1", "L", day, "A", 6, "CUT", 2.0), (None, "L", day, "B", 7, None, 3.0), ("M9", "L", day, "A", 9, "X", 9.0)],
                              keys + ", good_count long, defect_code string, measurement_mm double")
    d = spark.createDataFrame([("M2", "L", "2024-01-01", "A", 3.0), (None, "L", "2024-01-01", "B", 4.0), (None, "L", "2024-01-01", "B", 1.0), ("M1", "L", "no day", "A", 8.0)],
                              "machine_id string, line_id string, shift_date string, shift string, downtime_minutes double")
    got = {r["total_count"]: (r["machine_id"], r["good_count"], r["defect_code"], r["measurement_mm"], r["downtime_minutes"]) for r in joins.plant_safe(p, q, d).collect()}
    assert got == {1.0: ("M1", 11, "CUT", 1.5, 0.0), 2.0: ("M2", None, None, None, 3.0), 3.0: (None, 7, None, 3.0, 5.0), 4.0: ("M4", None, None, None, 0.0)}
    plan = joins.plant_safe(p, q, d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and plan.count("Aggregate") == 1


def test_extremes_ties_go_to_the_smaller_key(spark):
    rows = [(line, "M" + line, "A", 480.0, 48.0, 10.0, 100.0, 90.0) for line in ("L2", "L1", "L3")]
    df = spark.createDataFrame(rows, "line_id string, machine_id string, shift string, planned_time_min double, downtime_minutes double, "
                                     "ideal_rate double, total_count double, good_count double")
    r = _one(oee.extremes(df))
    assert (r["worst_line"], r["best_line"], r["worst_machine"]) == ("L1", "L1", "ML1")


def test_killer_line_ties_go_to_the_smaller_line(spark):
    rows = [(dt.date(2024, 1, 1), line, 100.0, 95.0) for line in ("L2", "L1")]
    df = spark.createDataFrame(rows, "shift_date date, line_id string, total_count double, good_count double")
    r = _one(quality.killer_line(df))
    assert (r["worst_line"], r["best_line"], r["worst_scrap_rate"]) == ("L1", "L1", 0.05)


def test_pca_drift_ignores_constant_columns(spark):
    rng = np.random.default_rng(11)
    rows = [(dt.date(2024, 1, 1 + i % 28), 0.1, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "shift_date date, flat double, a double, b double")
    with_flat = _one(cluster.pca_drift(df, ["flat", "a", "b"], "shift_date", n_comp=1))
    without = _one(cluster.pca_drift(df, ["a", "b"], "shift_date", n_comp=1))
    assert with_flat["pca_var_early"] == pytest.approx(without["pca_var_early"])
    assert with_flat["drift_score"] == pytest.approx(without["drift_score"])


def test_assoc_rules_named_columns_and_every_pair(spark):
    rows = [("x" if i % 2 else "y", "u" if i % 2 else "v", float(i), float(-i)) for i in range(100)]
    df = spark.createDataFrame(rows, "c1 string, c2 string, n1 double, n2 double")
    rules = {(r["a"], r["b"]): r["pair_count"] for r in dq.assoc_rules(df, cats=["c1", "c2"], nums=[]).collect()}
    assert rules == {("c1=x", "c2=u"): 50, ("c1=y", "c2=v"): 50}
    wide = spark.createDataFrame([tuple(["k"] * 10)] * 30, ", ".join(f"c{i} string" for i in range(10)))
    assert dq.assoc_rules(wide).count() == 45


def test_recent_events_without_dates_and_in_one_pass(spark):
    schema = "event_id long, machine_id string, line_id string, shift_date date, downtime_minutes double, is_planned boolean"
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 20), dt.date(2024, 1, 13), dt.date(2024, 1, 12), None]
    rows = [(i, f"M{i % 2}", None if i % 2 else "L1", d, 10.0 + i, False) for i, d in enumerate(days)]
    for data in (rows, [(*r[:3], None, *r[4:]) for r in rows], []):
        df = spark.createDataFrame(data, schema)
        want = {(r["machine_id"], r["line_id"]): (r["events_7d"], r["minutes_7d"]) for r in maintenance.events_recent(df).collect()}
        got = {(r["machine_id"], r["line_id"]): (r["events_7d"], r["minutes_7d"]) for r in maintenance.remaining_risk(df, top_n=None).collect()}
        assert got == {k: want.get(k, (0.0, 0.0)) for k in got} and set(want) <= set(got)


def test_cards_of_table_without_defect_codes(spark, sf):
    from millwright.operators import insights
    from millwright.sources import testdata as td

    c = insights.cards(td.plant_rows(spark, sf).drop("defect_code", "measurement_mm"), td.downtime(spark, sf))
    metrics = {r["metric"] for r in c.collect()}
    assert "synthesized" in metrics and "cpk" not in metrics and {"remaining_risk", "priority_score", "worst_scrap_rate"} <= metrics


def test_assoc_rules_against_counting_by_hand(spark):
    """More items than one long has bits, nulls, ties at the 90 % mark, an empty table."""
    from collections import Counter
    from itertools import combinations

    schema = ", ".join([*[f"c{k} string" for k in range(6)], "x double"])
    rows = [(*[None if (i + k) % 11 == 0 else f"v{(i * (k + 3) + i // 7) % 12}" for k in range(6)], float(i % 20)) for i in range(400)]
    got = {(r["a"], r["b"]): (r["pair_count"], r["baskets"]) for r in dq.assoc_rules(spark.createDataFrame(rows, schema), min_support=0.0, min_conf=0.0).collect()}
    mark = sorted(r[6] for r in rows)
    mark = mark[359] + 0.1 * (mark[360] - mark[359])
    baskets = [sorted([f"c{k}={v}" for k, v in enumerate(r[:6]) if v is not None] + (["x=HIGH"] if r[6] >= mark else [])) for r in rows]
    pairs = Counter(p for b in baskets for p in combinations(b, 2))
    n = sum(len(b) >= 2 for b in baskets)
    assert len({i for b in baskets for i in b}) > 62 and got == {p: (c, n) for p, c in pairs.items()}
    assert dq.assoc_rules(spark.createDataFrame([], schema)).count() == 0
