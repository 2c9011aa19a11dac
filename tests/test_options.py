"""Options of the operators, against plain Python."""

import math
import warnings
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import anomaly, canonical, conformance, models, queues, simulate
from pathloom.sources import logs

T0 = datetime(2024, 1, 1, 8)


def intervals(spark, rows):
    data = [(f"c{i}", s, T0 + timedelta(minutes=a), T0 + timedelta(minutes=b), (b - a) * 1.0) for i, (s, a, b) in enumerate(rows)]
    return spark.createDataFrame(data, "case_id string, state string, start_time timestamp_ntz, end_time timestamp_ntz, duration_minutes double")


def plain_samples(rows, freq, start, end):
    lo = T0 + timedelta(minutes=min(a for _, a, _ in rows)) if start is None else start
    hi = T0 + timedelta(minutes=max(b for _, _, b in rows)) if end is None else end
    out, at = {}, lo
    while at <= hi:
        for s in {s for s, _, _ in rows}:
            out[s, at] = sum(T0 + timedelta(minutes=a) <= at < T0 + timedelta(minutes=b) for t, a, b in rows if t == s)
        at += timedelta(minutes=freq)
    return out


@pytest.mark.parametrize("freq", ["5min", "15min", "1h"])
@pytest.mark.parametrize("span", [(None, None), ("2024-01-01 07:30:00", None), ("2024-01-01 09:07:00", "2024-01-02 11:00:00"), (None, "2024-01-01 08:20:00"), ("2024-01-07 00:00:00", "2024-01-07 02:00:00")])
def test_samples_of_a_grid_with_ends(spark, freq, span):
    rows = [("A", 3, 50), ("A", 3, 20), ("A", 20, 21), ("B", 60, 1700), ("A", 1500, 1501.5), ("C", 2000, 2880), ("C", 2000, 2000.25), ("B", 90, 105)]
    got = queues.sampled(intervals(spark, rows), freq, *span)
    start, end = (datetime.fromisoformat(x) if x else None for x in span)
    assert {(r.state, r.timestamp): r.queue_length for r in got.collect()} == plain_samples(rows, queues.MINUTES[freq], start, end)


def test_samples_of_nothing(spark):
    assert queues.sampled(intervals(spark, [("A", 1, 2)]).where("false")).count() == 0


def test_queue_pipeline_takes_the_other_case_column_and_sorts(spark):
    rows = [("v", "A", T0, 0), ("v", "B", T0 + timedelta(minutes=5), 1), ("v", "C", T0 + timedelta(minutes=25), 2)]
    log = spark.createDataFrame(rows, "visit_id string, activity string, timestamp timestamp_ntz, _seq long")
    out = queues.run_queue_mining(log)
    assert [r.state for r in out["summary"].collect()] == ["B", "A"]
    with pytest.raises(KeyError):
        queues.run_queue_mining(log.withColumnRenamed("visit_id", "x"))


def test_report_names_the_settings_for_unstable_columns(spark):
    log = spark.createDataFrame([("c", "A", T0, 0, 1)], "case_id string, activity string, timestamp timestamp_ntz, _seq long, v int")
    cfg = canonical.CanonicalConfig(unstable_columns=("v", "absent"), unstable_missing_mode="drop_rows", unstable_case_missing_threshold=0.5)
    r = canonical.report(log, cfg).first()
    assert (r.unstable_columns_used, r.unstable_missing_mode, r.unstable_case_missing_threshold) == ("v", "drop_rows", 0.5)


def test_conformance_summary_is_sorted(spark):
    rows = [("exact", False, "extra")] * 2 + [("exact", True, "none")] + [("exact", False, "missing")] * 3
    got = conformance.summary(spark.createDataFrame(rows, "mode string, conforms boolean, deviation_type string"))
    assert [r.deviation_type for r in got.collect()] == ["none", "missing", "extra"]


def test_severity_order_and_double_labels(spark):
    rows = [("a", False, 9.0, 1.0, 1), ("b", True, 1.0, 1.0, 1), ("c", True, 2.0, 1.0, 1), ("d", True, 2.0, 1.0, 3)]
    found = spark.createDataFrame(rows, "case_id string, red_flag boolean, combined_score double, case_total_minutes double, trace_length int")
    assert [r.case_id for r in anomaly.by_severity(found).collect()] == ["d", "c", "b", "a"]
    assert logs.duplicate_labels({"x": "one", " X ": "two", "y": "three"}) == ["x"]
    log = spark.createDataFrame([("c", "X", T0, 0)], "case_id string, activity string, timestamp timestamp_ntz, _seq long")
    with pytest.warns(UserWarning, match="x"):
        assert logs.relabel(log, {"x": "one", " X ": "two"}).first().activity == "two"
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        logs.relabel(log, {"x": "one"})


def test_anomalies_of_an_empty_log_and_of_quotes(spark):
    schema = "case_id string, activity string, timestamp timestamp_ntz, _seq long"
    assert anomaly.detect(spark.createDataFrame([], schema)).count() == 0
    names = ["it's", "a\\b", 'say "x"', "it's"]
    rows = [(f"c{i % 3}", names[i % 4], T0 + timedelta(minutes=i), i) for i in range(30)]
    got = anomaly.bigram_nll(spark.createDataFrame(rows, schema), anomaly.AnomalyConfig(vocabulary=2))
    traces = {c: ["__START__", *[a if a in ("it's", "a\\b") else "__UNK__" for k, a, _, _ in rows if k == c], "__END__"] for c in ("c0", "c1", "c2")}
    pairs = [p for t in traces.values() for p in zip(t, t[1:], strict=False)]
    cost = {p: -math.log((pairs.count(p) + 1) / (sum(q[0] == p[0] for q in pairs) + 4)) for p in pairs}
    want = {c: sum(cost[p] for p in zip(t, t[1:], strict=False)) / (len(t) - 1) for c, t in traces.items()}
    assert {r.case_id: r.seq_score for r in got.collect()} == pytest.approx(want)


# -- sources -----------------------------------------------------------------

def test_file_order_of_one_file_and_of_ten(spark, tmp_path):
    lines = [f"{i % 7},A{i},2024-01-01 00:00:00" for i in range(1000)]
    for name, n in (("one", 1), ("ten", 10)):
        (tmp_path / name).mkdir()
        for k in range(n):
            part = lines[k * 1000 // n : (k + 1) * 1000 // n]
            (tmp_path / name / f"part-{k:02d}.csv").write_text("\n".join(["case,what,at", *part]) + "\n")
    got = []
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for name in ("one", "ten"):
            log, meta = logs.build_event_log(logs.read_csv(spark, str(tmp_path / name)), logs.ColumnMapping("case", "what", "at"))
            got.append({r.activity: r._seq for r in log.collect()})
            assert meta["n_rows"] == 1000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == got[1] == {f"A{i}": i for i in range(1000)}
    assert logs.file_order(spark.range(3)).columns == ["id", "_seq"]


def test_build_event_log_options(spark):
    rows = [("b", "x", "2024-01-02T10:00:00+02:00", "r"), ("a", "y", "2024-01-01 00:00:00", None), (None, "z", "2024-01-01", "r")]
    df = spark.createDataFrame(rows, "id string, what string, at string, who string")
    mapping = logs.ColumnMapping("id", "what", "at", "who")
    log, meta = logs.build_event_log(df, mapping, utc=True, sort_by_time=True, standard_names={"case_id": "visit", "resource": "by"})
    assert log.columns == ["visit", "activity", "timestamp", "by", "_seq"]
    assert [(r.visit, r.timestamp) for r in log.collect()] == [("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 2, 8))]
    assert meta["n_rows"] == 2 and meta["renamed"]["id"] == "visit" and meta["mapping"]["timestamp"] == "at"
    assert logs.build_event_log(df, mapping, drop_missing_core=False)[1]["n_rows"] == 3
    bad = df.unionByName(spark.createDataFrame([("c", "x", f"never {i}", None) for i in range(20)] + [("c", "x", None, None)], df.schema))
    with pytest.raises(ValueError, match="never") as error:
        logs.build_event_log(bad, mapping)
    assert str(error.value).count("never") + str(error.value).count("None") == 10
    assert logs.build_event_log(bad, mapping, errors="coerce")[1]["n_rows"] == 2
    with pytest.raises(ValueError):
        logs.build_event_log(df, mapping, errors="ignore")


# -- models ------------------------------------------------------------------

def cases(spark, n=400):
    rng = np.random.default_rng(4)
    x, z = rng.normal(5, 2, n), rng.normal(0, 1, n)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(x - 5 + z)))).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))], "k long, x double, z double, y int"), x, z, y


def test_split_gives_each_class_its_quarter(spark):
    rows = [(i, c) for c, n in (("a", 1000), ("b", 37), ("c", 5), ("d", 1), (None, 8)) for i in range(n)]
    df = spark.createDataFrame([(f"{c}{i}", c) for i, c in rows], "k string, c string")
    train, test = models.split(df, "k", by="c")
    assert test.columns == df.columns and train.count() + test.count() == len(rows)
    got = {r.c: r["count"] for r in test.groupBy("c").count().collect()}
    assert got == {"a": 250, "b": 10, "c": 2, None: 2}
    assert models.split(df, "k")[1].count() == pytest.approx(len(rows) / 4, abs=1)


def solved(x, z, y, weights, logistic):
    a = np.column_stack([np.ones(len(x)), x / x.std(ddof=1), z / z.std(ddof=1)])
    beta, penalty = np.zeros(3), np.diag([1e-9, 1, 1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ beta)) if logistic else a @ beta
        h = (a * (weights * (p * (1 - p) if logistic else 1))[:, None]).T @ a + penalty
        beta = beta - np.linalg.solve(h, a.T @ (weights * (p - y)) + penalty @ beta)
    at = beta @ np.array([1, 6 / x.std(ddof=1), 0.5 / z.std(ddof=1)])
    return 1 / (1 + np.exp(-at)) if logistic else at


@pytest.mark.parametrize("task", ["binary", "regression"])
def test_refit_of_linear_models_equals_a_plain_solver(spark, task):
    from test_ranks import plain_weight

    df, x, z, y = cases(spark)
    got = models.bootstrap_refit(df, ["x", "z"], "k", {"x": 6.0, "z": 0.5}, n_boot=21, task=task).first()
    draws = [solved(x, z, y, np.array([plain_weight(k, b) for k in range(len(x))]), task == "binary") for b in range(21)]
    want = [solved(x, z, y, np.ones(len(x)), task == "binary"), *np.quantile(draws, [0.025, 0.975])]
    assert [got.estimate, got.ci_low, got.ci_high] == pytest.approx(want, rel=1e-6)


def test_refit_of_forests_is_a_probability(spark):
    df, *_ = cases(spark, 120)
    got = models.bootstrap_refit(df, ["x", "z"], "k", {"x": 9.0, "z": 1.0}, n_boot=3, task="binary", model_type="rf", trees=4).first()
    assert 0.5 < got.estimate <= 1 and 0 <= got.ci_low <= got.ci_high <= 1
    with pytest.raises(ValueError):
        models.bootstrap_refit(df.limit(10), ["x"], "k", {})


def test_forests_of_any_depth(spark):
    # Runs of ever fewer equal labels: each level of a tree cuts one off.
    rows = [(float(i), int(i % 2), 1) for i in range(24) for _ in range(2 ** min(i, 7))]
    df = spark.createDataFrame(rows, "x double, y int, k int")
    right = {d: models.predict(models.train(df, ["x"], model_type="rf", trees=1, depth=d), df).where("y_pred = y").count() / len(rows) for d in (2, models.DEPTH)}
    assert right[models.DEPTH] > 0.95 > right[2]


def test_posterior_with_covariates_agrees_with_the_grid_and_the_truth(spark):
    rng = np.random.default_rng(0)
    n = 3000
    x = rng.normal(size=n)
    t = np.exp(2 + 0.7 * x) * rng.weibull(1.5, size=n)
    end = np.exp(3.0)
    df = spark.createDataFrame([(float(min(a, end)), int(a <= end), float(b)) for a, b in zip(t, x, strict=True)], "duration_min double, observed int, x double")
    got = simulate.posterior_with_covariates(df, ["x"], 300, 100).agg(F.avg("mu").alias("m"), F.avg("kappa").alias("k"), F.avg("beta_x").alias("b"), F.count_distinct("mu").alias("n")).first()
    assert got.m == pytest.approx(2, abs=0.06) and got.k == pytest.approx(1.5, abs=0.08) and got.b == pytest.approx(0.7, abs=0.05) and got.n > 200
    grid = simulate.posterior_means(simulate.posterior(df, simulate.Grid(mu_reach=1.0, kappa_step=0.02, kappas=150))).first()
    none = simulate.posterior_with_covariates(df, [], 600, 200).agg(F.avg("mu").alias("m"), F.avg("kappa").alias("k")).first()
    assert (none.m, none.k) == pytest.approx((grid.mu_mean, grid.kappa_mean), abs=0.02)


# -- plans -------------------------------------------------------------------

def test_plans_hold_few_exchanges_and_no_group_in_one_task(spark, sf):
    from pathloom.plans import analytics, views

    def planned(make):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return make()._jdf.queryExecution().executedPlan().toString().split("\n")
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")

    shuffles = lambda plan: [x for x in plan if "Exchange " in x and "Reused" not in x and "Broadcast" not in x]
    sampled = planned(lambda: queues.sampled(analytics.intervals(spark, sf)))
    assert len(shuffles(sampled)) <= 4
    waits = planned(lambda: queues.wait_summary(analytics.intervals(spark, sf)))
    assert not any(" percentile(" in x for x in waits) and len(shuffles(waits)) <= 5
    scores = planned(lambda: anomaly.detect(views.log_day(spark, sf), analytics.ANOMALY))
    assert not shuffles(scores) and not any("NestedLoop" in x for x in scores)


@pytest.mark.parametrize("task", ["binary", "regression"])
def test_linear_models_equal_a_plain_solver(spark, task):
    df, x, z, y = cases(spark)
    profile = spark.createDataFrame([(6.0, 0.5)], "x double, z double")
    got = models.predict(models.train(df, ["x", "z"], task), profile).first()
    want = solved(x, z, y, np.ones(len(x)), task == "binary")
    assert (got.y_score if task == "binary" else got.y_pred) == pytest.approx(want, rel=2e-3)


def test_a_model_reads_its_cases_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    kind = "case_id long, x double, y int"
    rows = spark.range(400).selectExpr("id AS case_id", "CAST(id % 37 AS DOUBLE) AS x", "CAST(id % 37 > 17 AS INT) AS y").mapInPandas(count, kind)
    assert models.evaluate(rows, ["x"], "case_id").first().accuracy > 0.8
    assert seen.value == 400
