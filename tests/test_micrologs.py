"""Hand-made logs with results worked out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathloom.operators import anomaly, canonical, conformance, discovery, features, models, queues, simulate
from pathloom.schema import require_columns
from pathloom.sources import logs

T0 = datetime(2024, 1, 1, 8)


def log(spark, rows, unit="seconds"):
    data = [(c, a, T0 + timedelta(**{unit: t}) if t is not None else None, i) for i, (c, a, t) in enumerate(rows)]
    return spark.createDataFrame(data, "case_id string, activity string, timestamp timestamp_ntz, _seq bigint")


def seconds(df):
    return [(r.activity, int((r.timestamp - T0).total_seconds())) for r in df.orderBy("case_id", "_seq").collect()]


def test_terminal_is_pushed_and_later_events_are_lifted(spark):
    cfg = canonical.CanonicalConfig(terminal_steps=("T",))
    one = log(spark, [("c", "A", 1), ("c", "T", 2), ("c", "B", 3)])
    assert seconds(canonical.canonicalize(one, cfg)) == [("A", 1), ("T", 4), ("B", 4)]
    counts = canonical.report(one, cfg).first()
    assert (counts.terminal_reordered_cases, counts.monotonic_repairs_applied) == (1, 1)
    moved = canonical.CanonicalConfig(terminal_steps=("T",), resort_after_terminal=True)
    assert seconds(canonical.canonicalize(one, moved)) == [("A", 1), ("B", 3), ("T", 4)]


def test_tied_terminal_is_pushed(spark):
    cfg = canonical.CanonicalConfig(terminal_steps=("T",))
    assert seconds(canonical.canonicalize(log(spark, [("c", "T", 5), ("c", "A", 5)]), cfg)) == [("A", 5), ("T", 6)]


def test_midnight_step_goes(spark):
    rows = spark.createDataFrame(
        [("c", "A", datetime(2024, 1, 1), 0), ("c", "B", datetime(2024, 1, 1), 1)],
        "case_id string, activity string, timestamp timestamp_ntz, _seq bigint",
    )
    cfg = canonical.CanonicalConfig(step_rules=canonical.rules_from_lists(midnight=("A",)))
    assert [r.activity for r in canonical.canonicalize(rows, cfg).collect()] == ["B"]
    assert canonical.report(rows, cfg).first().dropped_midnight == 1


def test_unstable_cases_go_above_the_threshold(spark):
    rows = log(spark, [("x", "A", i) for i in range(3)] + [("y", "A", i) for i in range(4)])
    holes = rows.withColumn("v", F.when(F.col("timestamp") > F.lit(T0).cast("timestamp_ntz"), 1))
    cfg = canonical.CanonicalConfig(unstable_columns=("v",), unstable_missing_mode="drop_cases")
    assert {r.case_id for r in canonical.canonicalize(holes, cfg).collect()} == {"y"}


def test_empty_log_stays_empty(spark):
    empty = log(spark, [("c", None, 1)])
    assert canonical.canonicalize(empty, canonical.CanonicalConfig(terminal_steps=("T",))).count() == 0
    assert discovery.dfg_edges(empty).count() == 0
    assert queues.state_intervals(empty).count() == 0
    assert conformance.check(conformance.extract_traces(empty.limit(0)), "A -> B").count() == 0


def check(spark, trace, protocol, mode, **kw):
    rows = spark.createDataFrame([("c", trace)], "case_id string, trace array<string>")
    return conformance.check(rows, protocol, conformance.ConformanceConfig(mode=mode, **kw)).first()


def test_subsequence_skips_a_missing_step(spark):
    got = check(spark, ["A", "B", "C"], "A -> C -> B", "subsequence")
    assert (got.matched_positions, got.missing_steps, got.deviation_type) == ([0, 2], ["B"], "order_violation")
    assert check(spark, ["A", "C", "B"], "A -> D -> C", "subsequence").missing_steps == ["D"]


def test_prefix_and_exact(spark):
    short = check(spark, ["A", "B"], "A -> B -> C", "prefix")
    assert (short.missing_steps, short.deviation_type, short.first_deviation_index) == (["C"], "missing_steps", None)
    assert check(spark, ["A", "B"], "A -> B -> C", "exact").first_deviation_index == 2
    long = check(spark, ["A", "B", "X"], "A -> B", "prefix")
    assert (long.conforms, long.deviation_type, long.extra_events_count) == (True, "none", 1)
    assert check(spark, ["A", "B", "X"], "A -> B", "exact_with_extras").deviation_type == "extra_events"
    assert check(spark, ["X", "A", "B"], "A -> B", "exact_with_extras", contiguous_requires_start=True).conforms is False


def test_nested_modes(spark):
    traces = [["A", "B"], ["A", "B", "X"], ["X", "A", "B"], ["A", "X", "B"], ["B", "A"], []]
    order = ("exact", "prefix", "exact_with_extras", "subsequence")
    for trace in traces:
        found = [check(spark, trace, "A -> B", m).conforms for m in order]
        assert found == sorted(found)


def test_protocol_forms():
    assert conformance.parse_protocol("A -> B→ C ->") == ["A", "B", "C"]
    assert anomaly.parse_protocol("A, B ,C") == ["A", "B", "C"]
    with pytest.raises(ValueError):
        conformance.check(None, " -> ")


def test_collapsed_interval_keeps_the_last_of_a_run(spark):
    rows = log(spark, [("c", "A", 0), ("c", "A", 10), ("c", "B", 30)], "minutes")
    took = lambda cfg: sorted(r.duration_minutes for r in queues.state_intervals(rows, cfg).collect())
    assert took(queues.QueueConfig(collapse_consecutive_same_state=True)) == [20.0]
    assert took(queues.QueueConfig()) == [10.0, 20.0]


def test_departures_come_first(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    iv = spark.createDataFrame([("s", at(0), at(10)), ("s", at(5), at(10)), ("s", at(10), at(20))], "state string, start_time timestamp_ntz, end_time timestamp_ntz")
    points = [(r.delta, r.queue_length) for r in queues.change_points(iv).orderBy("timestamp", "delta", F.desc("queue_length")).collect()]
    assert points[2:5] == [(-1, 1), (-1, 0), (1, 1)] and points[-1] == (-1, 0)


def test_all_equal_scores_are_flagged(spark):
    rows = log(spark, [(c, a, i) for c in "wxyz" for i, a in enumerate("AB")])
    assert anomaly.detect(rows).where("seq_flag").count() == 4


def test_events_before_the_cutoff_are_no_target(spark):
    rows = log(spark, [("c", "A", 0), ("c", "PIA", 10), ("d", "A", 0), ("d", "PIA", 80)], "minutes")
    got = features.build_target(rows, "remaining_time_to_pia", cutoff_value=20)
    assert [(r.case_id, r.y) for r in got.collect()] == [("d", 60.0)]


def test_transition_times(spark):
    rows = log(spark, [("a", "S", 0), ("a", "E", 5), ("b", "S", 0), ("b", "X", 7), ("c", "E", 1)], "minutes")
    got = {r.case_id: (r.duration_min, r.observed) for r in simulate.transition_dataset(rows, "S", "E").collect()}
    assert got == {"a": (5.0, 1), "b": (7.0, 0)}


def test_settings_are_checked(spark):
    rows = log(spark, [("c", "A", 1)])
    with pytest.raises(KeyError):
        require_columns(rows, ["nope"])
    with pytest.raises(ValueError):
        discovery.dfg_view(rows, view_mode="ego")
    with pytest.raises(ValueError):
        simulate.scenario(rows, 0)
    with pytest.raises(ValueError):
        anomaly.cut(rows, "what")
    with pytest.raises(KeyError):
        simulate.transition("what")
    with pytest.raises(ValueError):
        simulate.simulate(rows, "triage_to_registration")


def test_csv_round_trip_and_mapping(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (2, "b", "not a time")], "id int, what string, at string")
    back = logs.read_csv(spark, logs.write_csv(rows, str(tmp_path / "x")))
    log_, meta = logs.build_event_log(back, logs.ColumnMapping("id", "what", "at", attributes=("what",)), errors="coerce")
    assert [r.activity for r in log_.collect()] == ["a"] and meta["attributes"] == []
    assert logs.mapping_template(back)["available_columns"] == ["id", "what", "at"]
    assert logs.preview(back, 1).count() == 1
    assert logs.is_numeric(back, "id") and not logs.is_numeric(back, "what")
    assert [r.value for r in logs.filter_options(back, "what").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="not a timestamp"):
        logs.build_event_log(back, logs.ColumnMapping("id", "what", "at"), errors="raise")[0].collect()


def test_properties_of_a_log(spark, sf):
    from pathloom.plans import views

    rows = views.log(spark, sf)
    edges = discovery.dfg_edges(rows).agg(F.sum("count")).first()[0]
    assert edges == rows.count() - rows.select("case_id").distinct().count()
    points = queues.change_points(queues.state_intervals(rows))
    assert points.agg(F.min("queue_length")).first()[0] >= 0
    assert {r[0] for r in points.groupBy("state").agg(F.sum("delta")).select("sum(delta)").collect()} == {0}
    shuffled = rows.repartition(7).orderBy(F.rand(1))
    assert sorted(map(tuple, discovery.dfg_edges(shuffled).collect())) == sorted(map(tuple, discovery.dfg_edges(rows).collect()))


def test_rows_without_a_case_are_counted_apart(spark):
    rows = log(spark, [("c", "A", 1), (None, "A", 2), ("c", None, 3), (None, None, None), ("c", "B", None)])
    cfg = canonical.CanonicalConfig()
    assert seconds(canonical.canonicalize(rows, cfg)) == [("A", 1)]
    counts = canonical.report(rows, cfg).first()
    assert (counts.n_rows_in, counts.n_rows_out, counts.n_cases_in, counts.dropped_rows) == (5, 1, 1, 4)


def test_queue_pipeline_leaves_out_the_canonical_terminals(spark):
    rows = log(spark, [("c", "A", 0), ("c", "T", 60), ("c", "B", 120), ("c", "C", 180)])
    out = queues.run_queue_mining(rows, freq=None, canonical=canonical.CanonicalConfig(terminal_steps=("T",)))
    assert "T" not in [r.state for r in out["summary"].collect()] and out["report"].first().n_rows_in == 4


def test_fingerprints_count_repeated_rows(spark):
    a, b, c = ("x", "A", 1), ("x", "B", 2), ("x", "C", 3)
    table = lambda *rows: spark.createDataFrame(list(rows), "k string, a string, t int")
    key = lambda df: simulate.fingerprint(df, "s").first()[0]
    assert key(table(a, a, c)) != key(table(b, b, c)) and key(table(a, b, c)) == key(table(c, b, a))


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, float(i % 7), float(i % 3), float(2 * (i % 7) - (i % 3)), int(i % 7 > 3)) for i in range(400)]
    return spark.createDataFrame(rows, "k long, u double, v double, t double, c int")


def test_ridge_and_logistic_coefficients_follow_the_formulas(cases):
    import numpy as np

    x = np.array([(r.u, r.v) for r in cases.collect()])
    t, c = (np.array([r[n] for r in cases.collect()], float) for n in ("t", "c"))
    scale = x.std(axis=0, ddof=1)
    z = np.column_stack([np.ones(len(x)), x / scale])
    ridge = np.linalg.solve(z.T @ z + np.diag([0.0, 1, 1]), z.T @ t)
    got = models.coefficients(models.train(cases.withColumn("y", F.col("t")), ["u", "v"], "regression"))
    assert np.allclose([got["u"], got["v"]], ridge[1:] / scale, rtol=1e-3)
    refit = models.bootstrap_refit(cases.withColumn("y", F.col("t")), ["u", "v"], "k", {"u": 3.0, "v": 1.0}, n_boot=20).first()
    assert refit.estimate == pytest.approx(float(ridge @ [1, 3 / scale[0], 1 / scale[1]]), abs=1e-4)
    assert refit.ci_low <= refit.estimate + 0.1 and refit.estimate - 0.1 <= refit.ci_high
    w = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([0.0, 1, 1]), z.T @ (c - p) - w * [0, 1, 1])
    got = models.coefficients(models.train(cases.withColumn("y", F.col("c")), ["u", "v"]))
    assert np.allclose([got["u"], got["v"]], w[1:] / scale, rtol=1e-2, atol=1e-4)


def test_performance_table_and_profile(spark, cases):
    rows = cases.withColumn("y", F.col("c"))
    table = {r.model_type: r for r in models.performance_table(rows, ["u", "v"], "k", trees=5).collect()}
    assert set(table) == {"logreg", "rf"} and table["rf"].roc_auc > 0.9
    one = features.profile_row(spark, ["u", "v"], {"u": 6.0, "else": 1.0})
    assert one.columns == ["u", "v"] and one.first()[:] == (6.0, 0.0)
    assert models.predict(models.train(rows, ["u", "v"]), one).first().y_pred == 1.0


def test_target_summaries_have_all_columns(cases):
    binary = features.target_summary(cases.withColumn("y", F.col("c")), "c", "binary").first()
    number = features.target_summary(cases.withColumn("y", F.col("t")), "t", "regression", order=["k"], n_boot=20).first()
    assert len(binary) == len(number) == 14 and binary.mean is None and number.rate is None
    assert binary.rate_ci_low < binary.rate < binary.rate_ci_high and number.p90_ci_low <= number.p90 <= number.p90_ci_high


def test_simulation_with_covariates_and_priors(spark):
    samples = spark.createDataFrame([(0, 0, 1.0, 2.0, 0.5), (0, 1, 1.0, 2.0, 0.5)], "chain int, draw int, mu double, kappa double, beta_age double")
    low, high = (simulate.predictive_times_at(samples, {"age": v}, 200).agg(F.avg("mu"), F.avg("minutes")).first() for v in (0.0, 2.0))
    assert (low[0], high[0]) == (1.0, 2.0) and high[1] > 2 * low[1]
    data = spark.createDataFrame([(i, 5.0 + i % 9, 1) for i in range(200)], "case_id int, duration_min double, observed int")
    grid = simulate.Grid(kappa_low=0.5, kappa_step=0.25, kappas=20, mus=41)
    means = [simulate.posterior_means(simulate.posterior(data, grid, p)).first() for p in (simulate.Priors(), simulate.Priors(kappa_gamma=(2.0, 50.0)), simulate.Priors(mu_mean=0.0, mu_sd=0.01))]
    assert means[1].kappa_mean < means[0].kappa_mean and means[2].mu_mean < means[0].mu_mean


def test_dropped_terminals_are_not_reordered(spark):
    rows = log(spark, [("c", "B", 0), ("c", "T", 1), ("c", "T", 1), ("c", "A", 16)], "hours")  # A is at midnight
    cfg = canonical.CanonicalConfig(step_rules=canonical.rules_from_lists(midnight=("A",), terminal=("T",)))
    counts = canonical.report(rows, cfg).first()
    assert (counts.dropped_midnight, counts.dropped_duplicates, counts.terminal_reordered_cases) == (1, 1, 0)
