"""Queries over queues, anomalies, prediction and simulation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import ranks, resampling, stats
from pathloom.functions.portable import uniform
from pathloom.operators import anomaly, canonical, features, models, queues, simulate
from pathloom.plans import basics, views
from pathloom.plans.basics import PROTOCOL, STEPS, _rounded, stages
from pathloom.plans.views import with_views
from pathloom.sources import logs
from pathloom.sources.tables import shared

CANON = canonical.CanonicalConfig(terminal_steps=("purchase",))
GRID = simulate.Grid(kappa_low=0.3, kappa_step=0.1, kappas=30, mu_reach=3.0, mus=61)
ANOMALY = anomaly.AnomalyConfig(vocabulary=4)


# -- queues ------------------------------------------------------------------

def intervals(spark, sf, cfg=queues.QueueConfig(covariate="resource"), view=views.log):
    return queues.state_intervals(view(spark, sf), cfg)


def _intervals(cfg, view=views.log_dirty):
    return lambda s, d: _rounded(intervals(s, d, cfg, view), "duration_seconds", "duration_minutes", places=4)


def interval_sql(view: str = "log", collapse: bool = False, case_end: bool = False, covariate: str = "resource") -> str:
    """Expressions for interval CTEs, ending with ``iv``."""
    same = "WHERE next_state IS NULL OR next_state <> activity" if collapse else ""
    end = "max(timestamp) OVER (PARTITION BY case_id)" if case_end else "next_time"
    return f"""+ i1 AS (SELECT * FROM {view} WHERE case_id IS NOT NULL AND activity IS NOT NULL AND timestamp IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY case_id, timestamp, activity ORDER BY _seq DESC) = 1),
      i2 AS (SELECT *, lead(timestamp) OVER (PARTITION BY case_id ORDER BY timestamp, _seq) AS next_time,
        lead(activity) OVER (PARTITION BY case_id ORDER BY timestamp, _seq) AS next_state FROM i1),
      i3 AS (SELECT * FROM i2 {same}), i4 AS (SELECT *, {end} AS end_time FROM i3),
      iv AS (SELECT case_id, activity AS state, timestamp AS start_time, end_time, {covariate} AS covariate_value,
        date_diff('microsecond', timestamp, end_time) / 1e6 AS duration_seconds, date_diff('microsecond', timestamp, end_time) / 6e7 AS duration_minutes,
        strftime(timestamp, '%Y-%m-%d') AS date FROM i4 WHERE end_time > timestamp)"""


IV = "SELECT case_id, state, start_time, end_time, covariate_value, round(duration_seconds, 4) AS duration_seconds, round(duration_minutes, 4) AS duration_minutes, date FROM iv"
CP = """, ch AS (SELECT state, start_time AS timestamp, 1 AS delta FROM iv UNION ALL SELECT state, end_time, -1 FROM iv)"""
SAMPLED = CP + """, net AS (SELECT state, timestamp, sum(delta) AS net FROM ch GROUP BY ALL),
  lv AS (SELECT state, timestamp, sum(net) OVER (PARTITION BY state ORDER BY timestamp) AS q FROM net),
  gr AS (SELECT unnest(generate_series((SELECT min(timestamp) FROM ch), (SELECT max(timestamp) FROM ch), INTERVAL 15 MINUTE)) AS timestamp),
  pt AS (SELECT * FROM (SELECT DISTINCT state FROM ch), gr)
  SELECT pt.state, pt.timestamp, CAST(coalesce(q, 0) AS DOUBLE) AS queue_length FROM pt ASOF LEFT JOIN lv ON pt.state = lv.state AND pt.timestamp >= lv.timestamp"""


def summary_sql(by: str, where: str = "true") -> str:
    q = ", ".join(f"round(quantile_cont(duration_minutes, {p}), 4) AS {n}" for n, p in (("median_min", 0.5), ("p75_min", 0.75), ("p90_min", 0.9), ("p95_min", 0.95)))
    return f" SELECT {by}, count(*) AS n_intervals, round(avg(duration_minutes), 4) AS mean_min, {q}, round(max(duration_minutes), 4) AS max_min FROM iv WHERE {where} GROUP BY ALL"


WAITS = ("mean_min", "median_min", "p75_min", "p90_min", "p95_min", "max_min")


def queue_pipeline(spark, sf):
    cfg = queues.QueueConfig(terminal_states=("purchase",))
    return _rounded(queues.run_queue_mining(views.log_dirty(spark, sf), cfg, None, CANON)["summary"], *WAITS, places=4)


def queue_summary_sorted(spark, sf):
    """The summary in its order, a row a state."""
    found = queues.run_queue_mining(views.log(spark, sf), freq=None)["summary"]
    return _rounded(found.withColumn("place", F.row_number().over(W.orderBy(F.desc("mean_min"))).cast("long")), *WAITS, places=4)


def csv_export(spark, sf):
    """The summary, written as one CSV file to the shared folder and read back."""
    found = _rounded(queues.wait_summary(intervals(spark, sf)), *WAITS, places=4)
    return logs.read_csv(spark, logs.write_csv(found, shared(spark, "summary"), single=True)).withColumn("n_intervals", F.col("n_intervals").cast("long"))


CANON_SQL = basics.canon_sql(terminal=basics.TERMINAL, ranks="CASE activity WHEN 'purchase' THEN 100 ELSE 50 END")


# -- anomalies ---------------------------------------------------------------

def case_stats(spark, sf):
    out = anomaly.case_stats(anomaly.prepare(views.log_day(spark, sf), ANOMALY))
    return _rounded(out, "case_total_minutes").drop("trace")


def _detected(cfg=ANOMALY, view=views.log_day, dwell=False):
    def run(spark, sf):
        log = view(spark, sf)
        return anomaly.detect(log, cfg, queues.state_intervals(log) if dwell else None)

    return run


def _scores(cfg, *names, dwell=False):
    return lambda s, d: _rounded(_detected(cfg, dwell=dwell)(s, d).select("case_id", *names), *[n for n in names if n.endswith("score")])


STATS = """+ st AS (SELECT case_id, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS trace_length,
   list(activity ORDER BY timestamp, _seq) AS t, date_diff('microsecond', min(timestamp), max(timestamp)) / 6e7 AS case_total_minutes FROM day GROUP BY case_id)"""


def scores_sql(value: str = "case_total_minutes", source: str = "st", sequence: str = "") -> str:
    """CTEs up to ``de``: wait and sequence scores and flags."""
    seq = sequence or """voc AS (SELECT activity FROM day GROUP BY 1 ORDER BY count(*) DESC, activity LIMIT 4),
      wd AS (SELECT case_id, timestamp, _seq, CASE WHEN activity IN (SELECT activity FROM voc) THEN activity ELSE '__UNK__' END AS w FROM day),
      pr AS (SELECT case_id, coalesce(lag(w) OVER (PARTITION BY case_id ORDER BY timestamp, _seq), '__START__') AS before, w AS after,
        lead(w) OVER (PARTITION BY case_id ORDER BY timestamp, _seq) IS NULL AS last FROM wd),
      bg AS (SELECT case_id, before, after FROM pr UNION ALL SELECT case_id, after, '__END__' FROM pr WHERE last),
      bc AS (SELECT before, after, count(*) AS count FROM bg GROUP BY ALL), bt AS (SELECT before, sum(count) AS total FROM bc GROUP BY ALL),
      sq AS (SELECT case_id, avg(-ln((count + 1.0::DOUBLE) / (total + 6.0::DOUBLE))) AS seq_score FROM bg JOIN bc USING (before, after) JOIN bt USING (before) GROUP BY case_id)"""
    return f""", wv AS (SELECT *, {value} AS wait_value FROM {source}), md AS (SELECT quantile_cont(wait_value, 0.5) AS med, quantile_cont(wait_value, 0.99) AS wq FROM wv),
      ma AS (SELECT quantile_cont(abs(wait_value - med), 0.5) AS mad FROM wv, md),
      ws AS (SELECT wv.*, CASE WHEN mad = 0 THEN 0 ELSE 0.6745::DOUBLE * (wait_value - med) / mad END AS wait_score, wq FROM wv, md, ma), {seq},
      th AS (SELECT quantile_cont(seq_score, 0.99) AS sqq FROM sq),
      de AS (SELECT ws.*, wait_value >= wq OR wait_score >= 3 AS wait_flag, seq_score, seq_score >= sqq AS seq_flag FROM ws JOIN sq USING (case_id), th)"""


def protocol_sql(mode: str) -> str:
    goal = "[" + ", ".join(f"'{x}'" for x in STEPS) + "]"
    n = len(STEPS)
    strange = f"len(list_filter(t, lambda x: NOT list_contains({goal}, x)))"
    if mode == "subsequence":
        chain = f"list_reduce(list_concat([0], list_transform(t, lambda x: list_position({goal}, x))), lambda j, p: CASE WHEN p = j + 1 THEN p ELSE j END)"
        score = f"2.0 * ({n} - {chain}) + 0.5 * {strange}"
    elif mode == "exact":
        absent = f"len(list_filter({goal}, lambda p: NOT list_contains(t, p)))"
        score = f"CASE WHEN t = {goal} THEN 0 ELSE 2.0 * {absent} + 0.5 * {strange} END"
    elif mode == "prefix":
        same = " + ".join(f"CASE WHEN t[{i}] = '{x}' THEN 1 ELSE 0 END" for i, x in enumerate(STEPS, 1))
        score = f"2.0 * ({n} - ({same})) + 0.5 * greatest(len(t) - {n}, 0)"
    else:
        found = f"len(list_filter(range(greatest(len(t) - {n} + 1, 0)), lambda i: list_slice(t, i + 1, i + {n}) = {goal})) > 0"
        score = f"CASE WHEN {found} THEN 0.5 * (len(t) - {n}) ELSE 2.0 * {n} + 0.5 * {strange} END"
    return f"sq AS (SELECT case_id, CAST({score} AS DOUBLE) AS seq_score FROM st)"


def _protocol(mode):
    return _scores(anomaly.AnomalyConfig(sequence_method="protocol_deviation", protocol=PROTOCOL, protocol_mode=mode), "seq_score", "seq_flag")


def anomaly_by_severity(spark, sf):
    cfg = anomaly.AnomalyConfig(sequence_method="protocol_deviation", protocol=PROTOCOL, protocol_mode="exact")
    first = anomaly.by_severity(anomaly.detect(views.log_day(spark, sf), cfg)).limit(50)
    keys = ("red_flag", "combined_score", "case_total_minutes", "trace_length")
    place = F.row_number().over(W.orderBy(*[F.desc(k) for k in keys], "case_id")).cast("long")  # of 50 rows
    return _rounded(first.select(place.alias("place"), "case_id", "red_flag", "combined_score"), "combined_score")


def robust_zscore(spark, sf):
    return _rounded(anomaly.robust_z(views.log(spark, sf).select("_seq", "value"), "value"), "z").select("_seq", "z")


def bigrams(spark, sf):
    log = views.log_day(spark, sf)
    return anomaly.bigram_counts(log, anomaly.vocabulary(log, 4))


# -- prediction --------------------------------------------------------------

ACTIVITIES = sorted(views.STAGES)


def case_features(spark, sf):
    out = features.case_features(views.log_day(spark, sf), ACTIVITIES, one_hot_last=False)
    return _rounded(out, "elapsed_minutes").toDF(*[c.replace("::", "_") for c in out.columns])


def feature_activity_counts(spark, sf):
    out = case_features(spark, sf)
    return out.select("case_id", *[c for c in out.columns if c.startswith("act_count")])


def feature_resource_counts(spark, sf):
    log = views.log_day(spark, sf)
    out = features.case_features(log, [], features.top_values(log, "resource", 5), one_hot_last=False)
    found = [c for c in out.columns if c.startswith("res_count")]
    return out.select("case_id", *[F.col(f"`{c}`").alias(f"res_{i}") for i, c in enumerate(found)])


def last_activity_onehot(spark, sf):
    out = features.case_features(views.log_day(spark, sf), ["click", "view"])
    return out.select("case_id", *[c for c in out.columns if c.startswith("last_act")])


def _pia(kind, value):
    def run(spark, sf):
        return _rounded(features.time_to_event_target(views.log_day(spark, sf), "purchase", kind, value), "y")

    return run


def dataset(spark, sf):
    """Long cases: as of ten events, whether the user's eleventh to last events hold over 18 errors."""
    log = views.log(spark, sf)
    target = log.groupBy("case_id").agg((F.count_if(F.col("activity") == "error") > 12).cast("int").alias("y"))
    return features.prediction_dataset(log, target, "n_events", 10, ("value",))


def prediction_dataset(spark, sf):
    out = dataset(spark, sf)
    flat = out.toDF(*[c.replace("::", "_") for c in out.columns])
    return _rounded(flat.select("case_id", "n_events", "elapsed_minutes", "hour", "dayofweek", "act_count_click", "value", "y"), "elapsed_minutes", "value")


def scored(spark, sf):
    """A repeatable score for each event: y_true, y_score with ties, y_pred."""
    u = F.floor(uniform(F.lit(7), F.col("_seq")) * 50) / 50
    rows = views.log(spark, sf).select("_seq", (F.col("value") > 50).cast("int").alias("y_true"), u.alias("u"))
    score = F.round(F.col("u") * 0.7 + F.col("y_true") * 0.2, 2)
    return rows.select("_seq", "y_true", score.alias("y_score"), (score >= 0.5).cast("int").alias("y_pred"))


SCORED = """SELECT _seq, y_true, round(u * 0.7::DOUBLE + y_true * 0.2::DOUBLE, 2) AS y_score, CAST(round(u * 0.7::DOUBLE + y_true * 0.2::DOUBLE, 2) >= 0.5 AS INT) AS y_pred FROM
  (SELECT event_id AS _seq, CAST(value > 50 AS INT) AS y_true,
   floor((('0x' || substr(md5('7|' || event_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE * 50) / 50 AS u FROM events)"""


def regression(spark, sf):
    rows = views.log(spark, sf).select(F.col("value").alias("y_true"), (F.col("value") * 0.9 + F.pmod("_seq", F.lit(7))).alias("y_pred"))
    return _rounded(stats.regression_metrics(rows), "mae", "rmse", "r2", places=4)


def wilson(spark, sf):
    rows = views.log(spark, sf).groupBy("activity").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("activity", "k", "n", F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))


def minutes_by_case(spark, sf):
    return anomaly.case_stats(views.log(spark, sf)).select("case_id", F.col("case_total_minutes").alias("y"))


def _bootstrap(statistic):
    return lambda s, d: _rounded(stats.bootstrap_ci(minutes_by_case(s, d), "y", ["case_id"], statistic, 100), "estimate", "ci_low", "ci_high", places=4)


def poisson_sql(digits: str) -> str:
    return " + ".join(f"CAST({digits} >= '{t}' AS INT)" for t in resampling.thresholds())


_STATISTICS = {"mean": "avg({})", "median": "quantile_cont({}, 0.5)", "p90": "quantile_cont({}, 0.9)"}


def draws_sql(n_boot: int) -> str:
    """Up to ``bs``, the statistics of each draw of Poisson weights; a value
    counts as often as its weight says."""
    each = ", ".join(f"{f.format('value')} AS {n}" for n, f in _STATISTICS.items())
    return f"""+ v AS (SELECT case_id, date_diff('microsecond', min(timestamp), max(timestamp)) / 6e7 AS value FROM log GROUP BY case_id),
      dr AS (SELECT value, b, substr(md5('42|' || b // 4 || '|' || case_id), 8 * (b % 4)::INT + 1, 8) AS h FROM v, range({n_boot}) AS t(b)),
      ws AS (SELECT value, b, {poisson_sql("h")} AS w FROM dr),
      bs AS (SELECT b, {each} FROM (SELECT value, b, unnest(range(w)) FROM ws) GROUP BY b)"""


def bootstrap_sql(statistic: str) -> str:
    f = _STATISTICS[statistic].format("value")
    return with_views("log", draws_sql(100) + f"""
      SELECT (SELECT round({f}, 4) FROM v) AS estimate, round(quantile_cont({statistic}, 0.025), 4) AS ci_low, round(quantile_cont({statistic}, 0.975), 4) AS ci_high FROM bs""")


def target_summary_binary(spark, sf):
    rows = features.keyword_target(views.dispositions(spark, sf), "disposition_desc", features.ADMISSION)
    return _all_rounded(features.target_summary(rows, "prob_admission", "binary"))


def target_summary_regression(spark, sf):
    return _all_rounded(features.target_summary(minutes_by_case(spark, sf), "minutes", "regression", order=["case_id"]), 4)


def _absent(*names: str) -> str:
    return ", ".join(f"CAST(NULL AS DOUBLE) AS {n}{ci}" for n in names for ci in ("", "_ci_low", "_ci_high"))


def split_stratified(spark, sf):
    """Users, whether they buy more than twelve times, and whether they're for the test."""
    rows = dataset(spark, sf).select("case_id", "y")
    train, test = models.split(rows, "case_id", by="y")
    return train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))


def historical_baselines(spark, sf):
    """Of days of users, whose disposition is their user's order's."""
    return _rounded(features.historical_baselines(views.log_disposed(spark, sf), "disposition_desc", "purchase", "n_events", 1), "admission_rate", "lwbs_rate", "median_minutes")


FEATURES = ["n_events", "elapsed_minutes", "hour", "dayofweek", "value"]


def _model(task, kind, trees=None):
    def run(spark, sf):
        rows = dataset(spark, sf)
        rows = rows if task == "binary" else rows.withColumn("y", F.col("value"))
        names = FEATURES if task == "binary" else FEATURES[:-1]
        return models.evaluate(rows, names, "case_id", task, kind, trees)

    return run


def model_predict(spark, sf):
    rows = dataset(spark, sf)
    return models.predict(models.train(rows, FEATURES), rows).select("case_id", "y", "y_pred", "y_score")


def bootstrap_refit(spark, sf):
    profile = {"n_events": 10.0, "elapsed_minutes": 1000.0, "hour": 12.0, "dayofweek": 2.0, "value": 50.0}
    return models.bootstrap_refit(dataset(spark, sf), FEATURES, "case_id", profile)


def profile_bounds(spark, sf):
    return _rounded(ranks.quantiles(views.log(spark, sf), "value", {"low": 0.01, "middle": 0.5, "high": 0.99}), "low", "middle", "high")


# -- simulation --------------------------------------------------------------

def transitions(spark, sf):
    return simulate.transition_dataset(stages(spark, sf), "registration", "assessment")


def transition_dataset(spark, sf):
    return _rounded(transitions(spark, sf), "duration_min")


def with_covariates(spark, sf):
    return _rounded(simulate.transition_dataset(stages(spark, sf), "registration", "assessment", ("value",)), "duration_min", "value")


def suffstats(spark, sf):
    out = simulate.sufficient_statistics(transitions(spark, sf), GRID)
    size = F.pow(F.lit(10.0), F.floor(F.log10("s_kappa")))
    return out.select(F.round("kappa", 4).alias("kappa"), "d", F.round("sum_log", 4).alias("sum_log"), F.round(F.col("s_kappa") / size, 6).alias("s_scaled"))


def posterior_grid(spark, sf):
    return _rounded(simulate.posterior_means(simulate.posterior(transitions(spark, sf), GRID)), "mu_mean", "kappa_mean")


def mcmc(spark, sf):
    got = simulate.posterior_with_covariates(simulate.transition_dataset(stages(spark, sf), "registration", "assessment", ("value",)), ["value"], 200, 200)
    return got.groupBy("chain").agg(*[F.avg(c).alias(c) for c in ("mu", "kappa", "beta_value")])


def drawn(spark, sf):
    """Times from the posterior predictive of the transition, at both capacities."""
    return simulate.scenario(simulate.predictive_times(simulate.posterior(transitions(spark, sf), GRID), 2000), 1.5)


LEVELS = simulate.SERVICE_LEVELS["registration_to_assessment"]


def predictive(spark, sf):
    got = simulate.predictive_times(simulate.posterior(transitions(spark, sf), GRID), 2000)
    return _rounded(got.agg(F.count("*").alias("n"), F.avg("minutes").alias("mean"), F.percentile("minutes", 0.5).alias("median")), "mean", "median", places=4)


def _all_rounded(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


TRANSITION = """+ p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY timestamp, _seq) AS pos FROM stages),
  s0 AS (SELECT case_id, min(pos) AS p0 FROM p WHERE activity = 'registration' GROUP BY case_id),
  tr AS (SELECT p.case_id, arg_min(timestamp, abs(pos - p0)) AS t0, min(timestamp) FILTER (activity = 'assessment' AND pos > p0) AS t1, max(timestamp) AS t2,
    arg_min(value, pos) AS value FROM p JOIN s0 USING (case_id) GROUP BY p.case_id),
  du AS (SELECT case_id, greatest(date_diff('microsecond', t0, coalesce(t1, t2)) / 6e7, 1e-6::DOUBLE) AS duration_min, CAST(t1 IS NOT NULL AS INT) AS observed, value FROM tr)"""
KAPPAS = """, kp AS (SELECT i, round(0.3::DOUBLE + 0.1::DOUBLE * i, 10) AS kappa FROM range(30) AS t(i)),
  ss AS (SELECT kappa, sum(observed)::BIGINT AS d, coalesce(sum(CASE WHEN observed = 1 THEN ln(duration_min) END), 0) AS sum_log, sum(pow(duration_min, kappa)) AS s_kappa FROM du, kp GROUP BY kappa)"""
POSTERIOR = KAPPAS + """, m AS (SELECT ln(quantile_cont(duration_min, 0.5)) AS m0 FROM du),
  pt AS (SELECT kappa, m0 + o AS mu, d * ln(kappa) + (kappa - 1) * sum_log - d * kappa * (m0 + o) - exp(-kappa * (m0 + o)) * s_kappa - o * o / 8 - 1 / kappa - 2 * ln(kappa) AS lp
    FROM ss, m, (SELECT j * 0.1::DOUBLE - 3 AS o FROM range(61) AS t(j))),
  pw AS (SELECT mu, kappa, exp(lp - (SELECT max(lp) FROM pt)) AS w FROM pt)"""

DRAWN = POSTERIOR + """, cu AS (SELECT mu, kappa, sum(w) OVER (ORDER BY kappa, mu ROWS UNBOUNDED PRECEDING) / (SELECT sum(w) FROM pw) AS at FROM pw WHERE w > 0),
  un AS (SELECT i AS draw, (('0x' || substr(md5('123|' || i || '|p'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS p, (('0x' || substr(md5('123|' || i || '|t'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM range(2000) AS t(i)),
  sim AS (SELECT draw, greatest(exp(mu) * pow(-ln(1 - u), 1 / kappa), 1e-6::DOUBLE) AS b FROM un ASOF JOIN cu ON un.p <= cu.at),
  sc AS (SELECT draw, b AS t_baseline, b / 1.5::DOUBLE AS t_capacity FROM sim)"""


def drawn_sql(body: str) -> str:
    return with_views("stages", TRANSITION + DRAWN + body)


QUERIES = {
    "state_intervals": _intervals(queues.QueueConfig(covariate="resource")),
    "state_intervals_collapsed": _intervals(queues.QueueConfig(covariate="resource", collapse_consecutive_same_state=True)),
    "state_intervals_case_end": _intervals(queues.QueueConfig(covariate="resource", end_rule="case_end_time")),
    "queue_change_points": lambda s, d: queues.change_points(intervals(s, d)),
    "queue_sampled": lambda s, d: queues.sampled(intervals(s, d)),
    "wait_summary": lambda s, d: _rounded(queues.wait_summary(intervals(s, d)), *WAITS, places=4),
    "wait_summary_by_covariate": lambda s, d: _rounded(queues.wait_summary(intervals(s, d, view=views.log_dirty), "covariate_value"), *WAITS, places=4),
    "interval_duration_filter": lambda s, d: _rounded(logs.filter_duration(intervals(s, d), 60, 600).select("case_id", "state", "start_time", "duration_minutes"), "duration_minutes", places=4),
    "queue_pipeline": queue_pipeline,
    "queue_sampled_hours": lambda s, d: queues.sampled(intervals(s, d), "1h", "2023-12-31 12:30:00", "2024-01-20 12:00:00"),
    "queue_summary_sorted": queue_summary_sorted,
    "csv_export": csv_export,
    "file_order": lambda s, d: logs.file_order(views.table(s, d, "events")).select("event_id", "_seq"),
    "anomaly_by_severity": anomaly_by_severity,
    "split_stratified": split_stratified,
    "wait_box_stats": lambda s, d: _all_rounded(queues.box_stats(intervals(s, d)), 4),
    "case_stats": case_stats,
    "cutoff_minutes": lambda s, d: anomaly.cut(views.log(s, d), "minutes_since_first_event", 2880).select("case_id", "_seq"),
    "cutoff_n_events": lambda s, d: anomaly.cut(views.log(s, d), "n_events", 5).select("case_id", "_seq"),
    "robust_zscore": robust_zscore,
    "anomaly_wait_total": _scores(ANOMALY, "wait_value", "wait_flag"),
    "anomaly_wait_z": _scores(ANOMALY, "wait_score"),
    "anomaly_wait_dwell": _scores(anomaly.AnomalyConfig(wait_metric="activity_dwell_minutes_p95"), "wait_score", "wait_flag", dwell=True),
    "anomaly_bigram_nll": _scores(ANOMALY, "seq_score"),
    "bigram_counts": bigrams,
    "anomaly_seq_flag": _scores(ANOMALY, "seq_flag"),
    **{f"anomaly_protocol_{m}": _protocol(m) for m in ("subsequence", "exact", "prefix", "exact_with_extras")},
    "anomaly_red_flags": _scores(ANOMALY, "red_flag", "red_flag_reasons", "combined_score"),
    "anomaly_summary": lambda s, d: anomaly.summary(_detected()(s, d)),
    "feature_activity_counts": feature_activity_counts,
    "feature_resource_counts": feature_resource_counts,
    "target_admission": lambda s, d: features.build_target(views.dispositions(s, d), "prob_admission"),
    "target_lwbs": lambda s, d: features.build_target(views.dispositions(s, d), "prob_lwbs"),
    "target_time_to_pia": _pia("minutes_since_first_event", 60),
    "target_time_to_pia_n_events": _pia("n_events", 2),
    "arrival_time": lambda s, d: features.arrival_times(views.log_day(s, d), "signup"),
    "case_features": case_features,
    "last_activity_onehot": last_activity_onehot,
    "prediction_dataset": prediction_dataset,
    "model_logreg": _model("binary", "logreg"),
    "model_rf": _model("binary", "rf"),
    "model_ridge": _model("regression", "logreg"),
    "model_predict": model_predict,
    "metrics_binary": lambda s, d: _all_rounded(stats.binary_metrics(scored(s, d))),
    "metrics_auc": lambda s, d: _all_rounded(stats.roc_auc(scored(s, d))),
    "metrics_avg_precision": lambda s, d: _all_rounded(stats.average_precision(scored(s, d))),
    "metrics_regression": regression,
    "wilson_ci": wilson,
    **{f"bootstrap_ci_{n}": _bootstrap(n) for n in ("mean", "median", "p90")},
    "target_summary_binary": target_summary_binary,
    "target_summary_regression": target_summary_regression,
    "bootstrap_refit_ci": bootstrap_refit,
    "historical_baselines": historical_baselines,
    "profile_numeric_bounds": profile_bounds,
    "transitions_available": lambda s, d: simulate.available(stages(s, d).where("activity <> 'discharge'")),
    "transition_dataset": transition_dataset,
    "transition_dataset_covariates": with_covariates,
    "weibull_suffstats": suffstats,
    "weibull_posterior_grid": posterior_grid,
    "weibull_mcmc": mcmc,
    "posterior_predictive": predictive,
    "capacity_scenario": lambda s, d: _all_rounded(drawn(s, d), 4),
    "sim_summary": lambda s, d: _all_rounded(simulate.summarize(drawn(s, d)), 4),
    "sim_quantile_table": lambda s, d: _all_rounded(simulate.quantile_table(drawn(s, d)), 4),
    "sim_sla_table": lambda s, d: _all_rounded(simulate.service_table(drawn(s, d), LEVELS)),
    "ecdf": lambda s, d: _all_rounded(stats.ecdf(views.log_ship(s, d), "value", "activity")),
    "histogram": lambda s, d: stats.histogram(views.log_ship(s, d), "value", 10),
    "log_fingerprint": lambda s, d: simulate.fingerprint(views.log(s, d), "registration_to_assessment", GRID),
    "simulate_transition": lambda s, d: _all_rounded(simulate.simulate(stages(s, d), "registration_to_assessment", n=1000, grid=GRID), 4),
}

_ALL = "SELECT case_id, "
_AUC = f"""WITH s AS ({SCORED}), l AS (SELECT y_score, sum(y_true)::DOUBLE AS pos, sum(1 - y_true)::DOUBLE AS neg FROM s GROUP BY 1)"""
_Q = (("q05", 0.05), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95))
ORACLES = {
    "state_intervals": with_views("dirty", interval_sql("dirty") + IV),
    "state_intervals_collapsed": with_views("dirty", interval_sql("dirty", collapse=True) + IV),
    "state_intervals_case_end": with_views("dirty", interval_sql("dirty", case_end=True) + IV),
    "queue_change_points": with_views("log", interval_sql() + CP + " SELECT state, timestamp, delta, CAST(sum(delta) OVER (PARTITION BY state ORDER BY timestamp, delta ROWS UNBOUNDED PRECEDING) AS BIGINT) AS queue_length FROM ch"),
    "queue_sampled": with_views("log", interval_sql() + SAMPLED),
    "wait_summary": with_views("log", interval_sql() + summary_sql("state")),
    "wait_summary_by_covariate": with_views("dirty", interval_sql("dirty") + summary_sql("covariate_value")),
    "interval_duration_filter": with_views("log", interval_sql() + " SELECT case_id, state, start_time, round(duration_minutes, 4) AS duration_minutes FROM iv WHERE duration_minutes BETWEEN 60 AND 600"),
    "queue_pipeline": f"WITH cn AS ({CANON_SQL}), " + interval_sql("cn", covariate="NULL").lstrip("+") + summary_sql("state", "state <> 'purchase'"),
    "wait_box_stats": with_views("log", interval_sql() + """, b AS (SELECT state, min(duration_minutes) AS mn, quantile_cont(duration_minutes, 0.25) AS q1, quantile_cont(duration_minutes, 0.5) AS med, quantile_cont(duration_minutes, 0.75) AS q3, max(duration_minutes) AS mx FROM iv GROUP BY 1)
      SELECT state, round(mn, 4) AS min, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, round(mx, 4) AS max, round(q3 - q1, 4) AS iqr, round(q1 - 1.5 * (q3 - q1), 4) AS low_fence, round(q3 + 1.5 * (q3 - q1), 4) AS high_fence FROM b"""),
    "case_stats": with_views("day", STATS + """ SELECT case_id, start_time, end_time, trace_length, round(case_total_minutes, 6) AS case_total_minutes,
      array_to_string(list_slice(t, 1, 12), ' → ') || CASE WHEN len(t) > 12 THEN ' …' ELSE '' END AS trace_preview FROM st"""),
    "cutoff_minutes": with_views("log", "SELECT case_id, _seq FROM log QUALIFY timestamp <= min(timestamp) OVER (PARTITION BY case_id) + INTERVAL 2880 MINUTE"),
    "cutoff_n_events": with_views("log", "SELECT case_id, _seq FROM log QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY timestamp, _seq) <= 5"),
    "robust_zscore": "WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM events), a AS (SELECT quantile_cont(abs(value - med), 0.5) AS mad FROM events, m) SELECT event_id AS _seq, round(0.6745::DOUBLE * (value - med) / mad, 6) AS z FROM events, m, a",
    "anomaly_wait_total": with_views("day", STATS + scores_sql() + f" {_ALL} wait_value, wait_flag FROM de"),
    "anomaly_wait_z": with_views("day", STATS + scores_sql() + f" {_ALL} round(wait_score, 6) AS wait_score FROM de"),
    "anomaly_wait_dwell": with_views("day", STATS + ", " + interval_sql("day").lstrip("+") + """, dw AS (SELECT st.case_id, coalesce(m, 0) AS dwell FROM st LEFT JOIN (SELECT case_id, max(duration_minutes) AS m FROM iv GROUP BY 1) x ON st.case_id = x.case_id)"""
      + scores_sql("dwell", "dw") + f" {_ALL} round(wait_score, 6) AS wait_score, wait_flag FROM de"),
    "anomaly_bigram_nll": with_views("day", STATS + scores_sql() + f" {_ALL} round(seq_score, 6) AS seq_score FROM de"),
    "bigram_counts": with_views("day", STATS + scores_sql() + " SELECT before, after, count FROM bc"),
    "anomaly_seq_flag": with_views("day", STATS + scores_sql() + f" {_ALL} seq_flag FROM de"),
    **{f"anomaly_protocol_{m}": with_views("day", STATS + scores_sql(sequence=protocol_sql(m)) + f" {_ALL} round(seq_score, 6) AS seq_score, seq_flag FROM de") for m in ("subsequence", "exact", "prefix", "exact_with_extras")},
    "anomaly_red_flags": with_views("day", STATS + scores_sql() + f" {_ALL} wait_flag OR seq_flag AS red_flag, concat_ws(',', CASE WHEN wait_flag THEN 'long_wait' END, CASE WHEN seq_flag THEN 'unusual_sequence' END) AS red_flag_reasons, round(wait_score + seq_score, 6) AS combined_score FROM de"),
    "anomaly_summary": with_views("day", STATS + scores_sql() + " SELECT count(*) AS n_cases, count(*) FILTER (wait_flag OR seq_flag) AS n_red_flag, count(*) FILTER (wait_flag) AS n_wait_flag, count(*) FILTER (seq_flag) AS n_seq_flag FROM de"),
    "feature_activity_counts": with_views("day", "SELECT case_id, " + ", ".join(f"count(*) FILTER (activity = '{a}') AS act_count_{a}" for a in ACTIVITIES) + " FROM day GROUP BY case_id"),
    "feature_resource_counts": with_views("day", """+ v AS (SELECT resource, row_number() OVER (ORDER BY count(*) DESC, resource) - 1 AS i FROM day GROUP BY resource)
      SELECT case_id, """ + ", ".join(f"count(*) FILTER (i = {i}) AS res_{i}" for i in range(5)) + " FROM day LEFT JOIN v USING (resource) GROUP BY case_id"),
    "target_admission": with_views("outcome", "SELECT case_id, CAST(regexp_matches(lower(disposition_desc), 'admit|admission|inpatient') AS INT) AS y FROM outcome WHERE disposition_desc IS NOT NULL"),
    "target_lwbs": with_views("outcome", "SELECT case_id, CAST(regexp_matches(lower(disposition_desc), 'lwbs|left without being seen|left after triage') AS INT) AS y FROM outcome WHERE disposition_desc IS NOT NULL"),
    "target_time_to_pia": with_views("day", """+ x AS (SELECT case_id, date_diff('microsecond', min(timestamp) + INTERVAL 60 MINUTE, min(timestamp) FILTER (activity = 'purchase')) / 6e7 AS y FROM day GROUP BY 1)
      SELECT case_id, round(y, 6) AS y FROM x WHERE y BETWEEN 0 AND 1440"""),
    "target_time_to_pia_n_events": with_views("day", """+ n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY timestamp, _seq) AS no FROM day),
      x AS (SELECT case_id, date_diff('microsecond', coalesce(max(timestamp) FILTER (no = 2), max(timestamp)), min(timestamp) FILTER (activity = 'purchase')) / 6e7 AS y FROM n GROUP BY 1)
      SELECT case_id, round(y, 6) AS y FROM x WHERE y BETWEEN 0 AND 1440"""),
    "arrival_time": with_views("day", "SELECT case_id, coalesce(min(timestamp) FILTER (activity = 'signup'), min(timestamp)) AS arrival_time FROM day GROUP BY 1"),
    "case_features": with_views("day", "SELECT case_id, count(*) AS n_events, round(date_diff('microsecond', min(timestamp), max(timestamp)) / 6e7, 6) AS elapsed_minutes, hour(min(timestamp)) AS hour, isodow(min(timestamp)) - 1 AS dayofweek, " + ", ".join(f"count(*) FILTER (activity = '{a}') AS act_count_{a}" for a in ACTIVITIES) + " FROM day GROUP BY case_id"),
    "last_activity_onehot": with_views("day", "+ x AS (SELECT case_id, arg_max(activity, (timestamp, _seq)) AS a FROM day GROUP BY 1) SELECT case_id, CAST(a = 'click' AS BIGINT) AS last_act_click, CAST(a = 'view' AS BIGINT) AS last_act_view, CAST(a NOT IN ('click', 'view') AS BIGINT) AS last_act_OTHER FROM x"),
    "prediction_dataset": with_views("log", """+ n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY timestamp, _seq) AS no FROM log)
      SELECT case_id, count(*) FILTER (no <= 10) AS n_events, round(date_diff('microsecond', min(timestamp), max(timestamp) FILTER (no <= 10)) / 6e7, 6) AS elapsed_minutes, hour(min(timestamp)) AS hour, isodow(min(timestamp)) - 1 AS dayofweek,
      count(*) FILTER (no <= 10 AND activity = 'click') AS act_count_click, round(arg_min(value, no), 6) AS value, CAST(count(*) FILTER (activity = 'error') > 12 AS INT) AS y FROM n GROUP BY case_id"""),
    "metrics_binary": f"""WITH s AS ({SCORED}), c AS (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1)::DOUBLE AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0)::DOUBLE AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0)::DOUBLE AS tn FROM s)
      SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "metrics_auc": _AUC + ", w AS (SELECT pos, neg, pos * (coalesce(sum(neg) OVER (ORDER BY y_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS wins FROM l) SELECT round(sum(wins) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM w",
    "metrics_avg_precision": _AUC + ", w AS (SELECT pos, pos * sum(pos) OVER (ORDER BY y_score DESC) / sum(pos + neg) OVER (ORDER BY y_score DESC) AS g FROM l) SELECT round(sum(g) / sum(pos), 6) AS avg_precision FROM w",
    "metrics_regression": "WITH x AS (SELECT value AS y, value - (value * 0.9::DOUBLE + event_id % 7) AS e FROM events) SELECT round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (count(*) * var_pop(y)), 4) AS r2 FROM x",
    "wilson_ci": """WITH x AS (SELECT event_type AS activity, count(*) FILTER (value > 50) AS k, count(*) AS n, count(*) FILTER (value > 50) / count(*)::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM events GROUP BY 1)
      SELECT activity, k, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS ci_low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS ci_high FROM x""",
    **{f"bootstrap_ci_{n}": bootstrap_sql(n) for n in ("mean", "median", "p90")},
    "target_summary_binary": with_views("outcome", f"""+ x AS (SELECT count(*) AS n, avg(CAST(regexp_matches(lower(disposition_desc), 'admit|admission|inpatient') AS INT)) AS p, 1.959963984540054::DOUBLE AS z FROM outcome WHERE disposition_desc IS NOT NULL)
      SELECT 'prob_admission' AS target, n AS n_cases, round(p, 6) AS rate, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS rate_ci_low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS rate_ci_high,
        {_absent("mean", "median", "p90")} FROM x"""),
    "target_summary_regression": with_views("log", draws_sql(2000) + f" SELECT 'minutes' AS target, (SELECT count(*) FROM v) AS n_cases, {_absent('rate')}, "
      + ", ".join(f"(SELECT round({f.format('value')}, 4) FROM v) AS {n}, round(quantile_cont({n}, 0.025), 4) AS {n}_ci_low, round(quantile_cont({n}, 0.975), 4) AS {n}_ci_high" for n, f in _STATISTICS.items()) + " FROM bs"),
    "split_stratified": with_views("log", """+ y AS (SELECT case_id, CAST(count(*) FILTER (activity = 'error') > 12 AS INT) AS y FROM log GROUP BY case_id),
      h AS (SELECT *, CAST(('0x' || substr(md5('42|' || case_id), 1, 13))::BIGINT AS DOUBLE) AS h FROM y),
      q AS (SELECT y, quantile_cont(h, 0.25) AS t, count(*) AS n FROM h GROUP BY y) SELECT case_id, h.y, h <= t AND n > 1 AS test FROM h JOIN q USING (y)"""),
    "queue_sampled_hours": with_views("log", interval_sql() + SAMPLED.replace("(SELECT min(timestamp) FROM ch), (SELECT max(timestamp) FROM ch), INTERVAL 15 MINUTE", "TIMESTAMP '2023-12-31 12:30:00', TIMESTAMP '2024-01-20 12:00:00', INTERVAL 1 HOUR")),
    "queue_summary_sorted": with_views("log", interval_sql() + summary_sql("state").replace("SELECT state,", "SELECT row_number() OVER (ORDER BY avg(duration_minutes) DESC) AS place, state,")),
    "csv_export": with_views("log", interval_sql() + summary_sql("state")),
    "file_order": "SELECT event_id, row_number() OVER () - 1 AS _seq FROM events",
    "anomaly_by_severity": with_views("day", STATS + scores_sql(sequence=protocol_sql("exact")) + """, sv AS (SELECT row_number() OVER (ORDER BY wait_flag OR seq_flag DESC, wait_score + seq_score DESC, case_total_minutes DESC, trace_length DESC, case_id) AS place,
      case_id, wait_flag OR seq_flag AS red_flag, round(wait_score + seq_score, 6) AS combined_score FROM de) SELECT * FROM sv WHERE place <= 50"""),
    "historical_baselines": with_views("day outcome disposed", """+ n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY timestamp, _seq) AS no FROM disposed),
      x AS (SELECT case_id, date_diff('microsecond', max(timestamp) FILTER (no = 1), min(timestamp) FILTER (activity = 'purchase')) / 6e7 AS y, lower(any_value(disposition_desc)) AS d FROM n GROUP BY 1)
      SELECT round(avg(CAST(regexp_matches(d, 'admit|admission|inpatient') AS INT)), 6) AS admission_rate, round(avg(CAST(regexp_matches(d, 'lwbs|left without being seen|left after triage') AS INT)), 6) AS lwbs_rate,
        (SELECT round(quantile_cont(y, 0.5), 6) FROM x WHERE y BETWEEN 0 AND 1440) AS median_minutes FROM x WHERE d IS NOT NULL"""),
    "profile_numeric_bounds": "SELECT round(quantile_cont(value, 0.01), 6) AS low, round(quantile_cont(value, 0.5), 6) AS middle, round(quantile_cont(value, 0.99), 6) AS high FROM events",
    "transitions_available": with_views("stages", "+ a AS (SELECT DISTINCT activity FROM stages WHERE activity <> 'discharge') SELECT k AS transition_key, s AS start_activity, e AS end_activity, s IN (SELECT activity FROM a) AS start_present, e IN (SELECT activity FROM a) AS end_present FROM (VALUES "
      + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in simulate.TRANSITIONS.items()) + ") AS t(k, s, e)"),
    "transition_dataset": with_views("stages", TRANSITION + " SELECT case_id, round(duration_min, 6) AS duration_min, observed FROM du"),
    "transition_dataset_covariates": with_views("stages", TRANSITION + " SELECT case_id, round(duration_min, 6) AS duration_min, observed, round(value, 6) AS value FROM du"),
    "weibull_suffstats": with_views("stages", TRANSITION + KAPPAS + " SELECT round(kappa, 4) AS kappa, d, round(sum_log, 4) AS sum_log, round(s_kappa / pow(10.0::DOUBLE, floor(log10(s_kappa))), 6) AS s_scaled FROM ss"),
    "weibull_posterior_grid": with_views("stages", TRANSITION + POSTERIOR + " SELECT round(sum(w * mu) / sum(w), 6) AS mu_mean, round(sum(w * kappa) / sum(w), 6) AS kappa_mean FROM pw"),
    "capacity_scenario": drawn_sql(" SELECT draw, round(t_baseline, 4) AS t_baseline, round(t_capacity, 4) AS t_capacity FROM sc"),
    "sim_summary": drawn_sql(" SELECT count(*) AS n_mc_times, " + ", ".join(
        f"round(avg(t_{n}), 4) AS {n}_mean, round(quantile_cont(t_{n}, 0.5), 4) AS {n}_median, " + ", ".join(f"round(quantile_cont(t_{n}, {p}), 4) AS {n}_{q}" for q, p in _Q) + ", "
        + ", ".join(f"round(avg(CAST(t_{n} <= {x} AS INT)), 4) AS {n}_p_le_{x}m" for x in (30, 60, 120)) for n in ("baseline", "capacity")) + " FROM sc"),
    "sim_quantile_table": drawn_sql(" " + " UNION ALL ".join(f"SELECT 'q{round(p * 100):02d}' AS label, round(quantile_cont(t_baseline, {p}), 4) AS baseline, round(quantile_cont(t_capacity, {p}), 4) AS capacity FROM sc" for p in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))),
    "sim_sla_table": drawn_sql(" SELECT x AS threshold_min, round(avg(CAST(t_baseline <= x AS INT)), 6) AS baseline, round(avg(CAST(t_capacity <= x AS INT)), 6) AS capacity FROM sc, (VALUES " + ", ".join(f"({x})" for x in LEVELS) + ") AS t(x) GROUP BY x"),
    "ecdf": with_views("ship", "+ c AS (SELECT activity, value, count(*) AS n FROM ship GROUP BY ALL) SELECT activity, value, round(sum(n) OVER (PARTITION BY activity ORDER BY value) / sum(n) OVER (PARTITION BY activity)::DOUBLE, 6) AS share FROM c"),
    "histogram": with_views("ship", "+ e AS (SELECT min(value) AS lo, quantile_cont(value, 0.99) AS hi FROM ship) SELECT CAST(least(floor((value - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM ship, e WHERE value <= hi GROUP BY 1"),
}
