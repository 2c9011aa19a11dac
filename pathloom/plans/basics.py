"""Queries over scans, filters, canonicalisation, windows, joins and graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pathloom.operators import anomaly, canonical, conformance, discovery, features
from pathloom.plans import views
from pathloom.plans.views import with_views
from pathloom.schema import LOG, minutes, traces
from pathloom.sources import logs

MIDNIGHT = "(hour(timestamp) = 0 AND minute(timestamp) = 0 AND CAST(second(timestamp) AS INT) = 0)"
RULES = canonical.rules_from_lists(midnight=("view",), terminal=("purchase",))
FULL = canonical.CanonicalConfig(step_rules=RULES, max_time_repairs_per_case=1)


def _rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


def scan_csv(spark, sf):
    """Write the events as CSV to the shared folder and read them back."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = logs.write_csv(views.table(spark, sf, "events"), f"{base}/events-{uuid.uuid4().hex}")
    return logs.read_csv(spark, path).select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


def event_log_build(spark, sf):
    mapping = logs.ColumnMapping("user_id", "event_type", "ts", None, ("value", "user_id"), "event_id")
    return _rounded(logs.build_event_log(views.table(spark, sf, "events"), mapping)[0], "value")


def timestamp_coerce(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "never").when(F.col("event_id") % 5 == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    rows = views.table(spark, sf, "events").select("event_id", text.otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("t"))
    return rows.select("event_id", logs.parse_timestamp(F.col("t"), dayfirst=True).alias("parsed"))


def normalize_activity(spark, sf):
    rows = views.log(spark, sf).select(F.concat(F.lit(" \t"), F.upper("activity"), F.lit("\n")).alias("raw"))
    return rows.select(logs.normalized(F.col("raw")).alias("activity")).groupBy("activity").agg(F.count("*").alias("n"))


def relabel_activities(spark, sf):
    some = {k: v for k, v in views.STAGES.items() if k != "error"}
    return logs.relabel(views.log(spark, sf), some).groupBy("activity").agg(F.count("*").alias("n"))


def stages(spark, sf):
    return logs.relabel(views.log(spark, sf), views.STAGES)


def coerce_numeric(spark, sf):
    rows = views.log(spark, sf).select("_seq", F.col("value").cast("string").alias("v"), "activity", F.concat(F.lit("e"), F.col("_seq").cast("string")).alias("free"))
    return _rounded(features.coerce_numeric(rows, ["_seq"]), "v")


def _canon(cfg, view=views.log_dirty):
    def run(spark, sf):
        return canonical.canonicalize(view(spark, sf), cfg).select("case_id", "activity", "timestamp", "_seq")

    return run


def canon_sql(drops: str = "false", monotone: bool = True, roll: bool = False, most: int = 10, ranks: str = "50", case_share: str = "",
              terminal: str = "false", columns: str = "case_id, activity, timestamp, _seq", view: str = "dirty") -> str:
    """The canonicaliser in SQL; ``drops`` is the filter of the first stages."""
    pushed = f"CASE WHEN {MIDNIGHT} THEN timestamp + INTERVAL 1 DAY ELSE l + to_seconds(k) END" if roll else "l + to_seconds(k)"
    share = f"QUALIFY NOT coalesce(avg(CAST(({case_share}) AS INT)) OVER (PARTITION BY case_id) > 0.30, false)" if case_share else ""
    lifted = "max(t) OVER (PARTITION BY case_id ORDER BY pos ROWS UNBOUNDED PRECEDING)" if monotone else "t"
    return with_views(view, f"""+ c1 AS (SELECT * FROM {view} WHERE case_id IS NOT NULL AND activity IS NOT NULL AND timestamp IS NOT NULL),
      c2 AS (SELECT * FROM c1 WHERE NOT ({drops}) {share}),
      c5 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY case_id, timestamp, activity ORDER BY _seq DESC) = 1),
      c6 AS (SELECT *, {terminal} AS term, row_number() OVER (PARTITION BY case_id ORDER BY timestamp, {ranks}, _seq) AS pos FROM c5),
      c7 AS (SELECT *, max(CASE WHEN NOT term THEN timestamp END) OVER (PARTITION BY case_id) AS l FROM c6),
      c8 AS (SELECT *, coalesce(term AND timestamp <= l, false) AS pushed FROM c7),
      c9 AS (SELECT *, sum(pushed::INT) OVER (PARTITION BY case_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM c8),
      c10 AS (SELECT *, CASE WHEN pushed THEN {pushed} ELSE timestamp END AS t FROM c9),
      c11 AS (SELECT *, {lifted} AS t2 FROM c10),
      c12 AS (SELECT *, sum((t2 <> t)::INT) OVER (PARTITION BY case_id) AS repairs FROM c11),
      canon AS (SELECT case_id, activity, t2 AS timestamp, pos AS _seq, repairs, pushed, t2 <> t AS repaired FROM c12)
      SELECT {columns} FROM canon WHERE repairs <= {most}""")


TERMINAL = "activity = 'purchase'"
RANKS = "CASE activity WHEN 'view' THEN 60 WHEN 'purchase' THEN 100 ELSE 50 END"
VIEW_MIDNIGHT = f"activity = 'view' AND {MIDNIGHT}"


def canon_report(spark, sf):
    return canonical.report(views.log_dirty(spark, sf), FULL)


def sort_events(spark, sf):
    return views.log_ship(spark, sf).select("case_id", "activity", "timestamp", "_seq", F.row_number().over(LOG.events.orderBy("timestamp", "_seq", "resource", "value")).cast("long").alias("rn"))


def join_static_left(spark, sf):
    cases = views.log_day(spark, sf).groupBy("case_id").agg(F.count("*").alias("n"))
    static = features.static_features(views.log_dirty(spark, sf).where("value > 50"), ["resource"])
    return cases.join(static, "case_id", "left")


def join_target_inner(spark, sf):
    f = views.log_ship(spark, sf).groupBy("case_id").agg(F.count("*").alias("n"))
    return f.join(features.keyword_target(views.dispositions(spark, sf), "disposition_desc", features.ADMISSION), "case_id")


def anti_join_bad_cases(spark, sf):
    bad = views.log(spark, sf).where("activity = 'error'").groupBy("case_id").count().where("count > 15").select("case_id")
    return views.log(spark, sf).join(bad, "case_id", "left_anti").groupBy("case_id").agg(F.count("*").alias("n"))


def lead_next_event(spark, sf):
    w = LOG.events
    return views.log(spark, sf).select("_seq", F.lead("activity").over(w).alias("next_activity"), F.lead("timestamp").over(w).alias("next_time"))


def inter_event_gap(spark, sf):
    return views.log(spark, sf).select("_seq", F.round(minutes(F.lag("timestamp").over(LOG.events), F.col("timestamp")), 6).alias("gap"))


def _joined(df, *names):
    return df.withColumns({n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",") for n in names})


def extract_traces(spark, sf):
    return _joined(traces(views.log(spark, sf)), "trace")


def _traces(view, **kw):
    return lambda spark, sf: _joined(conformance.extract_traces(view(spark, sf), **kw), "trace").select("case_id", "trace", "truncated")


def trace_sql(view: str, where: str = "true", collapse: bool = False, most: int = 0) -> str:
    keep = "QUALIFY activity IS DISTINCT FROM lag(activity) OVER (PARTITION BY case_id ORDER BY timestamp, _seq)" if collapse else ""
    cut = f"list_slice(t, 1, {most})" if most else "t"
    return with_views(view, f"""+ k AS (SELECT * FROM {view} WHERE {where} {keep}),
      g AS (SELECT case_id, list(activity ORDER BY timestamp, _seq) AS t FROM k GROUP BY case_id)
      SELECT case_id, array_to_string({cut}, ',') AS trace, {f'len(t) > {most}' if most else 'false'} AS truncated FROM g""")


def _dfg(part, **kw):
    return lambda spark, sf: discovery.dfg_view(views.log(spark, sf), **kw)[part]


EDGES = """+ f AS (SELECT activity AS source, lead(activity) OVER (PARTITION BY case_id ORDER BY timestamp, _seq) AS target,
   timestamp, lead(timestamp) OVER (PARTITION BY case_id ORDER BY timestamp, _seq) AS next_at FROM log),
 edges AS (SELECT source, target, count(*) AS count FROM f WHERE target IS NOT NULL GROUP BY ALL),
 nodes AS (SELECT activity, count(*) AS count FROM log GROUP BY ALL)"""
EGO = """, k AS (SELECT * FROM edges ORDER BY count DESC, source, target LIMIT 4),
 seen AS (SELECT 'click' AS a UNION SELECT target FROM k WHERE source = 'click' UNION SELECT source FROM k WHERE target = 'click')"""


def plot_nodes(spark, sf):
    return _rounded(discovery.plot_nodes(discovery.dfg_nodes(views.log(spark, sf))), "size")


def plot_edges(spark, sf):
    log = views.log(spark, sf)
    return discovery.plot_edges(discovery.dfg_edges(log), discovery.plot_nodes(discovery.dfg_nodes(log), 3))


def edge_performance(spark, sf):
    return _rounded(discovery.edge_performance(views.log(spark, sf)), "mean_min", "median_min", "p90_min")


def conformance_detail(spark, sf):
    got = conformance.check(conformance.extract_traces(views.log_day(spark, sf)), PROTOCOL)
    return _joined(conformance.case_detail(got), "matched_events", "extra_events")


PROTOCOL = "view -> click -> purchase"
STEPS = ("view", "click", "purchase")


def _check(mode, view=views.log_day, **kw):
    def run(spark, sf):
        cfg = conformance.ConformanceConfig(mode=mode, **kw)
        got = conformance.check(conformance.extract_traces(view(spark, sf)), PROTOCOL, cfg)
        return _joined(got, "missing_steps", "matched_positions", "trace_preview")

    return run


def check_sql(mode: str, at_start: bool = False, columns: str = "*") -> str:
    """Conformance in SQL over lists; the alignment is one chained step each."""
    chain, prev = "", "a0"
    for i, step in enumerate(STEPS, 1):
        chain += f""", r{i} AS (SELECT *, coalesce(list_position(list_slice(t, j + 1, len(t)), '{step}'), 0) AS f FROM {prev}),
          a{i} AS (SELECT case_id, t, CASE WHEN f > 0 THEN j + f ELSE j END AS j,
            CASE WHEN f > 0 THEN list_append(mt, CAST(j + f - 1 AS BIGINT)) ELSE mt END AS mt,
            CASE WHEN f > 0 THEN missing ELSE list_append(missing, '{step}') END AS missing FROM r{i})"""
        prev = f"a{i}"
    goal = "[" + ", ".join(f"'{x}'" for x in STEPS) + "]"
    n = len(STEPS)
    order = "CASE WHEN list_has_any(t, missing) THEN 'order_violation' WHEN len(missing) > 0 THEN 'missing_steps' ELSE 'mismatch' END"
    first = f"CAST(list_min(list_filter(range(greatest(len(t), {n})), lambda i: t[i + 1] IS DISTINCT FROM {goal}[i + 1])) AS INT)"
    starts = f"list_filter(range(greatest(len(t) - {n} + 1, 0)), lambda i: list_slice(t, i + 1, i + {n}) = {goal})"
    block = f"CASE WHEN list_slice(t, 1, {n}) = {goal} THEN 0 END" if at_start or mode == "prefix" else f"list_min({starts})"
    counts = {x: f"len(list_filter(t, lambda x: x = '{x}'))" for x in STEPS}
    if mode == "exact":
        ok = f"t = {goal}"
        lack = "list_concat(" + ", ".join(f"list_filter(['{x}'], lambda x: {c} < 1)" for x, c in counts.items()) + ")"
        known = " + ".join(f"least({c}, 1)" for c in counts.values())
        parts = (ok, f"CASE WHEN {ok} THEN 'none' WHEN len({lack}) > 0 THEN 'missing_steps' WHEN len(t) - ({known}) > 0 THEN 'extra_events' ELSE 'mismatch' END",
                 f"CASE WHEN {ok} THEN [] ELSE {lack} END", f"CASE WHEN {ok} THEN 0 ELSE len(t) - ({known}) END", f"CASE WHEN {ok} THEN range({n}) ELSE [] END",
                 f"CASE WHEN NOT ({ok}) THEN {first} END")
    elif mode == "subsequence":
        ok = "len(missing) = 0"
        parts = (ok, f"CASE WHEN {ok} AND len(t) = len(mt) THEN 'none' WHEN {ok} THEN 'extra_events' ELSE {order} END", "missing", "len(t) - len(mt)", "mt", "CAST(NULL AS INT)")
    else:
        ok, extra = f"({block}) IS NOT NULL", f"greatest(len(t) - {n}, 0)"
        good = "'none'" if mode == "prefix" else f"CASE WHEN {extra} = 0 THEN 'none' ELSE 'extra_events' END"
        short = f"CAST(list_min(list_filter(range(len(t)), lambda i: i >= {n} OR t[i + 1] IS DISTINCT FROM {goal}[i + 1])) AS INT)"
        parts = (ok, f"CASE WHEN {ok} THEN {good} ELSE {order} END", f"CASE WHEN {ok} THEN [] ELSE missing END", extra,
                 f"CASE WHEN {ok} THEN list_transform(range({n}), lambda i: i + ({block})) ELSE mt END",
                 f"CASE WHEN NOT ({ok}) THEN {short} END" if mode == "prefix" else "CAST(NULL AS INT)")
    c, d, m, e, p, f = parts
    return with_views("day", f"""+ a0 AS (SELECT case_id, list(activity ORDER BY timestamp, _seq) AS t, 0 AS j, CAST([] AS BIGINT[]) AS mt,
        CAST([] AS VARCHAR[]) AS missing FROM day GROUP BY case_id) {chain},
      w AS (SELECT case_id, t, {c} AS conforms, {d} AS deviation_type, {m} AS ms, {e} AS ex, {p} AS mp, {f} AS fd FROM {prev}),
      per_case AS (SELECT case_id, conforms, '{mode}' AS mode, CAST(len(t) AS INT) AS trace_length, {n} AS protocol_length, deviation_type,
        array_to_string(ms, ',') AS missing_steps, CAST(len(ms) AS INT) AS missing_count, CAST(ex AS INT) AS extra_events_count,
        array_to_string(mp, ',') AS matched_positions, CAST(len(mp) AS INT) AS matched_count, fd AS first_deviation_index,
        array_to_string(list_slice(t, 1, 25), ',') AS trace_preview FROM w)
      SELECT {columns} FROM per_case""")


def _subsequence(spark, sf):
    return conformance.check(conformance.extract_traces(views.log_day(spark, sf)), PROTOCOL)


def drilldown(spark, sf):
    got = conformance.drilldown(_subsequence(spark, sf), conforms=False, rows=20)
    return got.select("case_id", "deviation_type", "missing_count", "extra_events_count")


QUERIES = {
    "scan_parquet": lambda s, d: _rounded(views.table(s, d, "events").select("event_id", "user_id", "event_type", "value"), "value"),
    "scan_csv": scan_csv,
    "log_profile": lambda s, d: logs.profile(views.log(s, d)),
    "event_log_build": event_log_build,
    "timestamp_coerce": timestamp_coerce,
    "drop_missing_core": lambda s, d: logs.drop_missing_core(views.log_dirty(s, d)).select("case_id", "activity", "timestamp", "_seq"),
    "ignore_activities": lambda s, d: logs.ignore_activities(views.log(s, d), ["error", "view"]).select("case_id", "activity", "_seq"),
    "normalize_activity": normalize_activity,
    "relabel_activities": relabel_activities,
    "filter_numeric_range": lambda s, d: logs.filter_range(views.log(s, d), "value", 10.0, 20.0).select("_seq"),
    "filter_categorical": lambda s, d: logs.filter_values(views.log(s, d), "activity", ["click", "view"]).select("_seq", "activity"),
    "coerce_numeric": coerce_numeric,
    "canon_essentials": lambda s, d: canonical.tag(views.log_dirty(s, d), canonical.CanonicalConfig()).where("drop_reason is distinct from 'essentials'").select("case_id", "activity", "_seq"),
    "canon_drop_midnight": _canon(canonical.CanonicalConfig(step_rules={"view": canonical.StepRule(drop_if_midnight=True)})),
    "canon_drop_missing_cov": _canon(canonical.CanonicalConfig(covariate="resource", step_rules={"click": canonical.StepRule(drop_if_missing_covariate=True)})),
    "canon_unstable_rows": _canon(canonical.CanonicalConfig(unstable_columns=("resource", "value"), unstable_missing_mode="drop_rows")),
    "canon_unstable_cases": _canon(canonical.CanonicalConfig(unstable_columns=("resource", "value"), unstable_missing_mode="drop_cases")),
    "canon_unstable_steps": _canon(canonical.CanonicalConfig(unstable_columns=("resource",), unstable_missing_mode="drop_rows_for_steps_only", unstable_steps_scope=("error",))),
    "canon_dedup": _canon(canonical.CanonicalConfig()),
    "canon_priority_order": _canon(canonical.CanonicalConfig(step_rules={"view": canonical.StepRule(priority_rank=10)})),
    "canon_terminal_push": _canon(canonical.CanonicalConfig(terminal_steps=("purchase",), enforce_monotonic_time=False)),
    "canon_terminal_rollday": _canon(canonical.CanonicalConfig(terminal_steps=("purchase",), enforce_monotonic_time=False, terminal_fix_mode="roll_day_if_midnight_and_backwards")),
    "canon_monotonic": _canon(canonical.CanonicalConfig(terminal_steps=("purchase",))),
    "canon_full": _canon(FULL),
    "canon_report": canon_report,
    "canon_dropped_by_step": lambda s, d: canonical.dropped_by_step(views.log_dirty(s, d), FULL),
    "sort_events": sort_events,
    "head_per_case": lambda s, d: anomaly.head(views.log(s, d), 3).select("case_id", "_seq"),
    "top_k_activities": lambda s, d: views.log_ship(s, d).groupBy("activity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "activity").limit(3),
    "list_activities": lambda s, d: discovery.list_activities(discovery.dfg_nodes(views.log(s, d)), 3),
    "join_static_left": join_static_left,
    "join_target_inner": join_target_inner,
    "semi_join_nodes": lambda s, d: discovery.incident_nodes(discovery.dfg_nodes(views.log(s, d)), discovery.top_edges(discovery.dfg_edges(views.log(s, d)), 2)),
    "anti_join_bad_cases": anti_join_bad_cases,
    "count_distinct_cases": lambda s, d: views.log_dirty(s, d).agg(F.count_distinct("case_id").alias("n_cases"), F.count_distinct("activity").alias("n_activities")),
    "static_first_non_null": lambda s, d: features.static_features(views.log_dirty(s, d), ["resource"]),
    "lead_next_event": lead_next_event,
    "collapse_consecutive": lambda s, d: anomaly.collapse(views.log(s, d)).select("case_id", "activity", "_seq"),
    "inter_event_gap": inter_event_gap,
    "extract_traces": extract_traces,
    "traces_collapsed": _traces(views.log, ignore=("error",), collapse=True),
    "traces_truncated": _traces(views.log, max_events=10),
    "dfg_edges": lambda s, d: discovery.dfg_edges(views.log(s, d)),
    "dfg_nodes": lambda s, d: discovery.dfg_nodes(views.log(s, d)),
    "dfg_no_self_loops": lambda s, d: discovery.dfg_edges(views.log(s, d), drop_self_loops=True),
    "dfg_filtered_edges": _dfg(0, min_edge_count=10, top_k_edges=8),
    "dfg_filtered_nodes": _dfg(1, min_edge_count=10, top_k_edges=8),
    "dfg_ego_edges": _dfg(0, top_k_edges=4, view_mode="ego", focus="click"),
    "dfg_ego_nodes": _dfg(1, top_k_edges=4, view_mode="ego", focus="click"),
    "dfg_view": _dfg(0, min_edge_count=2, drop_self_loops=True),
    "dfg_plot_nodes": plot_nodes,
    "dfg_plot_edges": plot_edges,
    "dfg_edge_performance": edge_performance,
    "conformance_exact": _check("exact"),
    "conformance_prefix": _check("prefix"),
    "conformance_contiguous": _check("exact_with_extras"),
    "conformance_contiguous_start": _check("exact_with_extras", contiguous_requires_start=True),
    "conformance_subsequence": _check("subsequence"),
    "conformance_summary": lambda s, d: conformance.summary(_subsequence(s, d)),
    "conformance_kpis": lambda s, d: _rounded(conformance.kpis(_subsequence(s, d)), "rate"),
    "conformance_drilldown": drilldown,
    "conformance_case_detail": conformance_detail,
}

_W = "OVER (PARTITION BY case_id ORDER BY timestamp, _seq)"
ORACLES = {
    "scan_parquet": "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events",
    "scan_csv": "SELECT CAST(event_id AS INT) AS event_id, CAST(user_id AS INT) AS user_id, event_type, round(value, 6) AS value FROM events",
    "log_profile": "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM events",
    "event_log_build": "SELECT user_id AS case_id, event_type AS activity, ts AS timestamp, event_id AS _seq, round(value, 6) AS value FROM events",
    "timestamp_coerce": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS parsed FROM events",
    "drop_missing_core": with_views("dirty", "SELECT case_id, activity, timestamp, _seq FROM dirty WHERE activity IS NOT NULL AND timestamp IS NOT NULL"),
    "ignore_activities": with_views("log", "SELECT case_id, activity, _seq FROM log WHERE activity NOT IN ('error', 'view')"),
    "normalize_activity": "SELECT event_type AS activity, count(*) AS n FROM events GROUP BY ALL",
    "relabel_activities": with_views("stages", "SELECT CASE activity WHEN 'consult request' THEN 'error' ELSE activity END AS activity, count(*) AS n FROM stages GROUP BY ALL"),
    "filter_numeric_range": with_views("log", "SELECT _seq FROM log WHERE value BETWEEN 10 AND 20"),
    "filter_categorical": with_views("log", "SELECT _seq, activity FROM log WHERE activity IN ('click', 'view')"),
    "coerce_numeric": "SELECT event_id AS _seq, round(value, 6) AS v, " + ", ".join(f"CAST(event_type = '{a}' AS DOUBLE) AS activity_{a}" for a in sorted(views.STAGES)) + " FROM events",
    "canon_essentials": with_views("dirty", "SELECT case_id, activity, _seq FROM dirty WHERE activity IS NOT NULL AND timestamp IS NOT NULL"),
    "canon_drop_midnight": canon_sql(VIEW_MIDNIGHT),
    "canon_drop_missing_cov": canon_sql("activity = 'click' AND resource IS NULL"),
    "canon_unstable_rows": canon_sql("resource IS NULL OR value IS NULL"),
    "canon_unstable_cases": canon_sql(case_share="resource IS NULL OR value IS NULL"),
    "canon_unstable_steps": canon_sql("resource IS NULL AND activity = 'error'"),
    "canon_dedup": canon_sql(),
    "canon_priority_order": canon_sql(ranks="CASE activity WHEN 'view' THEN 10 ELSE 50 END"),
    "canon_terminal_push": canon_sql(monotone=False, terminal=TERMINAL, ranks="CASE activity WHEN 'purchase' THEN 100 ELSE 50 END"),
    "canon_terminal_rollday": canon_sql(monotone=False, roll=True, terminal=TERMINAL, ranks="CASE activity WHEN 'purchase' THEN 100 ELSE 50 END"),
    "canon_monotonic": canon_sql(terminal=TERMINAL, ranks="CASE activity WHEN 'purchase' THEN 100 ELSE 50 END"),
    "canon_full": canon_sql(VIEW_MIDNIGHT, terminal=TERMINAL, ranks=RANKS, most=1),
    "canon_dropped_by_step": "WITH " + views.SQL["dirty"] + f" SELECT activity, 'midnight' AS drop_reason, count(*) AS count FROM dirty WHERE {VIEW_MIDNIGHT} GROUP BY activity",
    "canon_report": "WITH c AS (" + canon_sql(VIEW_MIDNIGHT, terminal=TERMINAL, ranks=RANKS, most=10**9, columns="case_id, repairs, pushed, repaired") + "), " + views.SQL["dirty"] + f"""
      SELECT (SELECT count(*) FROM dirty) AS n_rows_in, count(*) FILTER (repairs <= 1) AS n_rows_out,
       (SELECT count(DISTINCT case_id) FROM dirty) AS n_cases_in, count(DISTINCT CASE WHEN repairs <= 1 THEN case_id END) AS n_cases_out,
       (SELECT count(*) FROM dirty) - count(*) FILTER (repairs <= 1) AS dropped_rows,
       (SELECT count(*) FROM dirty WHERE {VIEW_MIDNIGHT}) AS dropped_midnight,
       CAST(0 AS BIGINT) AS dropped_missing_covariate, CAST(0 AS BIGINT) AS dropped_unstable_rows, CAST(0 AS BIGINT) AS dropped_unstable_cases,
       (SELECT count(*) FROM dirty WHERE activity IS NOT NULL AND NOT ({VIEW_MIDNIGHT})) - count(*) AS dropped_duplicates,
       count(DISTINCT CASE WHEN pushed THEN case_id END) AS terminal_reordered_cases,
       count(*) FILTER (repaired AND repairs <= 1) AS monotonic_repairs_applied,
       count(DISTINCT CASE WHEN repairs > 1 THEN case_id END) AS backward_cases_flagged,
       (SELECT count(DISTINCT case_id) FROM dirty) - count(DISTINCT CASE WHEN repairs <= 1 THEN case_id END) AS dropped_cases,
       '' AS unstable_columns_used, 'none' AS unstable_missing_mode, 0.3::DOUBLE AS unstable_case_missing_threshold FROM c""",
    "sort_events": with_views("ship", "SELECT case_id, activity, timestamp, _seq, row_number() OVER (PARTITION BY case_id ORDER BY timestamp, _seq, resource, value) AS rn FROM ship"),
    "head_per_case": with_views("log", f"SELECT case_id, _seq FROM log QUALIFY row_number() {_W} <= 3"),
    "top_k_activities": with_views("ship", "SELECT activity, count(*) AS n FROM ship GROUP BY ALL ORDER BY n DESC, activity LIMIT 3"),
    "list_activities": with_views("log", EDGES + " SELECT activity FROM nodes ORDER BY count DESC, activity LIMIT 3"),
    "join_static_left": with_views("dirty", """+ s AS (SELECT case_id, arg_min(resource, (timestamp, _seq)) AS resource FROM dirty WHERE value > 50 AND resource IS NOT NULL GROUP BY case_id),
        c AS (SELECT concat_ws('|', CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%d')) AS case_id, count(*) AS n FROM events GROUP BY ALL)
        SELECT c.case_id, n, resource FROM c LEFT JOIN s ON c.case_id = s.case_id"""),
    "join_target_inner": with_views("ship outcome", """+ f AS (SELECT case_id, count(*) AS n FROM ship GROUP BY ALL)
        SELECT f.case_id, n, CAST(contains(lower(disposition_desc), 'admit') OR contains(lower(disposition_desc), 'admission') OR contains(lower(disposition_desc), 'inpatient') AS INT) AS y
        FROM f JOIN outcome o ON f.case_id = o.case_id WHERE disposition_desc IS NOT NULL"""),
    "semi_join_nodes": with_views("log", EDGES + ", t AS (SELECT * FROM edges ORDER BY count DESC, source, target LIMIT 2) SELECT * FROM nodes WHERE activity IN (SELECT source FROM t UNION SELECT target FROM t)"),
    "anti_join_bad_cases": with_views("log", "SELECT case_id, count(*) AS n FROM log WHERE case_id NOT IN (SELECT case_id FROM log WHERE activity = 'error' GROUP BY case_id HAVING count(*) > 15) GROUP BY ALL"),
    "count_distinct_cases": with_views("dirty", "SELECT count(DISTINCT case_id) AS n_cases, count(DISTINCT activity) AS n_activities FROM dirty"),
    "static_first_non_null": with_views("dirty", "SELECT case_id, arg_min(resource, (timestamp, _seq)) FILTER (resource IS NOT NULL) AS resource FROM dirty GROUP BY case_id"),
    "lead_next_event": with_views("log", f"SELECT _seq, lead(activity) {_W} AS next_activity, lead(timestamp) {_W} AS next_time FROM log"),
    "collapse_consecutive": with_views("log", f"SELECT case_id, activity, _seq FROM log QUALIFY activity IS DISTINCT FROM lag(activity) {_W}"),
    "inter_event_gap": with_views("log", f"SELECT _seq, round(date_diff('microsecond', lag(timestamp) {_W}, timestamp) / 6e7, 6) AS gap FROM log"),
    "extract_traces": with_views("log", "SELECT case_id, string_agg(activity, ',' ORDER BY timestamp, _seq) AS trace FROM log GROUP BY case_id"),
    "traces_collapsed": trace_sql("log", "activity <> 'error'", collapse=True),
    "traces_truncated": trace_sql("log", most=10),
    "dfg_edges": with_views("log", EDGES + " SELECT * FROM edges"),
    "dfg_nodes": with_views("log", EDGES + " SELECT * FROM nodes"),
    "dfg_no_self_loops": with_views("log", EDGES + " SELECT * FROM edges WHERE source <> target"),
    "dfg_filtered_edges": with_views("log", EDGES + ", top AS (SELECT * FROM edges WHERE count >= 10 ORDER BY count DESC, source, target LIMIT 8) SELECT * FROM top"),
    "dfg_filtered_nodes": with_views("log", EDGES + ", top AS (SELECT * FROM edges WHERE count >= 10 ORDER BY count DESC, source, target LIMIT 8) SELECT * FROM nodes WHERE activity IN (SELECT source FROM top UNION SELECT target FROM top)"),
    "dfg_ego_edges": with_views("log", EDGES + EGO + " SELECT * FROM k WHERE source IN (SELECT a FROM seen) AND target IN (SELECT a FROM seen)"),
    "dfg_ego_nodes": with_views("log", EDGES + EGO + " SELECT * FROM nodes WHERE activity IN (SELECT a FROM seen) AND activity IN (SELECT source FROM k UNION SELECT target FROM k)"),
    "dfg_view": with_views("log", EDGES + " SELECT * FROM edges WHERE source <> target AND count >= 2"),
    "dfg_plot_nodes": with_views("log", EDGES + " SELECT activity, count, round(14.0::DOUBLE + 26.0::DOUBLE * count / (SELECT max(count) FROM nodes), 6) AS size, activity || chr(10) || '(' || count || ')' AS label FROM nodes"),
    "dfg_plot_edges": with_views("log", EDGES + """, few AS (SELECT activity FROM nodes ORDER BY count DESC, activity LIMIT 3)
        SELECT source, target, count, CAST(count AS VARCHAR) AS label FROM edges WHERE source IN (FROM few) AND target IN (FROM few)"""),
    "dfg_edge_performance": with_views("log", EDGES + """, m AS (SELECT source, target, date_diff('microsecond', timestamp, next_at) / 6e7 AS took FROM f WHERE target IS NOT NULL)
        SELECT source, target, count(*) AS count, round(avg(took), 6) AS mean_min, round(quantile_cont(took, 0.5), 6) AS median_min, round(quantile_cont(took, 0.9), 6) AS p90_min FROM m GROUP BY ALL"""),
    "conformance_exact": check_sql("exact"),
    "conformance_prefix": check_sql("prefix"),
    "conformance_contiguous": check_sql("exact_with_extras"),
    "conformance_contiguous_start": check_sql("exact_with_extras", at_start=True),
    "conformance_subsequence": check_sql("subsequence"),
    "conformance_summary": check_sql("subsequence", columns="mode, conforms, deviation_type, count(*) AS n_cases") + " GROUP BY mode, conforms, deviation_type",
    "conformance_kpis": check_sql("subsequence", columns="""count(*) AS n_cases, count(*) FILTER (conforms) AS n_conforming, round(count(*) FILTER (conforms) / count(*)::DOUBLE, 6) AS rate,
        (SELECT deviation_type FROM per_case WHERE NOT conforms GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_deviation"""),
    "conformance_drilldown": check_sql("subsequence", columns="case_id, deviation_type, missing_count, extra_events_count") + " WHERE NOT conforms ORDER BY missing_count DESC, extra_events_count DESC, case_id LIMIT 20",
    "conformance_case_detail": check_sql("subsequence", columns="""case_id,
        array_to_string(list_transform(list_filter(CAST(string_split(NULLIF(matched_positions, ''), ',') AS INT[]), lambda i: i < len(string_split(trace_preview, ','))), lambda i: string_split(trace_preview, ',')[i + 1]), ',') AS matched0,
        trace_preview, matched_positions"""),
}
ORACLES["conformance_case_detail"] = f"""WITH x AS ({ORACLES['conformance_case_detail']}),
  y AS (SELECT case_id, coalesce(matched0, '') AS matched_events, string_split(trace_preview, ',') AS tp, coalesce(CAST(string_split(NULLIF(matched_positions, ''), ',') AS INT[]), []) AS mp FROM x)
  SELECT case_id, matched_events, array_to_string(list_transform(list_filter(range(len(tp)), lambda i: NOT list_contains(mp, CAST(i AS INT))), lambda i: tp[i + 1]), ',') AS extra_events FROM y"""
