"""Queue mining: time in state, queue length over time, waiting times."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.ranks import quantiles
from pathloom.operators.canonical import CanonicalConfig, canonicalize, report
from pathloom.schema import LOG, LogSchema, require_columns

#: Minutes between points of the grid, by name.
MINUTES = {"5min": 5, "15min": 15, "30min": 30, "1h": 60, "1H": 60}
#: Names that stand in for each other.
CASES = ("visit_id", "case_id")
INTERVAL_COLUMNS = ("case_id", "state", "start_time", "end_time", "covariate_value", "duration_seconds", "duration_minutes", "date")


@dataclass(frozen=True)
class QueueConfig:
    end_rule: str = "next_event_time"
    collapse_consecutive_same_state: bool = False
    max_events_per_case: int | None = None
    covariate: str | None = None
    terminal_states: tuple[str, ...] = ()


def state_intervals(log: DataFrame, cfg: QueueConfig = QueueConfig(), s: LogSchema = LOG) -> DataFrame:
    """From each event to the case's next one (or its end); positive durations."""
    require_columns(log, s.core)
    if cfg.end_rule not in ("next_event_time", "case_end_time"):
        raise ValueError(f"unknown end_rule {cfg.end_rule!r}")
    rows = log.dropna(subset=s.core).repartition(s.case)
    if cfg.max_events_per_case is not None:
        rows = rows.withColumn("event_no", F.row_number().over(s.events)).where(F.col("event_no") <= cfg.max_events_per_case)
    latest = W.partitionBy(s.case, s.time, s.activity).orderBy(F.desc(s.seq))
    rows = rows.withColumn("copy_no", F.row_number().over(latest)).where("copy_no = 1")
    rows = rows.withColumns({"next_time": F.lead(s.time).over(s.events), "next_state": F.lead(s.activity).over(s.events)})
    if cfg.collapse_consecutive_same_state:
        rows = rows.where(F.col("next_state").isNull() | (F.col("next_state") != F.col(s.activity)))
    end = F.col("next_time") if cfg.end_rule == "next_event_time" else F.max(s.time).over(s.whole)
    has = cfg.covariate is not None and cfg.covariate in log.columns
    covariate = F.col(cfg.covariate).cast("string") if has else F.lit(None).cast("string")
    took = F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time"))
    named = rows.select(
        F.col(s.case).alias("case_id"),
        F.col(s.activity).cast("string").alias("state"),
        F.col(s.time).alias("start_time"),
        end.alias("end_time"),
        covariate.alias("covariate_value"),
    ).where("end_time is not null")
    return named.where(took > 0).select(
        "case_id", "state", "start_time", "end_time", "covariate_value",
        (took / 1e6).alias("duration_seconds"), (took / 6e7).alias("duration_minutes"),
        F.date_format("start_time", "yyyy-MM-dd").alias("date"),
    )


def _deltas(intervals: DataFrame) -> DataFrame:
    """+1 at each start, -1 at each end; one scan."""
    ends = F.array(
        F.struct(F.col("start_time").alias("timestamp"), F.lit(1).alias("delta")),
        F.struct(F.col("end_time").alias("timestamp"), F.lit(-1).alias("delta")),
    )
    return intervals.select("state", F.inline(ends))


def _running(changes: DataFrame, n: str) -> DataFrame:
    """Running sum of ``n`` by state in two levels: within days, and of days, so
    that a state's whole history isn't sorted by one task."""
    day = changes.withColumn("day_", F.to_date("timestamp"))
    totals = day.groupBy("state", "day_").agg(F.sum(n).alias("of_day"))
    before = W.partitionBy("state").orderBy("day_").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("of_day").over(before), F.lit(0))).drop("of_day")
    within = W.partitionBy("state", "day_").orderBy("timestamp", n).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = day.withColumn("so_far", F.sum(n).over(within)).join(totals, ["state", "day_"])
    return summed.withColumn("queue_length", F.col("base") + F.col("so_far")).drop("day_", "base", "so_far")


def change_points(intervals: DataFrame) -> DataFrame:
    """state, timestamp, delta, queue_length; departures go first at a time."""
    return _running(_deltas(intervals), "delta")


def sampled(intervals: DataFrame, freq: str = "15min", start: str | None = None, end: str | None = None) -> DataFrame:
    """Queue length of each state on a grid from the first change (or ``start``)
    to the last (or ``end``); as-of.

    A level of a state makes the grid points from its time to the next level's,
    and a state's first level those before it, which are 0, so no point is
    looked up.  Levels are put in order within days, and days within a state."""
    epoch, minute = "timestamp_ntz'1970-01-01 00:00:00'", MINUTES[freq]
    step = minute * 60_000_000
    micros = lambda t: f"timestampdiff(MICROSECOND, {epoch}, {t})"
    ends = f"inline(array(struct({micros('start_time')} AS at, 1 AS delta), struct({micros('end_time')} AS at, -1 AS delta)))"
    changes = intervals.where("state IS NOT NULL").selectExpr("state", ends).where("at IS NOT NULL").selectExpr("*", "floor(at / 86400000000) AS day_").where("day_ IS NOT NULL")
    # Nulls went before the exchange, and the span asks for deltas too: so all uses of the exchange are one.
    net = changes.repartition("state", "day_").groupBy("state", "day_", "at").agg(F.sum("delta").alias("net"))
    in_day, by_day = "PARTITION BY state, day_ ORDER BY at", "PARTITION BY state ORDER BY day_"
    levels = net.selectExpr("state", "day_", "at", f"sum(net) OVER ({in_day} ROWS UNBOUNDED PRECEDING) AS so_far", f"lead(at) OVER ({in_day}) AS next_at")
    totals = net.groupBy("state", "day_").agg(F.sum("net").alias("of_day"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    days = totals.selectExpr(
        "state", "day_",
        f"coalesce(sum(of_day) OVER ({by_day} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base",
        f"lead(first_at) OVER ({by_day}) AS next_day",
        f"if(lag(day_) OVER ({by_day}) IS NULL, first_at, NULL) AS opens",
    )
    edge = lambda given, found: micros(f"CAST('{given}' AS TIMESTAMP_NTZ)") if given else f"{found}(if(of_day IS NOT NULL, {found}_at, NULL))"
    low, high = edge(start, "first").replace("first(", "min("), edge(end, "last").replace("last(", "max(")
    span = totals.selectExpr(f"{low} AS lo", f"{high} AS hi") if not (start and end) else totals.limit(1).selectExpr(f"{low} AS lo", f"{high} AS hi")
    # The number of the first grid point that isn't before a time.
    point = lambda t: f"-floor((lo - {t}) / {step}D)"
    known = levels.join(days, ["state", "day_"]).crossJoin(F.broadcast(span)).selectExpr(
        "state", "lo", "base + so_far AS level", "at = opens AS opening", f"{point('at')} AS a", f"{point('coalesce(next_at, next_day)')} AS b", f"floor((hi - lo) / {step}D) AS most"
    )
    # Points a to b, as far as the grid goes, at a level.
    own = "struct(greatest(a, 0L) AS a, least(coalesce(b - 1, most), most) AS b, CAST(level AS DOUBLE) AS queue_length)"
    before = "struct(0L AS a, least(a - 1, most) AS b, 0.0D AS queue_length)"
    parts = known.selectExpr("state", "lo", f"inline(if(opening, array({before}, {own}), array({own})))").where("a <= b")
    grid = parts.selectExpr("state", "lo", "queue_length", "explode(sequence(a, b)) AS i")
    return grid.selectExpr("state", f"timestampadd(MICROSECOND, lo + i * {step}, {epoch}) AS timestamp", "queue_length")


def wait_summary(intervals: DataFrame, by: str = "state", duration: str = "duration_minutes") -> DataFrame:
    """Count, mean, exact quantiles and maximum; null groups stay."""
    wanted = {"median_min": 0.5, "p75_min": 0.75, "p90_min": 0.9, "p95_min": 0.95}
    also = {"n_intervals": f"count(`{duration}`)", "mean_min": f"avg(`{duration}`)", "max_min": f"max(`{duration}`)"}
    return quantiles(intervals, duration, wanted, [by], also).select(by, "n_intervals", "mean_min", *wanted, "max_min")


def box_stats(intervals: DataFrame, by: str = "state", duration: str = "duration_minutes") -> DataFrame:
    """Five numbers, the spread and the fences of a box plot."""
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    out = quantiles(intervals, duration, wanted, [by], {"min": f"min(`{duration}`)", "max": f"max(`{duration}`)"})
    iqr: Column = F.col("q3") - F.col("q1")
    out = out.select(by, "min", *wanted, "max").withColumn("iqr", iqr)
    return out.withColumn("low_fence", F.col("q1") - 1.5 * iqr).withColumn("high_fence", F.col("q3") + 1.5 * iqr)


def run_queue_mining(
    log: DataFrame, cfg: QueueConfig = QueueConfig(), freq: str | None = "15min", canonical: CanonicalConfig | None = None, s: LogSchema = LOG
) -> dict[str, DataFrame]:
    """intervals, change_points, sampled (with a freq), summary and, with a
    canonical config, report; terminal states of either config are left out of
    the summary alone, which is sorted by mean wait.  A log without the case
    column that has visit_id or case_id instead goes by that."""
    if s.case in CASES and s.case not in log.columns:
        s = replace(s, case=next((c for c in CASES if c in log.columns), s.case))
    rows = canonicalize(log, canonical, s) if canonical is not None else log
    intervals = state_intervals(rows, cfg, s)
    waits = wait_summary(intervals)
    terminal = {*cfg.terminal_states, *(canonical.terminals if canonical is not None else ())}
    if terminal:
        waits = waits.where(~F.col("state").isin(sorted(terminal)))
    out = {"intervals": intervals, "change_points": change_points(intervals), "summary": waits.orderBy(F.desc("mean_min"), "state")}
    if canonical is not None:
        out["report"] = report(log, canonical, s)
    return out | ({"sampled": sampled(intervals, freq)} if freq else {})
