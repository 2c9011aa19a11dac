"""Case features and targets for outcome prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import resampling, stats
from pathloom.functions.ranks import quantile
from pathloom.operators.anomaly import cut, vocabulary
from pathloom.schema import LOG, LogSchema, minutes

#: Keywords of dispositions.
ADMISSION = ("admit", "admission", "inpatient")
LWBS = ("lwbs", "left without being seen", "left after triage")


def first_known(column: str, s: LogSchema = LOG) -> Column:
    """A case's first value that isn't null."""
    order = F.struct(F.col(s.time), F.col(s.seq))
    return F.min_by(column, F.when(F.col(column).isNotNull(), order))


def top_values(log: DataFrame, column: str, k: int) -> list[str]:
    """At most k values, by count and then value."""
    counts = log.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).count()
    return [r[0] for r in counts.orderBy(F.desc("count"), "v").limit(k).collect()]


def static_features(log: DataFrame, columns: list[str], s: LogSchema = LOG) -> DataFrame:
    return log.groupBy(s.case).agg(*[first_known(c, s).alias(c) for c in columns])


def case_features(
    log: DataFrame, activities: list[str], resources: list[str] | None = None, s: LogSchema = LOG, one_hot_last: bool = True
) -> DataFrame:
    """All features of a case from one aggregation: counts of the listed
    activities and resources, the last activity as flags (others: OTHER), the
    length, minutes and the start's hour and weekday (Monday 0)."""
    act = F.col(s.activity).cast("string")
    order = F.struct(F.col(s.time), F.col(s.seq))
    sums = [F.count_if(act == a).alias(f"act_count::{a}") for a in activities]
    sums += [F.count_if(F.col(s.resource).cast("string") == r).alias(f"res_count::{r}") for r in resources or []]
    out = log.groupBy(s.case).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(s.time).alias("start_"),
        F.max(s.time).alias("end_"),
        F.max_by(act, order).alias("last_"),
        *sums,
    )
    last = F.when(F.col("last_").isin(activities), F.col("last_")).otherwise("OTHER")
    flags = [(last == a).cast("long").alias(f"last_act_{a}") for a in [*activities, "OTHER"]] if one_hot_last else []
    return out.select(
        s.case,
        "n_events",
        minutes("start_", "end_").alias("elapsed_minutes"),
        F.hour("start_").cast("long").alias("hour"),
        F.weekday("start_").cast("long").alias("dayofweek"),
        *[f"`{c}`" for c in out.columns if "::" in c],
        *flags,
    )


def arrival_times(log: DataFrame, arrival: str | None = None, s: LogSchema = LOG) -> DataFrame:
    """The first arrival event, or else the first event."""
    first = F.min(s.time)
    at = F.coalesce(F.min(F.when(F.col(s.activity) == arrival, F.col(s.time))), first) if arrival else first
    return log.groupBy(s.case).agg(at.alias("arrival_time"))


def keyword_target(log: DataFrame, column: str, keywords: tuple[str, ...], s: LogSchema = LOG) -> DataFrame:
    """1 if a case's first known value contains a keyword; cases without a value
    aren't in the result."""
    found = log.groupBy(s.case).agg(first_known(column, s).alias("v")).where("v is not null")
    text, hit = F.lower(F.trim(F.col("v").cast("string"))), F.lit(False)
    for word in keywords:
        hit = hit | text.contains(word)
    return found.select(s.case, hit.cast("int").alias("y"))


def time_to_event_target(
    log: DataFrame, event: str, cutoff_type: str, cutoff_value: int, most: float = 1440.0, s: LogSchema = LOG
) -> DataFrame:
    """Minutes from a case's cutoff to its first such event; earlier events and
    more than ``most`` minutes aren't in the result.  The cutoff is a time after
    the first event, or the n-th event (the last, of fewer)."""
    target = F.min(F.when(F.col(s.activity) == event, F.col(s.time))).alias("event_")
    if cutoff_type == "minutes_since_first_event":
        limit = F.min(s.time) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(cutoff_value))
        rows = log.groupBy(s.case).agg(target, limit.alias("cutoff_"))
    elif cutoff_type == "n_events":
        numbered = log.withColumn("no_", F.row_number().over(s.events))
        nth = F.max(F.when(F.col("no_") == cutoff_value, F.col(s.time)))
        rows = numbered.groupBy(s.case).agg(target, F.coalesce(nth, F.max(s.time)).alias("cutoff_"))
    else:
        raise ValueError(f"unknown cutoff {cutoff_type!r}")
    y = minutes("cutoff_", "event_")
    return rows.select(s.case, y.alias("y")).where((F.col("y") >= 0) & (F.col("y") <= most))


def build_target(log: DataFrame, name: str, s: LogSchema = LOG, **settings) -> DataFrame:
    """prob_admission, prob_lwbs or remaining_time_to_pia."""
    if name == "prob_admission":
        return keyword_target(log, settings.get("column", "disposition_desc"), ADMISSION, s)
    if name == "prob_lwbs":
        return keyword_target(log, settings.get("column", "disposition_desc"), LWBS, s)
    if name == "remaining_time_to_pia":
        kind, value = settings.get("cutoff_type", "minutes_since_first_event"), settings.get("cutoff_value", 60)
        return time_to_event_target(log, settings.get("event", "PIA"), kind, value, s=s)
    raise ValueError(f"unknown target {name!r}")


def prediction_dataset(
    log: DataFrame,
    target: DataFrame,
    cutoff_type: str,
    cutoff_value: int,
    static: tuple[str, ...] = (),
    top_k: int = 50,
    s: LogSchema = LOG,
    include_activities: bool = True,
    include_last: bool = True,
    include_times: bool = True,
    include_resources: bool = False,
) -> DataFrame:
    """Features as of the cutoff, static values of the whole log, and y.  The
    switches leave out counts of activities, flags of the last one, minutes,
    hour and weekday, or add counts of the top_k resources."""
    early = cut(log, cutoff_type, cutoff_value, s)
    resources = top_values(early, s.resource, top_k) if include_resources and s.resource in log.columns else None
    out = case_features(early, vocabulary(early, top_k, s), resources, s, include_last)
    gone = [c for c in out.columns if not include_activities and c.startswith("act_count::")]
    gone += [] if include_times else ["elapsed_minutes", "hour", "dayofweek"]
    out = out.drop(*gone)
    if static:
        out = out.join(static_features(log, list(static), s), s.case, "left")
    return out.join(target, s.case)


def coerce_numeric(df: DataFrame, keys: list[str], share: float = 0.9, most: int = 50) -> DataFrame:
    """All but the keys as doubles: text that mostly reads as numbers is cast,
    text of few values becomes flags (null: NA), other text goes."""
    text = [c for c, kind in df.dtypes if kind == "string" and c not in keys]
    plan = df
    if text:
        asked = [x for c in text for x in (
            F.avg(F.col(f"`{c}`").try_cast("double").isNotNull().cast("double")),
            F.count_distinct(F.coalesce(F.col(f"`{c}`"), F.lit("NA"))),
        )]
        found = df.agg(*[e.alias(f"x{i}") for i, e in enumerate(asked)]).first()
    out = [F.col(f"`{k}`") for k in keys]
    for c, kind in df.dtypes:
        if c in keys:
            continue
        col = F.col(f"`{c}`")
        if c not in text:
            out.append(col.cast("double").alias(c))
        elif (found[2 * text.index(c)] or 0.0) > share:
            out.append(col.try_cast("double").alias(c))
        elif found[2 * text.index(c) + 1] <= most:
            value = F.coalesce(col, F.lit("NA"))
            for v in sorted(r[0] for r in df.select(value).distinct().limit(most).collect()):
                out.append((value == v).cast("double").alias(f"{c}_{v}"))
    return plan.select(*out)


def target_summary(values: DataFrame, name: str, task: str, column: str = "y", order: list[str] | None = None, n_boot: int = 2000) -> DataFrame:
    """One row of a target: target, n_cases, rate, mean, median and p90 with
    _ci_low and _ci_high each.  Two classes have a rate (Wilson), numbers the
    others (bootstraps); what a task doesn't have is null."""
    known = values.where(F.col(column).isNotNull())
    names = [f"{x}{ci}" for x in ("rate", "mean", "median", "p90") for ci in ("", "_ci_low", "_ci_high")]
    out = known.agg(F.lit(name).alias("target"), F.count(F.lit(1)).alias("n_cases"), F.sum(F.col(column).cast("long") if task == "binary" else F.lit(0)).alias("hits"))
    if task == "binary":
        low, high = stats.wilson(F.col("hits"), F.col("n_cases"))
        out = out.withColumns({"rate": F.col("hits") / F.nullif(F.col("n_cases"), F.lit(0)), "rate_ci_low": low, "rate_ci_high": high})
    elif task == "regression":
        out = out.crossJoin(F.broadcast(resampling.bootstrap_cis(known, column, order or [column], n_boot=n_boot)))
    else:
        raise ValueError(f"unknown task {task!r}")
    return out.select("target", "n_cases", *[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in names])


def historical_baselines(log: DataFrame, disposition: str, event: str, cutoff_type: str, cutoff_value: int, s: LogSchema = LOG) -> DataFrame:
    """One row: admission_rate, lwbs_rate, median_minutes to the event."""
    rates = [keyword_target(log, disposition, words, s).agg(F.avg("y").alias(n)) for n, words in (("admission_rate", ADMISSION), ("lwbs_rate", LWBS))]
    waits = time_to_event_target(log, event, cutoff_type, cutoff_value, s=s)
    return rates[0].crossJoin(rates[1]).crossJoin(quantile(waits, "y", 0.5, "median_minutes"))


def profile_row(spark: SparkSession, columns: list[str], values: dict[str, float]) -> DataFrame:
    """One case to predict: zeros, and the values that are given (of columns
    that the model has)."""
    return spark.range(1).select(*[F.lit(float(values.get(c, 0.0))).alias(c) for c in columns])
