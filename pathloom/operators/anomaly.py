"""Red-flag cases: long waits and unusual sequences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log as ln

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.ranks import numbers, quantile, quantiles
from pathloom.operators.conformance import MODES
from pathloom.schema import LOG, LogSchema, minutes, require_columns, traces
from pathloom.sources.logs import ignore_activities
from pathloom.sources.tables import written

#: Tokens around a case and for rare activities; events of a preview.
START, END, UNKNOWN = "__START__", "__END__", "__UNK__"
PREVIEW = 12


@dataclass(frozen=True)
class AnomalyConfig:
    ignore: tuple[str, ...] = ()
    #: full_trace, minutes_since_first_event or n_events
    cutoff_type: str = "full_trace"
    cutoff_value: int = 60
    max_events_per_case: int | None = None
    collapse: bool = False
    #: case_total_minutes or activity_dwell_minutes_p95
    wait_metric: str = "case_total_minutes"
    wait_quantile: float = 0.99
    wait_z: float = 3.0
    #: bigram_nll or protocol_deviation
    sequence_method: str = "bigram_nll"
    sequence_quantile: float = 0.99
    vocabulary: int = 50
    smoothing: float = 1.0
    protocol: str = ""
    protocol_mode: str = "subsequence"


def cut(log: DataFrame, kind: str, value: int = 0, s: LogSchema = LOG) -> DataFrame:
    """A case's events up to a cutoff."""
    if kind == "full_trace":
        return log
    if kind == "minutes_since_first_event":
        first = log.withColumn("first_", F.min(s.time).over(s.whole))
        limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(value))
        return first.where(F.col(s.time) <= F.col("first_") + limit).drop("first_")
    if kind == "n_events":
        return head(log, value, s)
    raise ValueError(f"unknown cutoff {kind!r}")


def head(log: DataFrame, n: int, s: LogSchema = LOG) -> DataFrame:
    """The first n events of each case."""
    return log.withColumn("no_", F.row_number().over(s.events)).where(F.col("no_") <= n).drop("no_")


def collapse(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """The first event of each run of one activity."""
    before = log.withColumn("before_", F.lag(s.activity).over(s.events))
    return before.where(F.col("before_").isNull() | (F.col("before_") != F.col(s.activity))).drop("before_")


def prepare(log: DataFrame, cfg: AnomalyConfig, s: LogSchema = LOG) -> DataFrame:
    require_columns(log, s.core)
    rows = ignore_activities(log.dropna(subset=s.core), list(cfg.ignore), s).repartition(s.case)
    rows = cut(rows, cfg.cutoff_type, cfg.cutoff_value, s)
    rows = rows if cfg.max_events_per_case is None else head(rows, cfg.max_events_per_case, s)
    return collapse(rows, s) if cfg.collapse else rows


def case_stats(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """Start, end, length, minutes, the trace and a preview of it."""
    event = F.struct(F.col(s.time).alias("t"), F.col(s.seq).alias("q"), F.col(s.activity).alias("a"))
    out = log.groupBy(s.case).agg(
        F.min(s.time).alias("start_time"),
        F.max(s.time).alias("end_time"),
        F.count(F.lit(1)).alias("trace_length"),
        F.transform(F.sort_array(F.collect_list(event)), lambda e: e["a"]).alias("trace"),
    )
    more = F.when(F.size("trace") > PREVIEW, F.lit(" …")).otherwise(F.lit(""))
    shown = F.concat(F.array_join(F.slice("trace", 1, PREVIEW), " → "), more)
    return out.withColumn("case_total_minutes", minutes("start_time", "end_time")).withColumn("trace_preview", shown)


def _z(value: Column, middle: Column, spread: Column) -> Column:
    return F.when(spread == 0, 0.0).otherwise(F.lit(0.6745) * (value - middle) / spread)


def robust_z(df: DataFrame, column: str, out: str = "z") -> DataFrame:
    """0.6745 (x - median) / MAD; all 0 where the MAD is."""
    middle = df.crossJoin(F.broadcast(quantile(df, column, 0.5, "med_")))
    away = middle.select(F.abs(F.col(column) - F.col("med_")).alias("away_"))
    both = middle.crossJoin(F.broadcast(quantile(away, "away_", 0.5, "mad_")))
    return both.withColumn(out, _z(F.col(column), F.col("med_"), F.col("mad_"))).drop("med_", "mad_")


def wait_values(stats: DataFrame, cfg: AnomalyConfig, intervals: DataFrame | None = None, s: LogSchema = LOG) -> DataFrame:
    """``stats`` with wait_value: a case's minutes, or its longest interval (0
    without one)."""
    if cfg.wait_metric == "case_total_minutes":
        return stats.withColumn("wait_value", F.col("case_total_minutes"))
    if cfg.wait_metric != "activity_dwell_minutes_p95":
        raise ValueError(f"unknown wait_metric {cfg.wait_metric!r}")
    if intervals is None:
        raise ValueError("the dwell metric needs state intervals")
    most = intervals.groupBy(F.col("case_id").alias(s.case)).agg(F.max("duration_minutes").alias("wait_value"))
    return stats.join(most, s.case, "left").withColumn("wait_value", F.coalesce("wait_value", F.lit(0.0)))


def vocabulary(log: DataFrame, k: int, s: LogSchema = LOG) -> list[str]:
    """The k most common activities; ties by name.  At most k values come back."""
    counts = log.groupBy(s.activity).count().orderBy(F.desc("count"), s.activity).limit(k)
    return [r[0] for r in counts.collect()]


def bigrams(log: DataFrame, words: list[str], s: LogSchema = LOG) -> DataFrame:
    """case, before, after: neighbours with a start and an end around each case."""
    known = F.when(F.col(s.activity).isin(words), F.col(s.activity)).otherwise(F.lit(UNKNOWN))
    rows = log.withColumn("word_", known)
    before, after = F.lag("word_").over(s.events), F.lead("word_").over(s.events)
    pairs = rows.select(
        s.case, F.coalesce(before, F.lit(START)).alias("before"), F.col("word_").alias("after"), after.isNull().alias("last_")
    )
    last = F.when(F.col("last_"), F.struct(F.col("after").alias("before"), F.lit(END).alias("after")))
    both = F.filter(F.array(F.struct("before", "after"), last), lambda p: p.isNotNull())
    return pairs.select(s.case, F.inline(both))


def bigram_counts(log: DataFrame, words: list[str], s: LogSchema = LOG) -> DataFrame:
    return bigrams(log, words, s).groupBy("before", "after").count()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _steps(words: list[str]) -> str:
    """Numbers of a trace's steps in SQL, before * (k + 2) + after: an activity
    is its place among the k words or 0, and start and end are k + 1."""
    k = len(words)
    known = f"array({', '.join(map(_quoted, words))})" if words else "cast(array() AS array<string>)"
    codes = f"transform(trace, x -> CAST(array_position({known}, x) AS INT))"
    ahead, behind = f"concat(array({k + 1}), {codes})", f"concat({codes}, array({k + 1}))"
    return f"zip_with({ahead}, {behind}, (a, b) -> a * {k + 2} + b)"


def with_bigram_nll(cases: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """``cases`` (with trace) and seq_score: the mean negative log-probability
    of a case's steps, with add-alpha smoothing, under counts of all cases.

    The k most common activities and the counts of their pairs, at most
    (k + 2) ** 2, come to the driver; a case is scored from its trace alone."""
    counts = cases.selectExpr("explode(trace) AS activity").groupBy("activity").count()
    words = [r[0] for r in counts.orderBy(F.desc("count"), "activity").limit(cfg.vocabulary).collect()]
    steps, size, alpha = _steps(words), len(words) + 2, cfg.smoothing
    seen = {r[0]: r[1] for r in cases.selectExpr(f"explode({steps}) AS step").groupBy("step").count().collect()}
    totals = [sum(n for step, n in seen.items() if step // size == before) for before in range(size)]
    costs = [-ln((seen[i] + alpha) / (totals[i // size] + alpha * size)) if i in seen else 0.0 for i in range(size * size)]
    total = f"aggregate({steps}, 0.0D, (s, i) -> s + {numbers(costs)}[i])"
    return cases.withColumn("seq_score", F.expr(f"{total} / (size(trace) + 1)"))


def bigram_nll(log: DataFrame, cfg: AnomalyConfig = AnomalyConfig(), s: LogSchema = LOG) -> DataFrame:
    """case, seq_score of a log's cases."""
    return with_bigram_nll(traces(log, s), cfg).select(s.case, "seq_score")


def parse_protocol(protocol: str) -> list[str]:
    """Steps between '->' or, without one, between commas."""
    return [x for x in (p.strip() for p in protocol.split("->" if "->" in protocol else ",")) if x]


def protocol_deviation(trace: Column, protocol: list[str], mode: str) -> Column:
    """2 a missing step and 0.5 an extra event."""
    if mode not in MODES:
        raise ValueError(f"unknown protocol mode {mode!r}")
    n, goal = len(protocol), F.array(*[F.lit(x) for x in protocol])
    strange = F.size(F.filter(trace, lambda x: ~x.isin(protocol)))
    if mode == "subsequence":
        reached = F.aggregate(
            trace, F.lit(0), lambda j, x: F.when((j < n) & (x == F.get(goal, j)), j + 1).otherwise(j)
        )
        missing, extra = F.lit(n) - reached, strange
    elif mode == "exact":
        ok = trace == goal
        absent = reduce(lambda a, b: a + b, [(~F.array_contains(trace, x)).cast("int") for x in protocol])
        missing, extra = F.when(ok, 0).otherwise(absent), F.when(ok, 0).otherwise(strange)
    elif mode == "prefix":
        same = reduce(lambda a, b: a + b, [F.coalesce((F.get(trace, F.lit(i)) == x).cast("int"), F.lit(0)) for i, x in enumerate(protocol)])
        missing, extra = F.when(F.slice(trace, 1, n) == goal, 0).otherwise(n - same), F.greatest(F.size(trace) - n, F.lit(0))
    else:
        starts = F.transform(F.sequence(F.lit(1), F.size(trace) - n + 1), lambda i: F.slice(trace, i, n) == goal)
        found = F.coalesce(F.when(F.size(trace) >= n, F.array_contains(starts, F.lit(True))), F.lit(False))
        missing, extra = F.when(found, 0).otherwise(n), F.when(found, F.size(trace) - n).otherwise(strange)
    return missing * 2.0 + extra * 0.5


def sequence_values(cases: DataFrame, cfg: AnomalyConfig) -> DataFrame:
    """``cases`` with seq_score, from their traces."""
    if cfg.sequence_method == "bigram_nll":
        return with_bigram_nll(cases, cfg)
    if cfg.sequence_method != "protocol_deviation":
        raise ValueError(f"unknown sequence_method {cfg.sequence_method!r}")
    protocol = parse_protocol(cfg.protocol)
    if not protocol:
        raise ValueError("the protocol has no steps")
    return cases.withColumn("seq_score", protocol_deviation(F.col("trace"), protocol, cfg.protocol_mode))


def thresholds(scores: DataFrame, cfg: AnomalyConfig) -> dict[str, float | None]:
    """The median and MAD of wait_value, its quantile and that of seq_score:
    two selections, of both columns and of the distances from the median."""
    both = scores.selectExpr("inline(array(struct('wait' AS score, wait_value AS value), struct('sequence' AS score, CAST(seq_score AS DOUBLE) AS value)))")
    wanted = {"median": 0.5, "wait": cfg.wait_quantile, "sequence": cfg.sequence_quantile}
    found = {r["score"]: r for r in quantiles(both, "value", wanted, ["score"], few=True).collect()}
    if not found:
        return dict.fromkeys(("median", "mad", "wait", "sequence"))
    median = found["wait"]["median"]
    mad = quantile(scores.selectExpr(f"abs(wait_value - {median!r}D) AS away"), "away", 0.5, "mad").first()["mad"]
    return {"median": median, "mad": mad, "wait": found["wait"]["wait"], "sequence": found["sequence"]["sequence"]}


def detect(log: DataFrame, cfg: AnomalyConfig = AnomalyConfig(), intervals: DataFrame | None = None, s: LogSchema = LOG) -> DataFrame:
    """One row a case: statistics, scores, flags and reasons.  A flag is given at
    a quantile itself, so at least one case has one.

    Cases with their traces are written as a table first, which is the only
    exchange of events, and then the two values of each case; vocabulary, counts
    of pairs and the four numbers that flags need come to the driver from them."""
    cases = written(wait_values(case_stats(prepare(log, cfg, s), s), cfg, intervals, s), "anomaly-cases")
    valued = sequence_values(cases, cfg)
    limits = thresholds(written(valued.select("wait_value", "seq_score"), "anomaly-scores"), cfg)
    limit = {k: F.lit(v).cast("double") for k, v in limits.items()}
    wait, sequence = F.col("wait_value"), F.col("seq_score")
    scored = valued.withColumn("wait_score", _z(wait, limit["median"], limit["mad"]))
    scored = scored.withColumns({"wait_flag": (wait >= limit["wait"]) | (F.col("wait_score") >= cfg.wait_z), "seq_flag": sequence >= limit["sequence"]})
    flags = {"long_wait": "wait_flag", "unusual_sequence": "seq_flag"}
    reasons = F.concat_ws(",", *[F.when(F.col(f), F.lit(n)) for n, f in flags.items()])
    return scored.withColumns({
        "red_flag": F.col("wait_flag") | F.col("seq_flag"),
        "red_flag_reasons": reasons,
        "combined_score": F.coalesce("wait_score", F.lit(0.0)) + F.coalesce("seq_score", F.lit(0.0)),
    })


def by_severity(found: DataFrame, s: LogSchema = LOG) -> DataFrame:
    keys = ("red_flag", "combined_score", "case_total_minutes", "trace_length")
    return found.orderBy(*[F.desc(k) for k in keys], s.case)


def summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count(F.lit(1)).alias("n_cases"),
        *[F.count_if(c).alias(f"n_{c}") for c in ("red_flag", "wait_flag", "seq_flag")],
    )
