"""Conformance of traces to a linear protocol, as array expressions.

The protocol is a constant, so a check is one projection over traces(case,
trace) without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.schema import LOG, LogSchema, traces
from pathloom.sources.logs import ignore_activities

MODES = ("exact", "prefix", "exact_with_extras", "subsequence")
PREVIEW = 25


@dataclass(frozen=True)
class ConformanceConfig:
    mode: str = "subsequence"
    contiguous_requires_start: bool = False
    collapse: bool = False
    ignore: tuple[str, ...] = ()


def parse_protocol(protocol: str | list[str] | tuple[str, ...], arrows: tuple[str, ...] = ("->", "→")) -> list[str]:
    """Steps between arrows, or a list's items; trimmed, empty ones left out."""
    if isinstance(protocol, str):
        for arrow in arrows:
            protocol = protocol.replace(arrow, "->")
        protocol = protocol.split("->")
    return [x for x in (str(p).strip() for p in protocol) if x]


def collapse_list(steps: list[str]) -> list[str]:
    return [x for i, x in enumerate(steps) if not i or x != steps[i - 1]]


def collapsed(trace: Column) -> Column:
    """Runs of one activity become one."""
    return F.filter(trace, lambda x, i: (i == 0) | (x != F.get(trace, i - 1)))


def extract_traces(
    log: DataFrame, s: LogSchema = LOG, ignore: tuple[str, ...] = (), collapse: bool = False, max_events: int | None = None
) -> DataFrame:
    """case, trace, truncated."""
    out = traces(ignore_activities(log, list(ignore), s), s)
    if collapse:
        out = out.withColumn("trace", collapsed(F.col("trace")))
    if max_events is None:
        return out.withColumn("truncated", F.lit(False))
    return out.withColumn("truncated", F.size("trace") > max_events).withColumn("trace", F.slice("trace", 1, max_events))


def _literal(steps: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in steps])


def _count(trace: Column, step: str) -> Column:
    return F.size(F.filter(trace, lambda x: x == step))


def _align(trace: Column, proto: list[str]) -> tuple[Column, Column, Column]:
    """Greedy leftmost alignment: (positions, missing steps, whether a missing
    step occurs anywhere).  A missing step leaves the pointer where it is."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("j"), F.array().cast("array<int>").alias("at"), none.alias("missing"))

    def step(state: Column, want: Column) -> Column:
        rest = F.slice(trace, state["j"] + 1, F.greatest(F.size(trace) - state["j"], F.lit(0)))
        found = F.array_position(rest, want).cast("int")
        hit = F.struct(
            (state["j"] + found).alias("j"),
            F.concat(state["at"], F.array(state["j"] + found - 1)).alias("at"),
            state["missing"].alias("missing"),
        )
        miss = F.struct(state["j"].alias("j"), state["at"].alias("at"), F.concat(state["missing"], F.array(want)).alias("missing"))
        return F.when(found > 0, hit).otherwise(miss)

    done = F.aggregate(_literal(proto), start, step)
    return done["at"], done["missing"], F.exists(done["missing"], lambda m: F.array_contains(trace, m))


def _first_mismatch(trace: Column, other: Column) -> Column:
    same = F.zip_with(trace, other, lambda a, b: a.eqNullSafe(b))
    at = F.array_position(same, F.lit(False)).cast("int")
    return F.when(at > 0, at - 1)


def _block_start(trace: Column, proto: list[str], at_start: bool) -> Column:
    """Where the protocol stands as one block (0-based), or null."""
    n, goal = len(proto), _literal(proto)
    if at_start:
        return F.when(F.slice(trace, 1, n) == goal, F.lit(0))
    starts = F.transform(F.sequence(F.lit(1), F.size(trace) - n + 1), lambda i: F.slice(trace, i, n) == goal)
    at = F.when(F.size(trace) >= n, F.array_position(starts, F.lit(True)).cast("int"))
    return F.when(at > 0, at - 1)


def check(found: DataFrame, protocol: str | list[str], cfg: ConformanceConfig = ConformanceConfig(), s: LogSchema = LOG) -> DataFrame:
    """One row a case of found(case, trace)."""
    if cfg.mode not in MODES:
        raise ValueError(f"unknown conformance mode {cfg.mode!r}")
    proto = parse_protocol(protocol)
    proto = collapse_list(proto) if cfg.collapse else proto
    if not proto:
        raise ValueError("the protocol has no steps")
    raw = F.col("trace")
    if cfg.ignore:
        raw = F.filter(raw, lambda x: ~x.isin(list(cfg.ignore)))
    rows = found.select(s.case, (collapsed(raw) if cfg.collapse else raw).alias("trace"))
    trace, n, size = F.col("trace"), len(proto), F.size("trace")
    every = F.array(*[F.lit(i) for i in range(n)])
    no_steps, no_places = F.array().cast("array<string>"), F.array().cast("array<int>")
    at, missing, elsewhere = _align(trace, proto)
    order = F.when(elsewhere, "order_violation").when(F.size(missing) > 0, "missing_steps")
    null = F.lit(None).cast("int")
    if cfg.mode == "exact":
        ok = trace == _literal(proto)
        lacking = []
        for k in dict.fromkeys(proto):
            short = F.greatest(F.lit(proto.count(k)) - _count(trace, k), F.lit(0))
            lacking.append(F.array_repeat(F.lit(k), short))
        lack = F.concat(*lacking)
        known = sum((F.least(_count(trace, k), F.lit(proto.count(k))) for k in dict.fromkeys(proto)), F.lit(0))
        extra = size - known
        kind = F.when(ok, "none").when(F.size(lack) > 0, "missing_steps").when(extra > 0, "extra_events").otherwise("mismatch")
        parts = (ok, kind, F.when(ok, no_steps).otherwise(lack), F.when(ok, 0).otherwise(extra), F.when(ok, every).otherwise(no_places),
                 F.when(~ok, _first_mismatch(trace, _literal(proto))))
    elif cfg.mode == "subsequence":
        ok, extra = F.size(missing) == 0, size - F.size(at)
        kind = F.when(ok & (extra == 0), "none").when(ok, "extra_events").otherwise(order)
        parts = (ok, kind, missing, extra, at, null)
    else:
        prefix = cfg.mode == "prefix"
        start = _block_start(trace, proto, prefix or cfg.contiguous_requires_start)
        ok, extra = start.isNotNull(), F.greatest(size - n, F.lit(0))
        good = F.lit("none") if prefix else F.when(extra == 0, "none").otherwise("extra_events")
        kind = F.when(ok, good).otherwise(F.coalesce(order, F.lit("mismatch")))
        places = F.when(ok, F.transform(every, lambda i: i + start)).otherwise(at)
        first = _first_mismatch(trace, F.slice(_literal(proto), 1, F.least(size, F.lit(n)))) if prefix else null
        parts = (ok, kind, F.when(ok, no_steps).otherwise(missing), extra, places, F.when(~ok, first) if prefix else null)
    names = ("conforms", "deviation_type", "missing_steps", "extra_events_count", "matched_positions", "first_deviation_index")
    out = rows.select(s.case, trace, *[c.alias(x) for c, x in zip(parts, names, strict=True)])
    return out.select(
        s.case,
        "conforms",
        F.lit(cfg.mode).alias("mode"),
        F.size("trace").alias("trace_length"),
        F.lit(n).alias("protocol_length"),
        "deviation_type",
        "missing_steps",
        F.size("missing_steps").alias("missing_count"),
        "extra_events_count",
        "matched_positions",
        F.size("matched_positions").alias("matched_count"),
        "first_deviation_index",
        F.slice("trace", 1, PREVIEW).alias("trace_preview"),
    )


def summary(per_case: DataFrame) -> DataFrame:
    """Cases of each kind: by mode, conforming ones first, most first."""
    counts = per_case.groupBy("mode", "conforms", "deviation_type").agg(F.count(F.lit(1)).alias("n_cases"))
    return counts.orderBy("mode", F.desc("conforms"), F.desc("n_cases"), "deviation_type")


def kpis(per_case: DataFrame) -> DataFrame:
    """Cases, conforming ones, their share, and the deviation that is most common."""
    kinds = per_case.where("not conforms").groupBy("deviation_type").count()
    top = kinds.orderBy(F.desc("count"), "deviation_type").limit(1).select(F.col("deviation_type").alias("top_deviation"))
    one = per_case.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("conforms").alias("n_conforming"))
    return one.join(F.broadcast(top), how="left").withColumn("rate", F.col("n_conforming") / F.col("n_cases"))


def drilldown(per_case: DataFrame, conforms: bool | None = None, deviation: str | None = None, rows: int | None = None, s: LogSchema = LOG) -> DataFrame:
    """Cases of one kind; conforming first, then by missing and extra events."""
    out = per_case if conforms is None else per_case.where(F.col("conforms") == conforms)
    out = out if deviation is None else out.where(F.col("deviation_type") == deviation)
    ordered = out.orderBy(F.desc("conforms"), F.desc("missing_count"), F.desc("extra_events_count"), s.case)
    return ordered if rows is None else ordered.limit(rows)


def case_detail(per_case: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """Names of matched events and of the others, within the preview."""
    inside = F.filter("matched_positions", lambda i: i < F.size("trace_preview"))
    names = F.transform(inside, lambda i: F.get("trace_preview", i))
    others = F.filter("trace_preview", lambda x, i: ~F.array_contains("matched_positions", i))
    return per_case.select(s.case, names.alias("matched_events"), others.alias("extra_events"))
