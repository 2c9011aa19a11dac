"""Canonicalisation: repair and order a raw log, one exchange by case."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.schema import LOG, LogSchema, require_columns


@dataclass(frozen=True)
class StepRule:
    drop_if_midnight: bool = False
    drop_if_missing_covariate: bool = False
    treat_as_terminal: bool = False
    priority_rank: int | None = None


@dataclass(frozen=True)
class CanonicalConfig:
    covariate: str | None = None
    terminal_steps: tuple[str, ...] = ()
    step_rules: dict[str, StepRule] = field(default_factory=dict)
    enforce_monotonic_time: bool = True
    max_time_repairs_per_case: int = 10
    #: push_seconds or roll_day_if_midnight_and_backwards
    terminal_fix_mode: str = "push_seconds"
    drop_low_quality_cases: bool = True
    unstable_columns: tuple[str, ...] = ()
    #: none, drop_rows, drop_cases or drop_rows_for_steps_only
    unstable_missing_mode: str = "none"
    unstable_case_missing_threshold: float = 0.30
    unstable_steps_scope: tuple[str, ...] = ()
    #: Sort pushed terminal events to the end, rather than lift what follows them.
    resort_after_terminal: bool = False

    @property
    def terminals(self) -> list[str]:
        return sorted({*self.terminal_steps, *(k for k, r in self.step_rules.items() if r.treat_as_terminal)})


def rules_from_lists(
    midnight: tuple[str, ...] = (), terminal: tuple[str, ...] = (), covariate: tuple[str, ...] = ()
) -> dict[str, StepRule]:
    """Rules as a form gives them: midnight steps rank 60, terminal ones 100
    where they have no rank; a covariate rule replaces a midnight rule."""
    rules = {x: StepRule(drop_if_midnight=True, priority_rank=60) for x in midnight}
    rules |= {x: StepRule(drop_if_missing_covariate=True) for x in covariate}
    for x in terminal:
        old = rules.get(x, StepRule())
        rules[x] = StepRule(
            old.drop_if_midnight, old.drop_if_missing_covariate, True, 100 if old.priority_rank is None else old.priority_rank
        )
    return rules


def is_midnight(t: Column) -> Column:
    """Hour, minute and whole second are 0."""
    return (F.hour(t) == 0) & (F.minute(t) == 0) & (F.floor(F.second(t)) == 0)


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)


def tag(log: DataFrame, cfg: CanonicalConfig, s: LogSchema = LOG) -> DataFrame:
    """Every row of ``log`` with ``drop_reason`` (null: it stays), the repaired
    time ``new_time``, ``new_seq`` and flags; nothing is filtered, so that the
    report can count from it."""
    require_columns(log, s.core)
    act, t = F.col(s.activity), F.col(s.time)
    steps = lambda test: [k for k, r in cfg.step_rules.items() if test(r)]
    # Rows without essentials take no part in a case; those without a case would be one hot group.
    lacking = F.col(s.case).isNull() | act.isNull() | t.isNull()
    reason = F.when(F.lit(False), "")
    if midnight := steps(lambda r: r.drop_if_midnight):
        reason = reason.when(act.isin(midnight) & is_midnight(t), "midnight")
    covariate = steps(lambda r: r.drop_if_missing_covariate)
    if covariate and cfg.covariate in log.columns:
        reason = reason.when(act.isin(covariate) & F.col(cfg.covariate).isNull(), "covariate")
    rows = log.where(~lacking).withColumn("drop_reason", reason).repartition(s.case)
    used = [c for c in cfg.unstable_columns if c in log.columns]
    if cfg.unstable_missing_mode not in ("none", "drop_rows", "drop_cases", "drop_rows_for_steps_only"):
        raise ValueError(f"unknown unstable_missing_mode {cfg.unstable_missing_mode!r}")
    alive = F.col("drop_reason").isNull()
    if used and cfg.unstable_missing_mode != "none":
        missing = F.lit(False)
        for c in used:
            missing = missing | F.col(c).isNull()
        if cfg.unstable_missing_mode == "drop_cases":
            share = F.avg(F.when(alive, missing.cast("double"))).over(s.whole)
            bad, word = share > cfg.unstable_case_missing_threshold, "unstable_case"
        else:
            scope = act.isin(list(cfg.unstable_steps_scope))
            only = cfg.unstable_missing_mode == "drop_rows_for_steps_only" and cfg.unstable_steps_scope
            bad, word = (missing & scope) if only else missing, "unstable_row"
        rows = rows.withColumn("drop_reason", F.when(alive & bad, word).otherwise(F.col("drop_reason")))
    dead = F.col("drop_reason").isNotNull()
    again = F.row_number().over(W.partitionBy(s.case, s.time, s.activity, dead).orderBy(F.desc(s.seq))) > 1
    rows = rows.withColumn("drop_reason", F.when(again & ~dead, "duplicate").otherwise(F.col("drop_reason")))

    rank = F.when(act.isin(cfg.terminals), 100).otherwise(50) if cfg.terminals else F.lit(50)
    for step, rule in cfg.step_rules.items():
        if rule.priority_rank is not None:
            rank = F.when(act == step, rule.priority_rank).otherwise(rank)
    rows = rows.withColumn("step_rank", rank.cast("int"))
    case = W.partitionBy(s.case, dead)
    ordered = case.orderBy(s.time, "step_rank", s.seq)
    so_far = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("new_seq", F.row_number().over(ordered).cast("long"))
    terminal = act.isin(cfg.terminals) if cfg.terminals else F.lit(False)
    rows = rows.withColumn("last_step", F.max(F.when(~terminal, t)).over(case))
    rows = rows.withColumn("pushed", F.coalesce(~dead & terminal & (t <= F.col("last_step")), F.lit(False)))
    step_no = F.sum(F.col("pushed").cast("int")).over(so_far)
    fixed = F.col("last_step") + _seconds(step_no)
    if cfg.terminal_fix_mode == "roll_day_if_midnight_and_backwards":
        fixed = F.when(is_midnight(t), t + F.expr("INTERVAL 1 DAY")).otherwise(fixed)
    elif cfg.terminal_fix_mode != "push_seconds":
        raise ValueError(f"unknown terminal_fix_mode {cfg.terminal_fix_mode!r}")
    rows = rows.withColumn("new_time", F.when(F.col("pushed"), fixed).otherwise(t))
    if cfg.resort_after_terminal:
        moved = case.orderBy("new_time", "step_rank", "new_seq")
        rows = rows.withColumn("new_seq", F.row_number().over(moved).cast("long"))
        so_far = case.orderBy("new_seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    if cfg.enforce_monotonic_time:
        lifted = F.max("new_time").over(so_far)
        rows = rows.withColumn("lifted", lifted).withColumn("repaired", (F.col("lifted") != F.col("new_time")) & ~dead)
        rows = rows.withColumn("repairs", F.sum(F.col("repaired").cast("int")).over(case))
        rows = rows.withColumn("flagged", (F.col("repairs") > cfg.max_time_repairs_per_case) & ~dead)
        rows = rows.withColumn("new_time", F.col("lifted")).drop("lifted")
    else:
        rows = rows.withColumns({"repaired": F.lit(False), "repairs": F.lit(0), "flagged": F.lit(False)})
    if cfg.drop_low_quality_cases:
        rows = rows.withColumn("drop_reason", F.when(F.col("flagged"), "low_quality").otherwise(F.col("drop_reason")))
    gone = log.where(lacking).withColumn("drop_reason", F.lit("essentials"))
    gone = gone.withColumns({c: F.lit(False) for c in ("pushed", "repaired", "flagged")})
    return rows.unionByName(gone, allowMissingColumns=True)


def canonicalize(log: DataFrame, cfg: CanonicalConfig, s: LogSchema = LOG) -> DataFrame:
    """The repaired log; ``_seq`` is the position in the case."""
    kept = tag(log, cfg, s).where("drop_reason is null")
    return kept.select(*[F.col("new_time").alias(c) if c == s.time else F.col("new_seq").alias(c) if c == s.seq else c for c in log.columns])


def report(log: DataFrame, cfg: CanonicalConfig, s: LogSchema = LOG) -> DataFrame:
    """One row of counts, in one pass over the tagged rows, and the settings for
    unstable columns."""
    rows = tag(log, cfg, s)
    why = F.col("drop_reason")
    n = lambda test: F.count_if(test)
    stays = why.isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows_in"),
        n(stays).alias("n_rows_out"),
        F.count_distinct(s.case).alias("n_cases_in"),
        F.count_distinct(F.when(stays, F.col(s.case))).alias("n_cases_out"),
        n(~stays).alias("dropped_rows"),
        n(why == "midnight").alias("dropped_midnight"),
        n(why == "covariate").alias("dropped_missing_covariate"),
        n(why == "unstable_row").alias("dropped_unstable_rows"),
        F.count_distinct(F.when(why == "unstable_case", F.col(s.case))).alias("dropped_unstable_cases"),
        n(why == "duplicate").alias("dropped_duplicates"),
        F.count_distinct(F.when(F.col("pushed"), F.col(s.case))).alias("terminal_reordered_cases"),
        n(F.col("repaired") & ~F.col("flagged")).alias("monotonic_repairs_applied"),
        F.count_distinct(F.when(F.col("flagged"), F.col(s.case))).alias("backward_cases_flagged"),
    ).withColumns({
        "dropped_cases": F.col("n_cases_in") - F.col("n_cases_out"),
        "unstable_columns_used": F.lit(",".join(c for c in cfg.unstable_columns if c in log.columns)),
        "unstable_missing_mode": F.lit(cfg.unstable_missing_mode),
        "unstable_case_missing_threshold": F.lit(float(cfg.unstable_case_missing_threshold)),
    })


def dropped_by_step(log: DataFrame, cfg: CanonicalConfig, s: LogSchema = LOG) -> DataFrame:
    """How many rows of a step the midnight and covariate rules dropped."""
    return tag(log, cfg, s).where("drop_reason in ('midnight', 'covariate')").groupBy(s.activity, "drop_reason").count()
