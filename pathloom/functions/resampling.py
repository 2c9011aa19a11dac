"""Bootstraps with Poisson weights: every value is in every draw as often as a
hash of its key says, so draws need no numbered values and no join.

Weights are the same in any engine with md5: a key's 32 hex digits give four
draws eight digits each, and a weight is how many of the fixed thresholds the
digits reach.

Means need the sums of a draw.  Medians and other quantiles of a draw lie
close to the quantile of all values; values outside a bracket around it, ten
standard errors wide each way, count as one gap a draw.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.ranks import evenly, over, quantiles

#: Quantiles among the statistics; the mean is the other one.
QUANTILES = {"median": 0.5, "p90": 0.9}
STATISTICS = ("mean", *QUANTILES)
#: Points of the sketch that brackets are chosen from, and standard errors they reach.
GRID, REACH = 2000, 10.0


def thresholds() -> list[str]:
    """Eight hex digits for each k: a uniform number from there on is a Poisson
    number over k."""
    out, below = [], 0.0
    for k in range(13):
        below += exp(-1.0) / factorial(k)
        if round(below * 2**32) >= 2**32:
            break
        out.append(f"{round(below * 2**32):08x}")
    return out


def digits(seed: int, key: str, group: str) -> str:
    """32 hex digits for a key in a group of four draws, in SQL."""
    return f"md5(concat_ws('|', '{seed}', CAST({group} AS STRING), CAST({key} AS STRING)))"


def poisson(part: str) -> str:
    """The Poisson(1) number of eight hex digits, in SQL."""
    steps = thresholds()
    return "CASE " + " ".join(f"WHEN {part} < '{t}' THEN {k}" for k, t in enumerate(steps)) + f" ELSE {len(steps)} END"


def weight(seed: int, key: str, draw: int) -> str:
    """The Poisson(1) weight of a key in one draw, in SQL."""
    return poisson(f"substring({digits(seed, key, str(draw // 4))}, {8 * (draw % 4) + 1}, 8)")


def all_weights(seed: int, key: str, n_boot: int) -> str:
    """An array of a key's weights in all draws, in SQL: a hash for four of them."""
    hashes = f"transform(sequence(0, {(n_boot - 1) // 4}), g -> {digits(seed, key, 'g')})"
    parts = f"flatten(transform({hashes}, h -> transform(sequence(0, 3), i -> substring(h, 8 * i + 1, 8))))"
    return f"slice(transform({parts}, p -> {poisson('p')}), 1, {n_boot})"


def draws(rows: DataFrame, key: str, n_boot: int, seed: int) -> DataFrame:
    """``rows`` for each draw b that they are in, with their weight w; the key
    should be a row's own."""
    columns = rows.columns
    hashed = rows.selectExpr(*columns, f"explode(sequence(0, {(n_boot - 1) // 4})) AS g_").selectExpr(*columns, "g_", f"{digits(seed, key, 'g_')} AS h_")
    each = hashed.selectExpr(*columns, "g_", "h_", "explode(sequence(0, 3)) AS i_")
    part = each.selectExpr(*columns, "g_ * 4 + i_ AS b", "substring(h_, 8 * i_ + 1, 8) AS h_").where(f"b < {n_boot}")
    return part.selectExpr(*columns, "b", f"{poisson('h_')} AS w").where("w > 0")


def bootstrap_cis(values: DataFrame, column: str, key: Sequence[str], statistics: Sequence[str] = STATISTICS, n_boot: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row: for each statistic its value, _ci_low and _ci_high by the
    percentile bootstrap; all draws of all statistics come from one pass.

    ``key`` names columns that tell rows apart; nulls don't count.  Without
    values all is null."""
    if unknown := set(statistics) - set(STATISTICS):
        raise ValueError(f"statistics are among {STATISTICS}, not {sorted(unknown)}")
    qs = [s for s in statistics if s in QUANTILES]
    named = ", ".join(f"CAST(`{k}` AS STRING)" for k in key)
    known = values.where(f"`{column}` IS NOT NULL").selectExpr(f"CAST(`{column}` AS DOUBLE) AS x", f"concat_ws('|', {named}) AS k")
    estimates = quantiles(known, "x", {s: QUANTILES[s] for s in qs}, also={"mean": "avg(x)"}) if qs else known.selectExpr("avg(x) AS mean")
    marked = known.selectExpr("x", "k", "CAST(NULL AS DOUBLE) AS v", "true AS gap")
    if qs:
        around = known.selectExpr("nullif(count(x), 0) AS n", f"percentile_approx(x, {evenly(GRID)}, {5 * GRID}) AS grid")
        cuts = []
        for s in qs:
            q = QUANTILES[s]
            wide = f"({REACH} * sqrt({q * (1 - q)!r}D / n) + 2 / n + {2.0 / GRID!r}D)"
            cuts += [f"grid[CAST(least(greatest({at}, 0), {GRID}) AS INT)]" for at in (f"floor(({q}D - {wide}) * {GRID})", f"ceil(({q}D + {wide}) * {GRID})")]
        bounds = [f"cut_{i}" for i in range(len(cuts))]
        inside = " OR ".join(f"x BETWEEN cut_{2 * i} AND cut_{2 * i + 1}" for i in range(len(qs)))
        gap = "greatest(" + ", ".join(f"CASE WHEN {c} < x THEN {c} END" for c in bounds) + ")"
        both = known.crossJoin(F.broadcast(around.selectExpr(*[f"{c} AS {b}" for c, b in zip(cuts, bounds, strict=True)])))
        marked = both.selectExpr("x", "k", f"if({inside}, x, {gap}) AS v", f"NOT ({inside}) AS gap")
    counts = draws(marked, "k", n_boot, seed).groupBy("b", "v", "gap").agg(F.expr("sum(w) AS w"), F.expr("sum(w * x) AS wx"))
    ranked = counts.selectExpr("*", f"sum(w) {over(['b'], 'v NULLS FIRST, gap')} AS upto", "sum(w) OVER (PARTITION BY b) AS n")
    picks, out = ["sum(wx) / sum(w) AS mean"], {"mean": "mean"}
    for s in qs:
        place = f"(n - 1) * {QUANTILES[s]}D"
        for name, whole in (("lo", "floor"), ("hi", "ceil")):
            picks.append(f"max(CASE WHEN upto - w <= {whole}({place}) AND {whole}({place}) < upto AND NOT gap THEN v END) AS {name}_{s}")
        out[s] = f"""CASE WHEN lo_{s} IS NULL OR hi_{s} IS NULL THEN CAST(raise_error('the rank of a draw isn\\'t within its bracket') AS DOUBLE)
            WHEN lo_{s} = hi_{s} THEN lo_{s} ELSE (ceil({place}) - {place}) * lo_{s} + ({place} - floor({place})) * hi_{s} END"""
    each = ranked.groupBy("b", "n").agg(*map(F.expr, picks))
    ends = f"array({alpha / 2!r}D, {1 - alpha / 2!r}D)"
    bounds = each.selectExpr(*[f"{out[s]} AS {s}" for s in statistics]).selectExpr(*[f"percentile({s}, {ends}) AS q_{s}" for s in statistics])  # of n_boot rows
    shown = [c for s in statistics for c in (s, f"q_{s}[0] AS {s}_ci_low", f"q_{s}[1] AS {s}_ci_high")]
    return estimates.crossJoin(F.broadcast(bounds)).selectExpr(*shown)
