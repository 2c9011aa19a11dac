"""Time-to-event simulation: transition times, a Weibull posterior, capacity
scenarios.

Without covariates the likelihood of a Weibull model depends on the data only
through the number of events d, the sum L of their log times and S(k) = sum of
all times ** k; one pass gives S on a grid of shapes, and the posterior is a
table over a grid of (mu, kappa), exact up to the grid and repeatable."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.portable import uniform
from pathloom.functions.ranks import numbers, quantile, quantiles
from pathloom.operators.features import first_known
from pathloom.schema import LOG, LogSchema, minutes
from pathloom.sources.tables import written

#: The transitions between stages that are offered, and their service levels in minutes.
TRANSITIONS = {
    "triage_to_registration": ("triage", "registration"),
    "registration_to_assessment": ("registration", "assessment"),
    "assessment_to_consult_request": ("assessment", "consult request"),
    "assessment_to_discharge": ("assessment", "discharge"),
}
SERVICE_LEVELS = {
    "triage_to_registration": (2, 5, 10),
    "registration_to_assessment": (10, 30, 60),
    "assessment_to_consult_request": (30, 60, 120),
    "assessment_to_discharge": (60, 120, 240),
}
LEAST_MINUTES = 1e-6
#: Proposals whose densities one pass works out.
PROPOSALS = 2000
LEAST_CASES = 10


@dataclass(frozen=True)
class Grid:
    """Shapes 0.2 to 5 and locations within 3 of the log of the median."""

    kappa_low: float = 0.2
    kappa_step: float = 0.04
    kappas: int = 121
    mu_reach: float = 3.0
    mus: int = 121


@dataclass(frozen=True)
class Priors:
    """mu normal around the log of the median (or around ``mu_mean``), each beta
    normal around 0; 1 / kappa exponential or, with ``kappa_gamma`` (shape,
    rate), kappa gamma."""

    mu_sd: float = 2.0
    beta_sd: float = 1.0
    sigma_rate: float = 1.0
    kappa_gamma: tuple[float, float] | None = None
    mu_mean: float | None = None


def transition(key: str) -> tuple[str, str]:
    if key not in TRANSITIONS:
        raise KeyError(f"unknown transition {key!r}; there are {sorted(TRANSITIONS)}")
    return TRANSITIONS[key]


def available(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """Which transitions' ends the log has; activities must be normalised."""
    spark = log.sparkSession
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in TRANSITIONS.items()], "transition_key string, start_activity string, end_activity string")
    have = log.select(F.col(s.activity).alias("a")).distinct()
    for end in ("start", "end"):
        seen = have.select(F.col("a").alias(f"{end}_activity"), F.lit(True).alias(f"{end}_present"))
        rows = rows.join(seen, f"{end}_activity", "left").withColumn(f"{end}_present", F.coalesce(f"{end}_present", F.lit(False)))
    return rows.select("transition_key", "start_activity", "end_activity", "start_present", "end_present")


def transition_dataset(log: DataFrame, start: str, end: str, covariates: tuple[str, ...] = (), s: LogSchema = LOG) -> DataFrame:
    """case, duration_min, observed (1: the end came; 0: the case ended first).
    The end counts if it stands after the first start; cases without a start
    aren't in the result."""
    here = F.struct(F.col(s.time).alias("t"), F.col(s.seq).alias("q"))
    first = F.min(F.when(F.col(s.activity) == start, here)).over(s.whole)
    rows = log.where(F.col(s.time).isNotNull() & F.col(s.case).isNotNull()).withColumn("start_", first).where("start_ is not null")
    after = (F.col(s.activity) == end) & (here > F.col("start_"))
    known = [first_known(c, s).cast("double").alias(c) for c in covariates]
    out = rows.groupBy(s.case).agg(
        F.first("start_.t").alias("t0"), F.min(F.when(after, F.col(s.time))).alias("t1"), F.max(s.time).alias("t2"), *known
    )
    took = F.greatest(minutes(F.col("t0"), F.coalesce("t1", "t2")), F.lit(LEAST_MINUTES))
    return out.select(s.case, took.alias("duration_min"), F.col("t1").isNotNull().cast("int").alias("observed"), *covariates)


def _sums(grid: Grid) -> str:
    """d, sum_log and the sums of powers, as one struct of aggregates, in SQL."""
    logs = "coalesce(sum(CASE WHEN observed = 1 THEN ln(duration_min) END), 0.0D)"
    powers = ", ".join(f"sum(power(duration_min, {k!r}D))" for k in _kappas(grid))
    return f"named_struct('d', sum(CAST(observed AS BIGINT)), 'sum_log', {logs}, 'powers', array({powers}))"


def _by_shape(grid: Grid) -> Column:
    """kappa, s_kappa: a row a shape, of the sums."""
    return F.expr(f"inline(arrays_zip({numbers(_kappas(grid))}, sums.powers))")


def sufficient_statistics(data: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """kappa, d, sum_log, s_kappa for each shape; one aggregation."""
    one = data.agg(F.expr(_sums(grid)).alias("sums"))
    return one.select("sums.d", "sums.sum_log", _by_shape(grid).alias("kappa", "s_kappa")).select("kappa", "d", "sum_log", "s_kappa")


def _kappas(grid: Grid) -> list[float]:
    return [round(grid.kappa_low + grid.kappa_step * i, 10) for i in range(grid.kappas)]


def posterior(data: DataFrame, grid: Grid = Grid(), priors: Priors = Priors()) -> DataFrame:
    """mu, kappa, weight over the grid, which lies around the log of the median."""
    step = 2 * grid.mu_reach / (grid.mus - 1)
    offsets = F.transform(F.sequence(F.lit(0), F.lit(grid.mus - 1)), lambda i: i * F.lit(step) - F.lit(grid.mu_reach))
    one = quantiles(data, "duration_min", {"median": 0.5}, also={"sums": _sums(grid)})
    shapes = one.select("sums.d", "sums.sum_log", F.ln("median").alias("m0"), _by_shape(grid).alias("kappa", "s_kappa"))
    points = shapes.select("*", F.explode(offsets).alias("offset"))
    k, mu = F.col("kappa"), F.col("m0") + F.col("offset")
    likelihood = F.col("d") * F.ln(k) + (k - 1) * F.col("sum_log") - F.col("d") * k * mu - F.exp(-k * mu) * F.col("s_kappa")
    away = F.col("offset") if priors.mu_mean is None else mu - F.lit(priors.mu_mean)
    shape = F.lit(-priors.sigma_rate) / k - 2 * F.ln(k)
    if priors.kappa_gamma is not None:
        shape = (priors.kappa_gamma[0] - 1) * F.ln(k) - F.lit(priors.kappa_gamma[1]) * k
    prior = -(away * away) / (2 * priors.mu_sd**2) + shape
    rows = points.select(mu.alias("mu"), "kappa", (likelihood + prior).alias("lp"))
    whole = W.partitionBy(F.lit(0))  # the grid: kappas * mus rows
    raw = rows.select("mu", "kappa", F.exp(F.col("lp") - F.max("lp").over(whole)).alias("w"))
    return raw.select("mu", "kappa", (F.col("w") / F.sum("w").over(whole)).alias("weight"))


def posterior_means(weights: DataFrame) -> DataFrame:
    w = F.col("weight")
    return weights.agg(F.sum(w * F.col("mu")).alias("mu_mean"), F.sum(w * F.col("kappa")).alias("kappa_mean"))


def predictive_times(weights: DataFrame, n: int = 5000, seed: int = 123) -> DataFrame:
    """draw, mu, kappa, minutes: n draws from the posterior predictive.  A grid
    of bounded size and n draws are put in order of cumulative weight."""
    spark = weights.sparkSession
    up = W.orderBy("kappa", "mu").rowsBetween(W.unboundedPreceding, W.currentRow)
    cumulative = weights.where("weight > 0").select("mu", "kappa", F.sum("weight").over(up).alias("at"), F.lit(None).cast("long").alias("draw"))
    draws = spark.range(n).select(
        F.lit(None).cast("double").alias("mu"), F.lit(None).cast("double").alias("kappa"),
        uniform(F.lit(seed), F.col("id"), F.lit("p")).alias("at"), F.col("id").alias("draw"),
    )
    ahead = W.orderBy("at", F.col("draw").isNull(), "kappa", "mu").rowsBetween(W.currentRow, W.unboundedFollowing)
    point = F.struct("mu", "kappa")
    last = F.max_by(point, F.struct("kappa", "mu"))
    placed = cumulative.unionByName(draws).withColumn("point", F.first(F.when(F.col("draw").isNull(), point), True).over(ahead))
    final = cumulative.agg(last.alias("final"))
    chosen = placed.where("draw is not null").crossJoin(F.broadcast(final)).select("draw", F.coalesce("point", "final").alias("p"))
    u = uniform(F.lit(seed), F.col("draw"), F.lit("t"))
    time = F.greatest(F.exp(F.col("p.mu")) * F.pow(-F.ln(1 - u), 1 / F.col("p.kappa")), F.lit(LEAST_MINUTES))
    return chosen.select("draw", "p.mu", "p.kappa", time.alias("minutes"))


def predictive_times_at(samples: DataFrame, values: dict[str, float], n: int = 5000, seed: int = 123) -> DataFrame:
    """draw, mu, kappa, minutes: n draws at given covariate values from the
    samples of posterior_with_covariates (chain, draw, mu, kappa, beta_*), which
    are drawn with replacement.  Covariates that aren't given count as 0."""
    place = F.col("mu")
    for name, value in values.items():
        place = place + F.col(f"`beta_{name}`") * F.lit(float(value))
    kept = samples.select("chain", "draw", place.alias("place"), "kappa").orderBy("chain", "draw").collect()  # chains x draws rows
    pick = F.floor(uniform(F.lit(seed), F.col("id"), F.lit("p")) * len(kept)).cast("int")
    drawn = samples.sparkSession.range(n).select(F.col("id").alias("draw"), pick.alias("pick"), uniform(F.lit(seed), F.col("id"), F.lit("t")).alias("u"))
    points = drawn.selectExpr("draw", "u", f"{numbers([r['place'] for r in kept])}[pick] AS mu", f"{numbers([r['kappa'] for r in kept])}[pick] AS kappa")
    return points.selectExpr("draw", "mu", "kappa", f"greatest(exp(mu) * power(-ln(1 - u), 1 / kappa), {LEAST_MINUTES!r}D) AS minutes")


def scenario(times: DataFrame, multiplier: float) -> DataFrame:
    """draw, t_baseline, t_capacity: m times the capacity takes 1 / m of the time."""
    if multiplier <= 0:
        raise ValueError("a capacity multiplier is positive")
    return times.select("draw", F.col("minutes").alias("t_baseline"), (F.col("minutes") / multiplier).alias("t_capacity"))


def summarize(simulated: DataFrame, quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), levels: tuple[int, ...] = (30, 60, 120)) -> DataFrame:
    """One row: mean, median, quantiles and shares within service levels, of
    both scenarios."""
    asked, out = ", ".join(f"{q!r}D" for q in (0.5, *quantiles)), ["n_mc_times"]
    sums = ["count(1) AS n_mc_times"]
    for name in ("baseline", "capacity"):
        t = f"t_{name}"
        sums += [f"avg({t}) AS {name}_mean", f"percentile({t}, array({asked})) AS {name}_q"]  # of n draws
        sums += [f"avg(CAST({t} <= {x} AS DOUBLE)) AS {name}_p_le_{x}m" for x in levels]
        out += [f"{name}_mean", f"{name}_q[0] AS {name}_median", *[f"{name}_q[{i}] AS {name}_q{round(q * 100):02d}" for i, q in enumerate(quantiles, 1)]]
        out += [f"{name}_p_le_{x}m" for x in levels]
    return simulated.selectExpr(*sums).selectExpr(*out)


def _long(simulated: DataFrame) -> DataFrame:
    both = F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(f"t_{n}").alias("minutes")) for n in ("baseline", "capacity")])
    return simulated.select(F.inline(both))


def quantile_table(simulated: DataFrame, quantiles: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """label, baseline, capacity."""
    q = F.percentile("minutes", F.array(*map(F.lit, quantiles)))
    found = _long(simulated).groupBy("scenario").agg(q.alias("q"))
    rows = F.array(*[F.struct(F.lit(f"q{round(x * 100):02d}").alias("label"), F.col("q")[i].alias("v")) for i, x in enumerate(quantiles)])
    each = found.select("scenario", F.inline(rows))
    return each.groupBy("label").agg(*[F.max(F.when(F.col("scenario") == n, F.col("v"))).alias(n) for n in ("baseline", "capacity")])


def service_table(simulated: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """threshold_min, baseline, capacity: shares within each level."""
    rows = F.array(*[F.lit(x) for x in levels])
    each = simulated.select("*", F.explode(rows).alias("threshold_min"))
    share = lambda c: F.avg((F.col(c) <= F.col("threshold_min")).cast("double"))
    return each.groupBy("threshold_min").agg(share("t_baseline").alias("baseline"), share("t_capacity").alias("capacity"))


def fingerprint(log: DataFrame, *settings: object) -> DataFrame:
    """A key for kept fits: rows in any order, each as often as it occurs, and
    every setting."""
    h = F.xxhash64(*log.columns)
    total = F.sum(F.crc32(h.cast("string").cast("binary")).cast("decimal(38,0)"))
    rows = log.agg(F.bit_xor(h).alias("x"), F.coalesce(total, F.lit(0)).cast("string").alias("s"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.substring(F.sha2(F.concat_ws("|", "x", "s", "n", F.lit(repr(settings))), 256), 1, 16).alias("fingerprint"))


def simulate(
    log: DataFrame,
    key: str,
    multiplier: float = 1.5,
    n: int = 5000,
    grid: Grid = Grid(),
    s: LogSchema = LOG,
    priors: Priors = Priors(),
    covariates: dict[str, float] | None = None,
    times: bool = False,
    levels: tuple[int, ...] | None = None,
) -> DataFrame:
    """From a log with normalised activities to the summary of one transition,
    at given covariate values if there are any, with shares within its service
    levels (or ``levels``); with ``times`` the simulated times (draw,
    t_baseline, t_capacity) instead."""
    names = tuple(covariates or ())
    data = transition_dataset(log, *transition(key), names, s)
    cases = data.count()
    if cases < LEAST_CASES:
        raise ValueError(f"{key} needs {LEAST_CASES} cases; there are {cases}")
    if names:
        drawn = predictive_times_at(posterior_with_covariates(data, list(names), priors=priors), covariates, n)
    else:
        drawn = predictive_times(posterior(data, grid, priors), n)
    if times:
        return scenario(drawn, multiplier)
    out = summarize(scenario(drawn, multiplier), levels=levels or SERVICE_LEVELS[key])
    return out.select(
        F.lit(key).alias("transition_key"), F.lit(float(multiplier)).alias("capacity_multiplier"), F.lit(cases).cast("long").alias("n_cases_used"), "*"
    )


def _passes(cells: DataFrame, covariates: list[str], thetas: np.ndarray, derivatives: bool = False) -> np.ndarray:
    """Sums over all cells, a row of numbers for each of ``thetas`` (mu, log
    kappa, beta...): the log-likelihood and, if asked for, its gradient and
    Hessian.  Each task adds up its cells in batches and sends one number for
    each sum."""
    p, k = thetas.shape[1], len(covariates)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(thetas), 1 + (p + p * p) * derivatives))
        for batch in batches:
            t, n, event = np.log(batch["duration_min"].to_numpy()), batch["n"].to_numpy(float), batch["observed"].to_numpy(float)
            x = batch[covariates].fillna(0.0).to_numpy(float) if k else np.zeros((len(t), 0))
            for row, (mu, eta, *beta) in zip(sums, thetas, strict=True):
                shape = np.exp(eta)
                z = np.clip(shape * (t - mu - x @ np.array(beta)), -700, 700)
                e = np.exp(z)
                row[0] += (n * (event * (eta + z - t) - e)).sum()
                if derivatives:
                    away = np.column_stack([np.full(len(t), -shape), z, -shape * x])  # of z
                    r = event - e
                    g = away * r[:, None]
                    g[:, 1] += event
                    h = -(away * (n * e)[:, None]).T @ away
                    bend = (away * (n * r)[:, None]).sum(axis=0)  # of z twice, where log kappa is one
                    h[1] += bend
                    h[:, 1] += bend
                    h[1, 1] -= bend[1]
                    row[1:] += np.concatenate([n @ g, h.ravel()])
        yield pd.DataFrame({"m": np.repeat(np.arange(len(sums)), sums.shape[1]), "i": np.tile(np.arange(sums.shape[1]), len(sums)), "v": sums.ravel()})

    found = cells.mapInPandas(add, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((len(thetas), 1 + (p + p * p) * derivatives))
    out[found["m"], found["i"]] = found["v"]
    return out


def _log_prior(theta: np.ndarray, centre: float, priors: Priors) -> np.ndarray:
    """Of (mu, log kappa, beta...), with the Jacobian of log kappa; a row a theta."""
    mu, eta, beta = theta[:, 0], theta[:, 1], theta[:, 2:]
    if priors.kappa_gamma is None:
        shape = -priors.sigma_rate * np.exp(-eta) - eta
    else:
        shape = priors.kappa_gamma[0] * eta - priors.kappa_gamma[1] * np.exp(eta)
    middle = centre if priors.mu_mean is None else priors.mu_mean
    return -((mu - middle) ** 2) / (2 * priors.mu_sd**2) + shape - (beta**2).sum(axis=1) / (2 * priors.beta_sd**2)


def _prior_slopes(theta: np.ndarray, centre: float, priors: Priors) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and (diagonal) Hessian of the log prior."""
    eta = theta[1]
    middle = centre if priors.mu_mean is None else priors.mu_mean
    g, h = -theta / priors.beta_sd**2, np.full(len(theta), -1 / priors.beta_sd**2)
    g[0], h[0] = -(theta[0] - middle) / priors.mu_sd**2, -1 / priors.mu_sd**2
    if priors.kappa_gamma is None:
        g[1], h[1] = priors.sigma_rate * np.exp(-eta) - 1, -priors.sigma_rate * np.exp(-eta)
    else:
        g[1], h[1] = priors.kappa_gamma[0] - priors.kappa_gamma[1] * np.exp(eta), -priors.kappa_gamma[1] * np.exp(eta)
    return g, h


def posterior_with_covariates(
    data: DataFrame, covariates: list[str], draws: int = 400, tune: int = 400, chains: int = 2, seed: int = 42, priors: Priors = Priors()
) -> DataFrame:
    """chain, draw, mu, kappa, beta_*: independence Metropolis around the mode.

    Newton steps find the mode, each a pass over the data that sums gradient and
    Hessian (and one that tries several step lengths at once).  All proposals of
    all chains are then drawn from a t distribution there, and one more pass
    gives their densities; accepting or not needs those numbers alone.  ``tune``
    proposals of each chain come before its draws.  No task holds the data."""
    counted = data.groupBy("duration_min", "observed", *covariates).agg(F.count(F.lit(1)).alias("n"))
    cells = written(counted, "weibull-cells")
    middle = quantile(data, "duration_min", 0.5, "m").first()["m"]
    if middle is None:
        raise ValueError("there are no durations")
    centre, theta, lengths = float(np.log(middle)), np.zeros(2 + len(covariates)), 0.5 ** np.arange(8)
    theta[0], p = centre, 2 + len(covariates)
    for _ in range(50):
        sums = _passes(cells, covariates, theta[None], True)[0]
        slope, bend = _prior_slopes(theta, centre, priors)
        g, h = sums[1 : 1 + p] + slope, sums[1 + p :].reshape(p, p) + np.diag(bend)
        values, vectors = np.linalg.eigh(-h)
        move = vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-9))  # uphill, whatever the Hessian's signs
        tried = theta + lengths[:, None] * move
        heights = _passes(cells, covariates, tried)[:, 0] + _log_prior(tried, centre, priors)
        theta = tried[int(np.argmax(heights))]
        if np.abs(move).max() < 1e-6:
            break
    rng, freedom = np.random.default_rng(seed), 5.0
    root = vectors / np.sqrt(np.maximum(np.abs(values), 1e-9))
    size = chains * (tune + draws)
    noise = rng.normal(size=(size, p)) / np.sqrt(rng.chisquare(freedom, size=(size, 1)) / freedom)
    proposed = theta + noise @ root.T
    density = np.concatenate([_passes(cells, covariates, some)[:, 0] for some in np.array_split(proposed, -(-size // PROPOSALS))])
    weight = density + _log_prior(proposed, centre, priors) + (freedom + p) / 2 * np.log1p((noise**2).sum(axis=1) / freedom)
    dice, out = np.log(rng.uniform(size=size)), []
    for chain in range(chains):
        at = chain * (tune + draws)
        for i in range(tune + draws):
            j = chain * (tune + draws) + i
            at = j if dice[j] < weight[j] - weight[at] else at
            if i >= tune:
                out.append((chain, i - tune, float(proposed[at, 0]), float(np.exp(proposed[at, 1])), *map(float, proposed[at, 2:])))
    names = ["mu", "kappa", *[f"beta_{c}" for c in covariates]]
    return data.sparkSession.createDataFrame(out, "chain int, draw int, " + ", ".join(f"`{c}` double" for c in names))
