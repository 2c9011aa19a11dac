"""Selections, running sums and bootstraps against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import ranks, resampling, stats

QS = {"least": 0.0, "low": 0.01, "quarter": 0.25, "middle": 0.5, "same": 0.5, "high": 0.99, "most": 1.0}


def percentiles(df, by):
    q = F.percentile("x", F.array(*[F.lit(v) for v in QS.values()]))
    return {r["g"]: (r["k"], *(r["q"] or [None] * len(QS))) for r in df.groupBy(by).agg(F.count("*").alias("k"), q.alias("q")).collect()}


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_quantiles_are_exact_in_groups_of_all_kinds(spark, monkeypatch, rounds):
    monkeypatch.setattr(ranks, "ACCURACY", 200)
    monkeypatch.setattr(ranks, "LEAST", 800)
    rng = random.Random(5)
    rows = [("hot", rng.expovariate(1)) for _ in range(6000)] + [("ties", float(rng.randrange(4))) for _ in range(3000)]
    rows += [("half", 0.0 if i % 2 else rng.gauss(0, 1e6)) for i in range(2000)] + [(None, float(i)) for i in range(1500)] + [(None, None)] * 7
    rows += [("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None), ("equal", 1.0)] + [("equal", 1.0)] * 900
    df = spark.createDataFrame(rows, "g string, x double")
    got = ranks.quantiles(df, "x", QS, ["g"], {"k": "count(1)"}, rounds)
    assert got.columns == ["g", "k", *QS]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == percentiles(df, "g")


def test_quantiles_of_all_rows_and_of_none(spark):
    df = spark.range(1001).select((F.col("id") / 10).alias("x"))
    assert ranks.quantiles(df, "x", {"a": 0.25, "b": 0.999}).first()[:] == (25.0, 99.9)
    assert ranks.quantile(df.where("x < 0"), "x", 0.5, "m").collect() == [(None,)]
    assert ranks.quantiles(df.withColumn("g", F.lit(1)).where("x < 0"), "x", {"m": 0.5}, ["g"]).collect() == []


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_sums_over_range_edges(spark, descending, inclusive):
    rng = random.Random(1)
    cells = {(g, round(rng.gauss(0, 3), 1)): rng.randrange(1, 9) for _ in range(700) for g in ("a", None, "c")}
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "g string, x double, n long")
    got = ranks.running(df, "x", {"total": "n", "n2": "n"}, ["g"], descending, inclusive, ranges=16)
    assert got.columns == ["g", "x", "n", "total", "n2"]
    want = {}
    for g in ("a", None, "c"):
        total = 0
        for x in sorted((x for h, x in cells if h == g), reverse=descending):
            want[g, x] = total + cells[g, x] * inclusive
            total += cells[g, x]
    assert {(r.g, r.x): r.total for r in got.collect()} == want
    one = ranks.running(df.groupBy("x").agg(F.sum("n").alias("n")), "x", {"total": "n"}, ranges=1)
    assert one.agg(F.max("total")).first()[0] == sum(cells.values())


def test_auc_with_ties(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "y_true int, y_score double")
    pos, neg = ([s for y, s in rows if y == k] for k in (1, 0))
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert stats.roc_auc(df).first()[0] == pytest.approx(wins)


def plain_weight(key, b, seed=42):
    h = hashlib.md5(f"{seed}|{b // 4}|{key}".encode()).hexdigest()[8 * (b % 4) : 8 * (b % 4) + 8]
    return sum(h >= t for t in resampling.thresholds())


def test_bootstrap_equals_weighted_draws_one_after_the_other(spark):
    rng, n_boot = random.Random(3), 30
    values = {i: round(rng.gauss(10, 3), 1) for i in range(4000)}
    df = spark.createDataFrame([*values.items(), (-1, None)], "k long, y double")
    got = resampling.bootstrap_cis(df, "y", ["k"], n_boot=n_boot).first()
    draws = defaultdict(list)
    for b in range(n_boot):
        some = np.repeat(list(values.values()), [plain_weight(k, b) for k in values])
        for name, f in (("mean", np.mean), ("median", np.median), ("p90", lambda v: np.quantile(v, 0.9))):
            draws[name].append(f(some))
    for name, f in (("mean", np.mean), ("median", np.median), ("p90", lambda v: np.quantile(v, 0.9))):
        want = [f(list(values.values())), *np.quantile(draws[name], [0.025, 0.975])]
        assert [got[name], got[f"{name}_ci_low"], got[f"{name}_ci_high"]] == pytest.approx(want)


def test_weights_are_poisson():
    seen = Counter(plain_weight(k, b) for k in range(500) for b in range(20))
    assert seen[0] / 10_000 == pytest.approx(0.368, abs=0.02) and sum(k * n for k, n in seen.items()) / 10_000 == pytest.approx(1, abs=0.05)


def test_bootstrap_without_values_and_of_one(spark):
    df = spark.createDataFrame([(1, 5.0)], "k long, y double")
    assert resampling.bootstrap_cis(df.where("k > 1"), "y", ["k"]).first()[0] is None
    assert resampling.bootstrap_cis(df, "y", ["k"], n_boot=40).first()["median_ci_high"] == 5.0
    with pytest.raises(ValueError):
        resampling.bootstrap_cis(df, "y", ["k"], ["mode"])
