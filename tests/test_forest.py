import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import forest, models


def noise(spark, n):
    return spark.range(n).select(F.rand(1).alias("u"), F.rand(2).alias("v"), (F.rand(3) < 0.5).cast("int").alias("y"))


def test_jobs_of_a_forest_dont_grow_with_its_nodes(spark):
    context, jobs = spark.sparkContext, []
    for n in (300, 6000):
        context.setJobGroup(f"forest-{n}", "")
        trained = models.train(noise(spark, n), ["u", "v"], model_type="rf", trees=4)
        right = models.predict(trained, noise(spark, n)).where("y_pred = y").count() / n
        assert right > 0.75  # grown to pure nodes: only rows that no tree has may be wrong
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"forest-{n}")))
    context.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 4


@pytest.mark.parametrize("binary", [True, False])
def test_nodes_split_by_all_partitions_and_by_one_call_are_the_same(spark, binary):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 200, (512, 3)), rng.integers(0, 2 if binary else 50, 512)
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double").repartition(3).localCheckpoint()
    got = []
    for local in (10**6, 60):
        rule = forest.Rule(binary, (1.5, 0.5) if binary else (1.0, 1.0))
        made = forest.fit(df, ("a", "b", "c"), 2, rule, 3, 7, local=local)
        got.append(sorted(forest.predicted(made, df, "id").collect()))
    assert len(made.upper.feature) > 2 and len(got[0]) == 512 and got[0] == got[1]


@pytest.mark.parametrize("binary", [True, False])
def test_a_tree_is_that_of_a_plain_search(binary):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 30, (150, 2)).astype(np.uint8), rng.integers(0, 2 if binary else 9, 150).astype(float)
    weight = rng.integers(1, 4, 150).astype(float)

    def spread(y, w):
        return np.sum(w) * np.average((y - np.average(y, weights=w)) ** 2, weights=w) * (2 if binary else 1) if len(y) else 0.0

    def plain(rows, asked):
        options = [(spread(y[a], weight[a]) + spread(y[b], weight[b]), f, c) for f in range(2) for c in range(30) for a in [rows[x[rows, f] <= c]] for b in [rows[x[rows, f] > c]] if len(a) and len(b)]
        least = min(options, default=(np.inf,))
        if least[0] >= spread(y[rows], weight[rows]) - 1e-9:
            return {tuple(r): np.average(y[rows], weights=weight[rows]) for r in asked.tolist()}
        near = [o for o in options if o[0] < least[0] + 1e-9]
        _, f, c = min(near, key=lambda o: o[1:])
        return plain(rows[x[rows, f] <= c], asked[asked[:, f] <= c]) | plain(rows[x[rows, f] > c], asked[asked[:, f] > c])

    rule = forest.Rule(binary)
    tree = forest.grown(x, rule.row_sums(weight, y), np.random.default_rng(0), 30, 2, rule)
    got = tree.value[tree.follow(np.zeros(len(x), np.int64), x)]
    want = plain(np.arange(len(x)), x)
    right = [abs(v - want[tuple(r)]) < 1e-9 for v, r in zip(got, x.tolist(), strict=True)]
    assert np.mean(right) > 0.95  # splits of equal gain may differ by rounding
    assert all(tree.value[tree.feature < 0] >= 0)


def test_trees_take_rows_as_often_as_poisson_numbers():
    drawn = np.array([forest.times(np.arange(20000), t, 42) for t in range(3)])
    assert drawn.mean() == pytest.approx(1, abs=0.02) and drawn.var() == pytest.approx(1, abs=0.04)
    assert abs(np.corrcoef(drawn)[np.triu_indices(3, 1)]).max() < 0.03


def test_forests_refuse_labels_that_are_none(spark):
    for y in ("2", "NULL"):
        with pytest.raises(ValueError):
            models.train(noise(spark, 20).withColumn("y", F.expr(f"CAST({y} AS INT)")), ["u"], model_type="rf", trees=1)


def test_the_query_grows_all_trees_of_the_model(spark, monkeypatch):
    from pathloom.plans import analytics

    asked, fit = [], forest.fit

    def few(rows, columns, trees, *rest):
        asked.append(trees)
        return fit(rows, columns, 2, *rest)

    monkeypatch.setattr(forest, "fit", few)
    assert analytics.QUERIES["model_rf"](spark, "/root/testdata/sf0.001").count() == 1
    assert asked == [300]


def test_equal_votes_are_equal_scores_whatever_their_order(spark):
    df = spark.range(64).select("id", (F.col("id") % 2).cast("double").alias("u"), F.expr("CAST(id % 7 AS DOUBLE) / 3").alias("y")).localCheckpoint()
    made = forest.fit(df, ("u",), 150, forest.Rule(False), 1, 3)
    got = forest.predicted(made, df, "id").join(df, F.col("row") == F.col("id")).groupBy("u").agg(F.count_distinct("value").alias("n"))
    assert [r["n"] for r in got.collect()] == [1, 1]
