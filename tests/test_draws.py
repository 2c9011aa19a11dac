from pathloom.operators import simulate


def test_draws_take_the_point_that_has_the_weight_of_a_tie(spark):
    weights = spark.createDataFrame([(8.0, 1.0, 1.0), (8.1, 1.0, 2.5e-311), (8.0, 1.1, 1.3e-275)], "mu double, kappa double, weight double")
    drawn = simulate.predictive_times(weights, 50)
    assert {(r["mu"], r["kappa"]) for r in drawn.collect()} == {(8.0, 1.0)}
