"""Spark ML models over case features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import resampling, stats
from pathloom.functions.ranks import quantiles
from pathloom.operators import forest
from pathloom.operators.forest import DEPTH
from pathloom.sources.tables import written


@dataclass(frozen=True)
class Trained:
    pipeline: PipelineModel | forest.Forest
    columns: tuple[str, ...]
    task: str
    model_type: str


def _class_weights(df: DataFrame, weight: str | None) -> tuple[float, float]:
    """Weights n / (2 n_class), so that both classes weigh the same."""
    own = F.col(weight) if weight else F.lit(1.0)
    sums = {r["y"]: r["w"] for r in df.where("y in (0, 1)").groupBy("y").agg(F.sum(own).alias("w")).collect()}  # two rows
    total = sum(sums.values())
    return tuple(total / (2 * sums[y]) if sums.get(y) else 1.0 for y in (0, 1))


def train(
    df: DataFrame, columns: list[str], task: str = "binary", model_type: str = "logreg", seed: int = 42, trees: int | None = None,
    weight: str | None = None, depth: int = DEPTH,
) -> Trained:
    """binary: logistic regression (L2, C = 1, scaled without centring) or a
    balanced forest; regression: ridge (alpha = 1) or a forest.  ``weight`` names
    a column of rows' weights, for forests.  What a fit reads is written once:
    its passes don't work out the cases again."""
    needed = df.select(*columns, F.col("y").cast("double").alias("y"), *([weight] if weight else []))
    rows = written(needed.fillna(0.0, subset=list(columns)), "fit")
    steps = [VectorAssembler(inputCols=list(columns), outputCol="raw_"), StandardScaler(inputCol="raw_", outputCol="features", withMean=False)]
    shape = rows.agg(F.count(F.lit(1)), F.stddev_pop("y")).first()
    n, spread = shape[0], shape[1] or 0.0
    if task == "binary" and model_type == "logreg":
        model = LogisticRegression(labelCol="y", maxIter=2000, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False)
    elif task == "binary" and model_type == "rf":
        rule = forest.Rule(True, _class_weights(rows, weight))
        return Trained(forest.fit(rows, tuple(columns), trees or 300, rule, ceil(sqrt(len(columns))), seed, depth, weight), tuple(columns), task, model_type)
    elif task == "regression" and model_type == "logreg":
        penalty = max(spread, 1e-12) / max(n, 1)
        model = LinearRegression(labelCol="y", regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal")
    elif task == "regression" and model_type == "rf":
        return Trained(forest.fit(rows, tuple(columns), trees or 500, forest.Rule(False), len(columns), seed, depth, weight), tuple(columns), task, model_type)
    else:
        raise ValueError(f"unknown task or model: {task!r}, {model_type!r}")
    return Trained(Pipeline(stages=[*steps, model]).fit(rows), tuple(columns), task, model_type)


def predict(trained: Trained, df: DataFrame) -> DataFrame:
    """``df`` with y_pred and, for two classes, y_score; columns that the model
    wants and ``df`` lacks are 0."""
    for c in trained.columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    filled = df.fillna(0.0, subset=list(trained.columns))
    if trained.model_type == "rf":
        rows = written(filled.withColumn("row_", F.monotonically_increasing_id()), "asked")
        got = forest.predicted(trained.pipeline, rows, "row_").withColumnsRenamed({"row": "row_", "value": "value_"})
        named = {"y_pred": F.col("value_"), "y_score": F.lit(None).cast("double")}
        if trained.task == "binary":
            named = {"y_pred": (F.col("value_") > 0.5).cast("double"), "y_score": F.col("value_")}
        return rows.join(got, "row_").withColumns(named).drop("row_", "value_")
    out = trained.pipeline.transform(filled)
    score = vector_to_array("probability")[1] if trained.task == "binary" else F.lit(None).cast("double")
    named = out.withColumns({"y_pred": F.col("prediction"), "y_score": score})
    return named.drop("raw_", "features", "rawPrediction", "probability", "prediction")


def split(df: DataFrame, key: str, share: float = 0.25, seed: int = 42, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test: of all rows, or of each value of ``by``, those whose key's
    hash is at most the hashes' quantile ``share`` are for the test, which is
    that share to within a row.  A value of one row alone is for training."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13)
    rows = df.withColumn("hash_", F.conv(digits, 16, 10).cast("double"))  # 52 bits
    limits = quantiles(rows, "hash_", {"limit_": share}, [by] if by else [], {"of_": "count(1)"})
    if by:
        limits = limits.withColumnRenamed(by, "by_")
        rows = rows.join(limits, F.col(by).eqNullSafe(F.col("by_"))).drop("by_")
    else:
        rows = rows.crossJoin(F.broadcast(limits))
    test = (F.col("hash_") <= F.col("limit_")) & (F.col("of_") > 1)
    return rows.where(~test).select(*df.columns), rows.where(test).select(*df.columns)


def evaluate(df: DataFrame, columns: list[str], key: str, task: str = "binary", model_type: str = "logreg", trees: int | None = None) -> DataFrame:
    """Metrics of a model fitted on three quarters (of each class), on the rest."""
    cases = written(df.select(*dict.fromkeys([key, "y", *columns])), "cases")
    fit_on, test = split(cases, key, by="y" if task == "binary" else None)
    predicted = predict(train(fit_on, columns, task, model_type, trees=trees), test)
    got = written(predicted.select(F.col("y").alias("y_true"), "y_pred", "y_score"), "predicted")
    if task == "regression":
        return stats.regression_metrics(got)
    return stats.binary_metrics(got).crossJoin(stats.roc_auc(got)).crossJoin(stats.average_precision(got))


def performance_table(df: DataFrame, columns: list[str], key: str, task: str = "binary", model_types: tuple[str, ...] = ("logreg", "rf"), trees: int | None = None) -> DataFrame:
    """A row a model: model_type and its metrics on the same held-out rows."""
    rows = [evaluate(df, columns, key, task, m, trees).withColumn("model_type", F.lit(m)) for m in model_types]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.select("model_type", *[c for c in out.columns if c != "model_type"])


def _newton(rows: DataFrame, betas: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (draws x k) and Hessians (draws x k x k) of the weighted losses
    of all draws at their betas.  Each task adds up its rows in batches and sends
    one number for each draw and entry; they are added by Spark."""
    draws, k = betas.shape
    upper = np.triu_indices(k)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h = np.zeros((draws, k)), np.zeros((draws, len(upper[0])))
        for batch in batches:
            x, t = np.stack(batch["x"].to_numpy()), batch["t"].to_numpy(float)
            w = np.stack(batch["w"].to_numpy()).astype(float).T  # draws x rows
            at = betas @ x.T
            p = 1 / (1 + np.exp(-np.clip(at, -700, 700))) if logistic else at
            g += (w * (p - t)) @ x
            h += (w * (p * (1 - p) if logistic else 1.0)) @ (x[:, upper[0]] * x[:, upper[1]])
        both = np.hstack([g, h])
        yield pd.DataFrame({"b": np.repeat(np.arange(draws), both.shape[1]), "i": np.tile(np.arange(both.shape[1]), draws), "v": both.ravel()})

    sums = rows.mapInPandas(add, "b int, i int, v double").groupBy("b", "i").agg(F.sum("v").alias("v")).toPandas()  # draws x k * (k + 3) / 2
    both = np.zeros((draws, k + len(upper[0])))
    both[sums["b"], sums["i"]] = sums["v"]
    hessian = np.zeros((draws, k, k))
    hessian[:, upper[0], upper[1]] = hessian[:, upper[1], upper[0]] = both[:, k:]
    return both[:, :k], hessian


def _refit_linear(rows: DataFrame, k: int, draws: int, logistic: bool, steps: int = 30) -> np.ndarray:
    """Coefficients of all draws: penalised least squares or logistic losses
    (L2, C = 1, the intercept free), by Newton's method; a pass over the rows a step."""
    betas, penalty = np.zeros((draws, k)), np.diag([1e-9] + [1.0] * (k - 1))
    for _ in range(steps if logistic else 1):
        g, h = _newton(rows, betas, logistic)
        move = np.linalg.solve(h + penalty, (g + betas @ penalty)[:, :, None])[:, :, 0]
        betas = betas - move * np.minimum(1.0, 5.0 / np.maximum(np.abs(move).max(axis=1, keepdims=True), 1e-300))
        if np.abs(move).max() < 1e-8:
            break
    return betas


def bootstrap_refit(
    df: DataFrame, columns: list[str], key: str, profile: dict[str, float], n_boot: int = 50, seed: int = 42, least: int = 50,
    task: str = "regression", model_type: str = "logreg", alpha: float = 0.05, trees: int | None = None,
) -> DataFrame:
    """Prediction of one profile (a number, or the probability of 1) by models
    refitted on resampled cases: estimate (of all cases), ci_low, ci_high.

    A draw gives each case a Poisson(1) weight from a hash of its key.  Ridge
    and logistic models (scaled without centring, as in train) of all draws are
    fitted together: a pass over the cases a Newton step, and n_boot times
    features squared numbers to the driver.  Forests are fitted one after the
    other, with the weights as cases' weights."""
    if (task, model_type) not in {(t, m) for t in ("binary", "regression") for m in ("logreg", "rf")}:
        raise ValueError(f"unknown task or model: {task!r}, {model_type!r}")
    plain = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]
    shape = df.agg(F.count(F.lit(1)), *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(plain)]).first()
    if shape[0] < least:
        raise ValueError(f"a refit bootstrap needs {least} cases; there are {shape[0]}")
    named = f"`{key}`"
    if model_type == "rf":
        got = [predict(train(df, columns, task, "rf", seed, trees), _profile(df, columns, profile)).first()]
        for b in range(n_boot):
            weighed = df.withColumn("draw_", F.expr(resampling.weight(seed, named, b)).cast("double")).where("draw_ > 0")
            got.append(predict(train(weighed, columns, task, "rf", seed + b + 1, trees, weight="draw_"), _profile(df, columns, profile)).first())
        values = np.array([r["y_score"] if task == "binary" else r["y_pred"] for r in got])
    else:
        scale = np.array([1.0, *[float(d) if d else 1.0 for d in shape[1:]]])
        x = F.array(F.lit(1.0), *[c / d for c, d in zip(plain, map(float, scale[1:]), strict=True)])
        every = F.expr(f"concat(array(1), {resampling.all_weights(seed, named, n_boot)})").cast("array<tinyint>")
        rows = written(df.select(x.alias("x"), F.col("y").cast("double").alias("t"), every.alias("w")), "refit")
        betas = _refit_linear(rows, len(scale), n_boot + 1, task == "binary")
        at = betas @ (np.array([1.0, *[float(profile.get(c, 0.0)) for c in columns]]) / scale)
        values = 1 / (1 + np.exp(-at)) if task == "binary" else at
    low, high = np.quantile(values[1:], [alpha / 2, 1 - alpha / 2])
    return df.sparkSession.createDataFrame([(float(values[0]), float(low), float(high))], "estimate double, ci_low double, ci_high double")


def _profile(df: DataFrame, columns: list[str], profile: dict[str, float]) -> DataFrame:
    return df.sparkSession.range(1).select(*[F.lit(float(profile.get(c, 0.0))).alias(c) for c in columns])


def coefficients(trained: Trained) -> dict[str, float]:
    """Of a linear model, in units of the features as given."""
    scaler, model = trained.pipeline.stages[1], trained.pipeline.stages[2]
    return {c: float(b) / (float(d) or sqrt(1.0)) for c, b, d in zip(trained.columns, model.coefficients, scaler.std, strict=True)}
