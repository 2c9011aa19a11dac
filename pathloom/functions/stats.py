"""Metrics, confidence intervals and distributions as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import resampling
from pathloom.functions.ranks import quantiles, running

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of a share k / n, within 0 and 1; null without trials."""
    n, p = n.cast("double"), k.cast("double") / F.nullif(n.cast("double"), F.lit(0.0))
    bottom = 1 + z * z / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (F.when(n > 0, x) for x in ((middle - half) / bottom, (middle + half) / bottom))
    return F.when(low.isNotNull(), F.greatest(low, F.lit(0.0))), F.when(high.isNotNull(), F.least(high, F.lit(1.0)))


def bootstrap_ci(values: DataFrame, column: str, order: list[str], statistic: str = "mean", n_boot: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row: estimate, ci_low, ci_high of one statistic; ``order`` names
    columns that tell the values' rows apart."""
    found = resampling.bootstrap_cis(values, column, order, [statistic], n_boot, alpha, seed)
    return found.toDF("estimate", "ci_low", "ci_high")


def binary_metrics(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = df.agg(*[F.count_if(c).cast("double").alias(x) for x, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))])
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    recall = over(tp, tp + fn)
    return n.select(
        over(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ((recall + over(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        over(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
        over(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Positives and negatives at each score; ties are one row."""
    y = F.col(truth).cast("double")
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def roc_auc(df: DataFrame, truth: str = "y_true", score: str = "y_score") -> DataFrame:
    """The chance that a positive scores higher than a negative; ties count half."""
    levels = running(_by_score(df, truth, score), "score", {"below": "neg"}, inclusive=False)
    wins = F.col("pos") * (F.col("below") + F.col("neg") / 2)
    return levels.agg((F.sum(wins) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("roc_auc"))


def average_precision(df: DataFrame, truth: str = "y_true", score: str = "y_score") -> DataFrame:
    """Precision at each distinct score, weighted by the recall gained there."""
    levels = _by_score(df, truth, score).withColumn("both", F.col("pos") + F.col("neg"))
    above = running(levels, "score", {"tp": "pos", "seen": "both"}, descending=True)
    gain = F.col("pos") * F.col("tp") / F.col("seen")
    return above.agg((F.sum(gain) / F.nullif(F.sum("pos"), F.lit(0.0))).alias("avg_precision"))


def regression_metrics(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    y, e = F.col(truth).cast("double"), F.col(truth).cast("double") - F.col(predicted).cast("double")
    return df.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.nullif(F.count(y) * F.var_pop(y), F.lit(0.0))).alias("r2"),
    )


def ecdf(df: DataFrame, column: str, by: str) -> DataFrame:
    """Share of a group's rows up to each value, by distinct value; nulls have
    no place."""
    counts = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(F.col(by).alias("by_")).agg(F.sum("n").alias("of_"))
    upto = running(counts, column, {"upto_": "n"}, by=[by]).join(totals, F.col(by).eqNullSafe(F.col("by_")))
    return upto.select(by, column, (F.col("upto_") / F.col("of_")).alias("share"))


def histogram(df: DataFrame, column: str, bins: int = 50, top_quantile: float = 0.99) -> DataFrame:
    """bin (from 0), n: equal widths from the least value to a quantile; values
    beyond it aren't shown."""
    ends = quantiles(df, column, {"hi": top_quantile}, also={"lo": f"CAST(min(`{column}`) AS DOUBLE)"})
    both = df.crossJoin(F.broadcast(ends)).where(F.col(column) <= F.col("hi"))
    at = F.floor((F.col(column) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    return both.select(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
