"""Probability of backtest overfitting by combinatorially symmetric cross-validation.

Rows of the same block that the same blocks purge or embargo are in or out together in every combination. So the data
are aggregated once to moments by configuration and signature, and the combinations only add up moments.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldwise.operators.folds import CombinatoriallySymmetricCV, block_of


@dataclass(frozen=True)
class PBOResult:
    pbo: float
    slope: float | None
    n_combos: int


def check_returns(returns: DataFrame, n_splits: int) -> int:
    """Number of observations. ValueError: gaps, values that aren't finite, one configuration, too few observations."""
    r = F.col("r").cast("double")
    bad = F.coalesce(F.isnan(r) | (F.abs(r) == float("inf")), F.lit(True))
    x = returns.agg(F.countDistinct("config").alias("c"), F.countDistinct("pos").alias("n"), F.count("*").alias("rows"), F.max(bad).alias("bad")).first()
    if x["c"] < 2:
        raise ValueError("at least two configurations")
    if x["rows"] != x["c"] * x["n"] or x["bad"]:
        raise ValueError("every configuration needs one finite value for every observation")
    if x["n"] < n_splits:
        raise ValueError("fewer observations than splits")
    return x["n"]


def sharpe_of(n: Column, total: Column, squares: Column, low: Column, high: Column, mean: Column) -> Column:
    """Mean over sample deviation from centred sums; 0 for under two or equal values."""
    spread = (squares - total * total / n) / (n - 1)
    return F.when((n < 2) | (high == low) | (spread <= 0), F.lit(0.0)).otherwise((mean + total / n) / F.sqrt(spread))


def scores(returns: DataFrame, n_splits: int = 16, samples: DataFrame | None = None, **settings) -> DataFrame:
    """(combo, config, n_is, is_perf, oos_perf) of returns (config, pos, r). With samples (pos, p, e), in-sample rows are
    purged and embargoed around the tested blocks."""
    cv = CombinatoriallySymmetricCV(n_splits, **settings)
    n = check_returns(returns, n_splits)
    if samples is None:
        if settings:
            raise ValueError("purging and embargoes need times")
        rows = returns.withColumn("block", block_of(F.col("pos"), n, n_splits)).withColumn("drop", F.lit(0).cast("bigint"))
    else:
        rows = returns.join(dropped_by(cv, samples, n), "pos")
    rows = rows.withColumn("r", F.col("r").cast("double"))
    mean = rows.groupBy("config").agg(F.avg("r").alias("mean"))
    z = F.col("r") - F.col("mean")
    cells = rows.join(mean, "config").groupBy("config", "mean", "block", "drop").agg(F.count("*").alias("n"), F.sum(z).alias("t"), F.sum(z * z).alias("q"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    combos = returns.sparkSession.createDataFrame(list(enumerate(cv.folds())), "combo int, fmask bigint")
    both = cells.join(F.broadcast(combos), F.lit(True))  # combinations only; cells are few, whatever the rows
    oos = F.expr("shiftleft(1L, block)").bitwiseAND(F.col("fmask")) != 0
    ins = ~oos & (F.col("drop").bitwiseAND(F.col("fmask")) == 0)
    parts = []
    for name, cond in (("i", ins), ("o", oos)):
        parts += [F.sum(F.when(cond, F.col(c))).alias(f"{name}{c}") for c in ("n", "t", "q")] + [F.min(F.when(cond, F.col("lo"))).alias(f"{name}lo"), F.max(F.when(cond, F.col("hi"))).alias(f"{name}hi")]
    agg = both.groupBy("combo", "fmask", "config", "mean").agg(*parts)
    perf = lambda k: sharpe_of(*[F.col(f"{k}{c}") for c in ("n", "t", "q", "lo", "hi")], F.col("mean"))
    return agg.select("combo", "fmask", "config", F.coalesce("in", F.lit(0)).alias("n_is"), perf("i").alias("is_perf"), perf("o").alias("oos_perf")).where("n_is > 0")


def logits(scored: DataFrame) -> DataFrame:
    """(combo, fmask, config, logit, is_best, oos_best): the out-of-sample rank of each combination's best in sample."""
    w = Window.partitionBy("combo")
    ranked = scored.withColumns(
        {
            "_best": F.row_number().over(w.orderBy(F.desc("is_perf"), "config")),
            "_rank": F.rank().over(w.orderBy("oos_perf")) + (F.count("*").over(Window.partitionBy("combo", "oos_perf")) - 1) / 2,
            "_n": F.count("*").over(w),
        }
    )
    omega = F.col("_rank") / (F.col("_n") + 1)
    return ranked.where("_best = 1").select("combo", "fmask", "config", F.log(omega / (1 - omega)).alias("logit"), F.col("is_perf").alias("is_best"), F.col("oos_perf").alias("oos_best"))


def summary(best: DataFrame) -> DataFrame:
    """One row: pbo, slope (null if in-sample scores don't vary or there is one combination), n_combos."""
    var = F.var_pop("is_best")
    return best.agg(
        F.avg(F.when(F.col("logit") < 0, 1.0).otherwise(0.0)).alias("pbo"),
        F.when((var > 0) & (F.count("*") > 1), F.covar_pop("is_best", "oos_best") / var).alias("slope"),
        F.count("*").alias("n_combos"),
    )


def probability_of_backtest_overfitting(returns: DataFrame, n_splits: int = 16, samples: DataFrame | None = None, **settings) -> PBOResult:
    r = summary(logits(scores(returns, n_splits, samples, **settings))).first()
    if not r["n_combos"]:
        raise ValueError("purging leaves no rows in sample in any combination")
    if dropped := math.comb(n_splits, n_splits // 2) - r["n_combos"]:
        warnings.warn(f"{dropped} combinations have no rows left in sample and don't count", stacklevel=2)
    return PBOResult(r["pbo"], r["slope"], r["n_combos"])


def dropped_by(cv: CombinatoriallySymmetricCV, samples: DataFrame, n: int) -> DataFrame:
    """(pos, block, drop): the blocks whose tests purge or embargo each row."""
    masks, m = cv.masks(samples)
    if m != n:
        raise ValueError("times and returns differ in length")
    return masks.select("pos", "block", F.col("purge_mask").bitwiseOR(F.col("embargo_mask")).alias("drop"))


def scores_with(returns: DataFrame, metric: Callable, n_splits: int = 16, samples: DataFrame | None = None, **settings) -> DataFrame:
    """(combo, fmask, config, n_is, is_perf, oos_perf) by any ``metric(values) -> number``; one task a configuration.
    Samples and settings purge and embargo as in ``scores``; combinations without rows in sample are left out."""
    cv = CombinatoriallySymmetricCV(n_splits, **settings)
    n, folds = check_returns(returns, n_splits), cv.folds()
    if samples is None and settings:
        raise ValueError("purging and embargoes need times")
    drops = returns.select("pos").distinct().withColumn("drop", F.lit(0).cast("bigint")) if samples is None else dropped_by(cv, samples, n).drop("block")

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("pos")
        r, drop = pdf.r.to_numpy(float), pdf["drop"].to_numpy("int64")
        sizes = [n // n_splits + (b < n % n_splits) for b in range(n_splits)]
        block = np.repeat(np.arange(n_splits), sizes)
        out = []
        for k, m in enumerate(folds):
            test = (m >> block & 1).astype(bool)
            own = ~test & (drop & m == 0)
            if not own.any():
                continue
            a, b = float(metric(r[own])), float(metric(r[test]))
            if not (np.isfinite(a) and np.isfinite(b)):
                raise ValueError("a metric returns finite numbers")
            out.append((k, m, pdf.config.iloc[0], int(own.sum()), a, b))
        return pd.DataFrame(out, columns=["combo", "fmask", "config", "n_is", "is_perf", "oos_perf"])

    kind = returns.schema["config"].dataType.simpleString()
    return returns.join(drops, "pos").groupBy("config").applyInPandas(run, f"combo int, fmask bigint, config {kind}, n_is bigint, is_perf double, oos_perf double")
