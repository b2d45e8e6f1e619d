"""Backtest paths out of combinatorial folds, their metrics, and models as aggregates."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.functions.horizon import check_bars_per_year
from foldwise.operators.folds import CombinatorialPurgedCV, block_of
from foldwise.operators.scan import ordered_scan
from foldwise.runtime import materialise


def path_table(cv: CombinatorialPurgedCV, spark) -> DataFrame:
    """(fold, block, path): the k-th fold that tests a block feeds path k."""
    seen: dict[int, int] = {}
    rows = []
    for fold, mask in enumerate(cv.folds()):
        for b in range(cv.n_blocks):
            if mask >> b & 1:
                rows.append((fold, b, seen.setdefault(b, 0)))
                seen[b] += 1
    return spark.createDataFrame(rows, "fold int, block int, path int")


def reconstruct_paths(predictions: DataFrame, cv: CombinatorialPurgedCV, n_samples: int, validate: bool = False) -> DataFrame:
    """(fold, pos, prediction) -> (path, pos, prediction); predictions of any type, null where missing."""
    if validate:
        got = {r["fold"]: (r["n"], r["d"]) for r in predictions.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d")).collect()}  # one row a fold
        sizes = [n_samples // cv.n_blocks + (b < n_samples % cv.n_blocks) for b in range(cv.n_blocks)]
        want = {f: sum(s for b, s in enumerate(sizes) if m >> b & 1) for f, m in enumerate(cv.folds())}
        if set(got) != set(want):
            raise ValueError(f"predictions of {len(got)} folds, not {len(want)}")
        if any(got[f] != (want[f], want[f]) for f in want):
            raise ValueError("a fold's predictions don't cover its test rows once each")
    rows = predictions.withColumn("block", block_of(F.col("pos"), n_samples, cv.n_blocks))
    return rows.join(F.broadcast(path_table(cv, predictions.sparkSession)), ["fold", "block"]).select("path", "pos", "prediction")  # as many rows as folds x tested blocks


def warn_empty(trained: set[int], cv: CombinatorialPurgedCV) -> None:
    if empty := sorted(set(range(cv.get_n_splits())) - trained):
        warnings.warn(f"no rows to train on in folds {', '.join(map(str, empty))}: their predictions are missing", stacklevel=3)


def fold_predictions(stages: DataFrame, cv: CombinatorialPurgedCV, fit: dict[str, Column], predict: Column) -> DataFrame:
    """Train by aggregates over each fold's final rows and predict its test rows; null, with a warning, where a fold has
    none to train on."""
    model = stages.where("is_final").groupBy("fold").agg(*[c.alias(k) for k, c in fit.items()])
    found = model.collect()  # one row a fold
    warn_empty({r["fold"] for r in found}, cv)
    model = stages.sparkSession.createDataFrame(found, model.schema)
    return stages.where("is_test").join(F.broadcast(model), "fold", "left").select("fold", "pos", predict.alias("prediction"))  # one row a fold


def backtest_paths(samples: DataFrame, cv: CombinatorialPurgedCV, fit: dict[str, Column], predict: Column) -> DataFrame:
    stages = cv.stages(samples)
    return reconstruct_paths(fold_predictions(stages, cv, fit, predict), cv, samples.count())


def backtest_paths_with(samples: DataFrame, cv: CombinatorialPurgedCV, model: Callable, columns: list[str]) -> DataFrame:
    """For models that aggregates can't express: ``model(train_pdf, test_pdf) -> predictions``, one task a fold. A fold
    with nothing to train on predicts NaN, with a warning."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        train, test = pdf[pdf.is_final], pdf[pdf.is_test].sort_values("pos")
        out = np.full(len(test), np.nan) if train.empty else np.asarray(model(train.sort_values("pos"), test), float)
        if out.shape != (len(test),):
            raise ValueError("a model returns one number for each test row")
        return pd.DataFrame({"fold": test.fold, "pos": test.pos, "prediction": out})

    stages = cv.stages(samples).where("is_final OR is_test").select("fold", "pos", "is_final", "is_test", *columns)
    warn_empty({r["fold"] for r in stages.where("is_final").select("fold").distinct().collect()}, cv)
    return reconstruct_paths(stages.groupBy("fold").applyInPandas(run, "fold int, pos bigint, prediction double"), cv, samples.count())


def backtest_paths_ml(samples: DataFrame, cv: CombinatorialPurgedCV, estimator, columns: list[str], prediction: str = "prediction") -> DataFrame:
    """For ``pyspark.ml`` estimators (or pipelines): one fit a fold, each distributed. A fold with nothing to train on
    predicts null, with a warning."""
    stages = materialise(cv.stages(samples).where("is_final OR is_test").select("fold", "pos", "is_final", "is_test", *columns), "stages")
    out = None
    for fold in range(cv.get_n_splits()):
        own = stages.where(F.col("fold") == fold)
        train, test = own.where("is_final"), own.where("is_test")
        if train.limit(1).count():
            part = estimator.fit(train).transform(test).select("fold", "pos", F.col(prediction).cast("double").alias("prediction"))
        else:
            warnings.warn(f"fold {fold} has no rows to train on", stacklevel=2)
            part = test.select("fold", "pos", F.lit(None).cast("double").alias("prediction"))
        out = part if out is None else out.unionByName(part)
    return reconstruct_paths(out, cv, samples.count())


def path_metrics(paths: DataFrame, value: str = "prediction", bars_per_year: float | None = None, metrics: dict[str, Column] | None = None, parallel: bool | None = None) -> DataFrame:
    """(path, sharpe, calmar, max_drawdown, total_return) of (path, pos, value); null for NaN. Values that aren't finite
    are left out; under two left: all null. With ``metrics`` (aggregates), those instead."""
    if metrics is not None:
        return paths.groupBy("path").agg(*[c.alias(k) for k, c in metrics.items()])
    year = check_bars_per_year(bars_per_year)
    x = F.col(value).cast("double")
    good = paths.withColumn("_r", F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x))
    curve = ordered_scan(good.select("path", "pos", "_r"), ["pos"], {"_equity": ("sum", F.coalesce("_r", F.lit(0.0)))}, parallel, ["path"])
    curve = ordered_scan(curve, ["pos"], {"_high": ("max", F.col("_equity"))}, parallel, ["path"]).withColumn("_peak", F.greatest(F.lit(0.0), F.col("_high")))
    agg = curve.groupBy("path").agg(F.count("_r").alias("n"), F.avg("_r").alias("m"), F.stddev_samp("_r").alias("s"), F.sum("_r").alias("total"), F.max(F.col("_peak") - F.col("_equity")).alias("dd"))
    enough = F.col("n") >= 2
    sharpe = F.when(enough & (F.col("s") > 0), F.col("m") / F.col("s") * F.lit((year or 1.0) ** 0.5))
    gain = F.col("m") * F.lit(year) if year else F.col("total")
    return agg.select(
        "path", sharpe.alias("sharpe"), F.when(enough & (F.col("dd") > 0), gain / F.col("dd")).alias("calmar"),
        F.when(enough, F.col("dd") + F.lit(0.0)).alias("max_drawdown"), F.when(enough, F.col("total")).alias("total_return"),
    )


def path_metrics_with(paths: DataFrame, metric: Callable, names: list[str], value: str = "prediction") -> DataFrame:
    """For metrics that aggregates can't express: ``metric(values) -> mapping``, one task a path."""

    def run(pdf):
        import pandas as pd

        got = metric(pdf.sort_values("pos")[value].to_numpy())
        return pd.DataFrame([{"path": pdf.path.iloc[0], **{n: float(got[n]) for n in names}}])

    return paths.groupBy("path").applyInPandas(run, "path int, " + ", ".join(f"`{n}` double" for n in names))
