"""Online label maturation: predictions meet outcomes once their label interval has ended. An extension for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def matured(predictions: DataFrame, outcomes: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """predictions (key, p, e, prediction) joined with outcomes (key, at, y) of their label's interval [p, e).

    Both may be streams; watermarks bound the state to predictions whose label may still get outcomes."""
    a = predictions.withWatermark("p", delay).alias("a")
    b = outcomes.withWatermark("at", delay).alias("b")
    cond = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.at") >= F.col("a.p")) & (F.col("b.at") < F.col("a.e"))
    return a.join(b, cond).select(F.col(f"a.{key}").alias(key), "a.p", "a.e", "a.prediction", "b.at", "b.y")
