"""Feature, label and scoring builders for studies on panels. Windows are per entity, so they scale with entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldwise.operators.scan import with_positions


def _frame(by: list[str], order: list[str], a: int, b: int):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(a, b)


def lag(value: str, k: int, by: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order)
    return F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w)


def rolling(value: str, window: int, how: str, by: list[str], order: list[str], shift: int = 1) -> Column:
    """mean, std (sample) or sum of the ``window`` rows up to ``shift`` before; null until the window is full."""
    w = _frame(by, order, -(window + shift - 1), -shift)
    f = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}[how]
    return F.when(F.count(value).over(w) == window, f(value).over(w))


def rolling_zscore(value: str, window: int, by: list[str], order: list[str]) -> Column:
    """Distance of this row from the mean of the window that ends here, in its sample deviations."""
    w = _frame(by, order, -(window - 1), 0)
    s = F.stddev_samp(value).over(w)
    return F.when((F.count(value).over(w) == window) & (s > 0), (F.col(value) - F.avg(value).over(w)) / s)


def forward_mean(value: str, h: int, by: list[str], order: list[str]) -> Column:
    """Mean of rows t+1 to t+h; null if the window isn't complete."""
    w = _frame(by, order, 1, h)
    return F.when(F.count(value).over(w) == h, F.avg(value).over(w))


def log_return(value: str, k: int, by: list[str], order: list[str]) -> Column:
    return F.log(F.col(value) / lag(value, k, by, order))


def cumulative(value: str, by: list[str], order: list[str]) -> Column:
    return F.sum(value).over(_frame(by, order, Window.unboundedPreceding, 0))


def calendar(ts: str) -> dict[str, Column]:
    """Half hour of the day, day of the week (Monday 0) and weekend."""
    day = F.expr(f"weekday({ts})")
    return {"hh": (F.hour(ts) * 2 + F.floor(F.minute(ts) / 30)).cast("int"), "dow": day.cast("int"), "weekend": F.when(day >= 5, 1).otherwise(0)}


def resample(df: DataFrame, ts: str, unit: str, value: str, how: str, by: list[str]) -> DataFrame:
    f = {"mean": F.avg, "sum": F.sum}[how]
    return df.groupBy(*by, F.date_trunc(unit, ts).cast("timestamp_ntz").alias(unit)).agg(f(value).alias("value"))


def pivot_mean(df: DataFrame, by: list[str], key: str, values: list[str], value: str) -> DataFrame:
    """One column for each named value of ``key``; the list keeps it to one pass."""
    return df.groupBy(*by).agg(*[F.avg(F.when(F.col(key) == v, F.col(value))).alias(v) for v in values])


def fill(value: str, by: list[str], order: list[str]) -> Column:
    """The last value before, else the first after."""
    before = F.last(value, True).over(_frame(by, order, Window.unboundedPreceding, 0))
    return F.coalesce(before, F.first(value, True).over(_frame(by, order, 0, Window.unboundedFollowing)))


def interpolated(value: str, by: list[str], order: list[str]) -> Column:
    """Linear between known neighbours by row number; the last known value after the end; null before the start."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    known = F.when(F.col(value).isNotNull(), F.struct(i.alias("i"), F.col(value).alias("v")))
    a = F.last(known, True).over(_frame(by, order, Window.unboundedPreceding, 0))
    b = F.first(known, True).over(_frame(by, order, 0, Window.unboundedFollowing))
    return F.when(F.col(value).isNotNull(), F.col(value)).when(b.isNull(), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (i - a["i"]) / (b["i"] - a["i"]))


def to_number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def eligible(df: DataFrame, entity: str, ts: str, min_rows: int, min_days: int) -> DataFrame:
    out = df.groupBy(entity).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return out.withColumn("days", F.datediff("last_ts", "first_ts").cast("bigint")).where((F.col("n") >= min_rows) & (F.col("days") >= min_days))


def causal_target_mean(df: DataFrame, entity: str, day: str, y: str, prior: Column) -> DataFrame:
    """df with ``encoded``: the entity's mean of y over strictly earlier days, or the prior."""
    per = df.groupBy(entity, day).agg(F.sum(y).alias("_s"), F.count(y).alias("_c"))
    w = Window.partitionBy(entity).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    past = per.select(entity, day, F.sum("_s").over(w).alias("_ps"), F.sum("_c").over(w).alias("_pc"))
    return df.join(past, [entity, day]).withColumn("encoded", F.when(F.col("_pc") > 0, F.col("_ps") / F.col("_pc")).otherwise(prior)).drop("_ps", "_pc")


def errors(y: str, f: str) -> dict[str, Column]:
    d = F.col(y) - F.col(f)
    sst = F.var_pop(y) * F.count(y)
    return {"mae": F.avg(F.abs(d)), "wape": F.sum(F.abs(d)) / F.sum(F.abs(y)), "r2": F.when(sst > 0, 1 - F.sum(d * d) / sst)}


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def auc(df: DataFrame, y: str, score: str, *by: str) -> DataFrame:
    """by..., auc by average ranks: counts by score first, so ties and skew shrink before any window."""
    per = df.groupBy(*by, score).agg(F.sum(F.col(y).cast("bigint")).alias("p"), F.sum((1 - F.col(y)).cast("bigint")).alias("n"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = per.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    agg = won.groupBy(*by).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return agg.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / F.col("p") / F.col("n")).alias("auc"))


def interval95(df: DataFrame, value: str, t_quantile: float) -> DataFrame:
    half = F.lit(t_quantile) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def cluster_bootstrap(df: DataFrame, entity: str, value: str, resamples: int, seed: int = 0) -> DataFrame:
    """(b, mean): means over resampled entities. Draw j of resample b is the entity whose rank a hash picks; entities are
    aggregated first, so the resamples move two numbers an entity."""
    per = df.groupBy(entity).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    n = per.count()
    ranked = with_positions(per, [entity], "_i")
    draws = df.sparkSession.range(resamples * n).select((F.floor(F.col("id") / n)).alias("b"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("_i"))
    return draws.join(ranked, "_i").groupBy("b").agg((F.sum("s") / F.sum("c")).alias("mean"))
