"""Sharpe-ratio statistics: moments, probabilistic and deflated Sharpe ratios, track-record and backtest lengths."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldwise.functions.horizon import check_integer
from foldwise.operators.scan import ordered_scan

EULER_GAMMA = 0.5772156649015329

# Coefficients of Hart's rational approximation of the normal distribution, highest power first.
_NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _number(x: float) -> str:
    text = repr(float(x))
    return text if "e" in text else text + "E0"


def _horner(x: str, coefficients) -> str:
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def phi_sql(x: str) -> str:
    """The normal distribution function of a SQL expression, in double precision; plain enough for any dialect."""
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2E0) * {_horner(a, _NUMERATOR)} / {_horner(a, _DENOMINATOR)}"
    far = a
    for k in (0.65, 4, 3, 2, 1):
        far = f"({a} + {_number(k)})" if k == 0.65 else f"({a} + {_number(k)} / {far})"
    tail = f"CASE WHEN {a} > 37E0 THEN 0E0 WHEN {a} < 7.07106781186547E0 THEN {near} ELSE exp(-{a} * {a} / 2E0) / {far} / 2.506628274631E0 END"
    return f"(CASE WHEN {x} > 0E0 THEN 1E0 - ({tail}) ELSE ({tail}) END)"


def phi(column: str) -> Column:
    return F.expr(phi_sql(column))


def expected_max_z(n: int) -> float:
    """The expected largest of n independent standard normal draws, approximately; 0 for one."""
    n = check_integer(n, "n_trials", 1)
    if n == 1:
        return 0.0
    z = NormalDist().inv_cdf
    return (1 - EULER_GAMMA) * z(1 - 1 / n) + EULER_GAMMA * z(1 - 1 / (n * math.e))


def sharpe_moments(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by..., n, sharpe (population deviation), skew and kurt (bias-corrected, kurt not in excess). Null where undefined:
    under two values, no variance, or a value that isn't finite."""
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    agg = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.bool_and(finite).alias("ok"))
    n = F.col("n").cast("double")
    skew = F.when(F.col("n") > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.col("g1"))
    excess = F.when(F.col("n") > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).otherwise(F.col("g2"))
    good = F.col("ok") & (F.col("n") >= 2) & (F.col("hi") > F.col("lo")) & (F.col("s") > 0)
    return agg.select(*by, "n", F.when(good, F.col("m") / F.col("s")).alias("sharpe"), F.when(good, skew).alias("skew"), F.when(good, excess + 3).alias("kurt"))


def probabilistic_sharpe(moments: DataFrame, benchmark: Column | float = 0.0, name: str = "psr") -> DataFrame:
    """moments with the probability that the true Sharpe ratio exceeds the benchmark; null where the spread is undefined."""
    sr = F.col("sharpe")
    spread = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    b = benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))
    out = moments.withColumn("_z", F.when(spread > 0, (sr - b) * F.sqrt(F.col("n") - 1.0) / F.sqrt(spread)))
    return out.withColumn(name, F.when(F.col("_z").isNotNull(), phi("_z"))).drop("_z")


def check_dsr(n_trials: int, var_sharpe: float, bars_per_year: float | None = None) -> float:
    check_integer(n_trials, "n_trials", 1)
    if not (math.isfinite(var_sharpe) and var_sharpe >= 0):
        raise ValueError("var_sharpe is finite and not negative")
    return var_sharpe / bars_per_year if bars_per_year else var_sharpe


def deflated_sharpe(moments: DataFrame, n_trials: int, var_sharpe: float, bars_per_year: float | None = None) -> DataFrame:
    """The nine diagnostics: dsr, observed_sr, sr_star, expected_max_z, var_sharpe, n_trials, n_obs, skew, kurt, by key."""
    var = check_dsr(n_trials, var_sharpe, bars_per_year)
    z = expected_max_z(n_trials)
    star = math.sqrt(var) * z
    keys = [c for c in moments.columns if c not in ("n", "sharpe", "skew", "kurt")]
    out = probabilistic_sharpe(moments, star, "dsr")
    return out.select(
        *keys, "dsr", F.col("sharpe").alias("observed_sr"), F.lit(star).alias("sr_star"), F.lit(z).alias("expected_max_z"), F.lit(float(var)).alias("var_sharpe"),
        F.lit(n_trials).cast("bigint").alias("n_trials"), F.col("n").alias("n_obs"), "skew", "kurt",
    )


def min_track_record(moments: DataFrame, target: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """moments with ``min_trl``: observations until the Sharpe ratio exceeds the target at level alpha; infinite if it
    doesn't, 2 for alpha of one half or more."""
    if not 0 < alpha < 1:
        raise ValueError("alpha is between 0 and 1")
    z = NormalDist().inv_cdf(1 - alpha)
    sr = F.col("sharpe")
    spread = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    steps = F.ceil(F.pow(F.lit(z) * F.sqrt(spread) / (sr - target), 2.0)).cast("double") + 1
    value = F.when(sr.isNull(), F.lit(None)).when(sr <= target, F.lit(float("inf"))).when(F.lit(z <= 0), F.lit(2.0)).when(spread > 0, steps)
    return moments.withColumn("min_trl", value.cast("double"))


def min_track_record_length(observed: float, target: float, alpha: float, skew: float, kurtosis: float) -> float:
    """The same for given moments."""
    if not all(math.isfinite(x) for x in (observed, target, skew, kurtosis)):
        raise ValueError("moments are finite")
    if not 0 < alpha < 1:
        raise ValueError("alpha is between 0 and 1")
    if observed <= target:
        return math.inf
    spread = 1 - skew * observed + (kurtosis - 1) / 4 * observed**2
    if spread <= 0:
        raise ValueError("the spread of the Sharpe ratio is undefined")
    z = NormalDist().inv_cdf(1 - alpha)
    return 2.0 if z <= 0 else math.ceil((z * math.sqrt(spread) / (observed - target)) ** 2) + 1.0


def minimum_backtest_length(n_trials: int, target_sharpe: float = 1.0) -> float:
    """Years below which the best of n skill-less trials is expected to reach the target."""
    if not (math.isfinite(target_sharpe) and target_sharpe > 0):
        raise ValueError("target_sharpe is positive")
    return (expected_max_z(n_trials) / target_sharpe) ** 2


def effective_trials(df: DataFrame, value: str, t: str, *by: str, lags: int = 32) -> DataFrame:
    """by..., n, effective: n over 1 + 2 x the sum of autocorrelations up to the first that isn't positive, rounded half
    to even, in 1..n. Under 3 values: n; without variance: 1. Lags are tried in growing runs until all keys are done."""
    x = ordered_scan(df.select(*by, F.col(t).alias("_t"), F.col(value).cast("double").alias("_x")), ["_t"], {"_i": ("count", F.lit(1))}, by=by).drop("_t")
    w = Window.partitionBy(*by)
    x = x.withColumn("_m", F.avg("_x").over(w)) if by else x.crossJoin(F.broadcast(x.agg(F.avg("_x").alias("_m"))))  # one row
    x = x.withColumn("_z", F.col("_x") - F.col("_m")).drop("_m")
    keys = x.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("ss"), (F.max("_x") > F.min("_x")).alias("varies"))
    longest = keys.agg(F.max("n")).first()[0] or 0
    while True:
        own = x.select(*by, F.col("_i").alias("_j"), F.col("_z").alias("_y"))
        shifted = x.select(*by, "_z", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("_k"), "_i").withColumn("_j", F.col("_i") + F.col("_k"))
        acf = shifted.join(own, [*by, "_j"]).groupBy(*by, "_k").agg(F.sum(F.col("_z") * F.col("_y")).alias("c")).join(keys, list(by)) if by else shifted.join(own, "_j").groupBy("_k").agg(F.sum(F.col("_z") * F.col("_y")).alias("c")).crossJoin(F.broadcast(keys))  # one row
        acf = acf.withColumn("rho", F.when(F.col("ss") > 0, F.col("c") / F.col("ss")).otherwise(0.0))
        stop = F.min(F.when(F.col("rho") <= 0, F.col("_k"))).over(w)
        summed = acf.withColumn("_stop", stop)
        if lags >= longest or not summed.where(F.col("_stop").isNull() & (F.col("n") > lags + 1) & F.col("varies")).limit(1).count():
            break
        lags *= 4
    total = summed.where(F.col("_stop").isNull() | (F.col("_k") < F.col("_stop"))).groupBy(*by).agg(F.sum("rho").alias("r"))
    out = keys.join(total, list(by), "left") if by else keys.crossJoin(F.broadcast(total))  # one row
    raw = F.bround(F.col("n") / (1 + 2 * F.coalesce("r", F.lit(0.0))), 0)
    value_ = F.when(F.col("n") < 3, F.col("n")).when(~F.col("varies"), F.lit(1)).otherwise(F.least(F.greatest(raw, F.lit(1)), F.col("n")))
    return out.select(*by, "n", value_.cast("bigint").alias("effective"))
