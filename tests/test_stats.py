import math
from statistics import NormalDist

import numpy as np
import pytest

from foldwise.functions import stats
from foldwise.operators.search import TrialSharpeRecorder, trial_variance


def test_phi(spark):
    x = [-40.0, -8.0, -1.0, 0.0, 0.3, 2.0, 7.5, 40.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(stats.phi("x")).collect()
    for v, (p,) in zip(x, got):
        assert p == pytest.approx(NormalDist().cdf(v), abs=1e-15)


def test_moments_and_psr(spark):
    r = np.random.default_rng(1).normal(0.001, 0.01, 250)
    row = stats.probabilistic_sharpe(stats.sharpe_moments(spark.createDataFrame([(0, float(v)) for v in r], "k int, r double"), "r", "k")).first()
    n, z = len(r), (r - r.mean()) / r.std()
    skew = (z**3).mean() * math.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((z**4).mean() - 3) + 6) + 3
    sr = r.mean() / r.std()
    assert row["sharpe"] == pytest.approx(sr) and row["skew"] == pytest.approx(skew) and row["kurt"] == pytest.approx(kurt)
    assert row["psr"] == pytest.approx(NormalDist().cdf(sr * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)))


def test_undefined_is_null(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 2.0), (2, float("nan")), (2, 1.0)], "k int, r double")
    assert all(r["sharpe"] is None for r in stats.sharpe_moments(df, "r", "k").collect())


def test_lengths():
    assert stats.minimum_backtest_length(10) == pytest.approx(2.48, abs=0.05)
    assert stats.minimum_backtest_length(1) == 0.0
    assert stats.min_track_record_length(0.1, 0.2, 0.05, 0, 3) == math.inf
    assert stats.min_track_record_length(0.2, 0.1, 0.5, 0, 3) == 2.0
    with pytest.raises(ValueError):
        stats.min_track_record_length(0.2, 0.1, 1.5, 0, 3)
    with pytest.raises((ValueError, TypeError)):
        stats.check_dsr(True, 1.0)


def test_effective_trials(spark):
    rng = np.random.default_rng(0)
    series = {"noise": rng.standard_normal(300), "walk": rng.standard_normal(300).cumsum(), "flat": np.ones(50), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, t int, v double")
    got = {r["k"]: r["effective"] for r in stats.effective_trials(df, "v", "t", "k", lags=4).collect()}
    for k, x in series.items():
        rec = TrialSharpeRecorder()
        rec._found = x.tolist()
        assert got[k] == rec.n_effective()


def test_recorder(spark):
    class Trial:
        def __init__(self, value, **attrs):
            self.value, self.user_attrs = value, attrs

    rec = TrialSharpeRecorder()
    for t in (Trial(0, sharpe=1.2), Trial(0, sharpe=0.8), Trial(0, sharpe="1.5"), Trial(9, sharpe=None), Trial(None), Trial(0, sharpe="x"), Trial(0, sharpe=float("inf"))):
        rec(None, t)
    assert rec.n_trials() == 3 and rec.var_sharpe() == pytest.approx(0.12333333) and math.isnan(TrialSharpeRecorder().var_sharpe())
    rows = [(0, {"sharpe": "1.2"}), (0, {"sharpe": "0.8"}), (0, {"sharpe": "1.5"}), (9, {"sharpe": None}), (0, {"sharpe": "x"})]
    got = trial_variance(spark.createDataFrame([(float(v), a) for v, a in rows], "value double, user_attrs map<string,string>")).first()
    assert got["n_trials"] == 3 and got["var_sharpe"] == pytest.approx(0.12333333)
