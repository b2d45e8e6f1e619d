from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, strategies as st

from foldwise.functions.horizon import check_positions, embargo_mode, horizons_overlap, parse_horizon, validate_times


@pytest.mark.parametrize(
    "text,seconds", [("5D", 432000), ("1h30min", 5400), ("2 days 03:00:00", 183600), ("1m", 60), ("1W", 604800), ("250ms", 0.25), ("0", 0), ("10us", 1e-5), ("1.5h", 5400), ("00:30:00", 1800)]
)
def test_text(text, seconds):
    assert parse_horizon(text) == timedelta(seconds=seconds)


@pytest.mark.parametrize("value", ["1M", "M", "Q", "2Y", "ME", "-1D", "", "abc", "5", "1 parsec", np.timedelta64("NaT"), pd.NaT, timedelta(-1)])
def test_rejected(value):
    with pytest.raises((ValueError, TypeError)):
        parse_horizon(value)


@pytest.mark.parametrize("value", [5, 2.5, True, None, [1]])
def test_wrong_types(value):
    with pytest.raises(TypeError):
        parse_horizon(value)


def test_durations():
    assert parse_horizon(np.timedelta64(3, "h")) == parse_horizon(pd.Timedelta("3h")) == timedelta(hours=3)


points = st.integers(0, 50)


@given(points, points, points, points)
def test_overlap_is_symmetric_and_strict(a, b, c, d):
    a, b, c, d = min(a, b), max(a, b), min(c, d), max(c, d)
    assert horizons_overlap(a, b, c, d) == horizons_overlap(c, d, a, b)
    assert not horizons_overlap(a, b, b, max(b, d))
    if a < b:
        assert horizons_overlap(a, b, a, b)


def test_embargo_modes():
    assert embargo_mode() is None
    assert embargo_mode("1D") == ("time", timedelta(1))
    assert embargo_mode(None, 3) == ("count", 3)
    for bad in (("1D", 3, None), (None, True, None), (None, -1, None), (None, None, 1.5), (None, None, float("nan")), (None, None, True)):
        with pytest.raises((ValueError, TypeError)):
            embargo_mode(*bad)


def test_times_and_positions(spark):
    rows = spark.sql("SELECT * FROM VALUES (0L, TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-02'), (1L, TIMESTAMP_NTZ '2024-01-03', TIMESTAMP_NTZ '2024-01-03') AS t(pos, p, e)")
    validate_times(rows, "p", "e")
    check_positions(rows, 2)
    with pytest.raises(ValueError):
        validate_times(rows, "pos", "e")
    with pytest.raises(ValueError, match="row 0"):
        validate_times(rows.selectExpr("pos", "e AS p", "p AS e"), "p", "e")
    with pytest.raises(ValueError):
        check_positions(rows.union(rows), 2)
    with pytest.raises(ValueError):
        check_positions(rows, 1)
