"""Interval queries over all of lineitem against brute force."""

import random
from datetime import datetime, timedelta

import pytest

from foldwise.plans import catalogue

T0 = datetime(1995, 1, 1)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """(folder, rows): lines of every order key, none of which the modulo filters would leave alone."""
    rnd = random.Random(3)
    rows = [(k, n, float(rnd.choice((0, 1, 1, 2, 5))), T0 + timedelta(rnd.randrange(900))) for k in range(3, 83) for n in range(1, rnd.randint(2, 5))]
    folder = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    return folder, rows


def collected(spark, lines, name):
    return sorted(map(tuple, catalogue.queries()[name](spark, lines[0]).collect()))


@pytest.mark.parametrize("closed", [False, True])
def test_merged(spark, lines, closed):
    own = sorted({(p, p + timedelta(q)) for _, _, q, p in lines[1] if closed or q})
    due = []
    for a, z in own:
        if due and a <= due[-1][1]:
            due[-1][1] = max(due[-1][1], z)
        else:
            due.append([a, z])
    assert len(due) > 50
    assert collected(spark, lines, f"merge_intervals_{'closed' if closed else 'half_open'}_whole") == [tuple(x) for x in due]


def test_joined(spark, lines):
    own = [(k, n, p, p + timedelta(q)) for k, n, q, p in lines[1]]
    hit = lambda test: sorted((k, n, any(test(p, e, a, z) for _, _, a, z in own)) for k, n, p, e in own)
    assert collected(spark, lines, "interval_semi_join_whole") == hit(lambda p, e, a, z: a < z and p < e and a < e and z > p)
    assert collected(spark, lines, "point_in_interval_whole") == hit(lambda p, e, a, z: a <= p <= z)


def test_staggered(spark, lines):
    due = sorted((k, n, datetime(2020, 1, 1) + timedelta(minutes=k - 3, seconds=n)) for k, n, _, _ in lines[1])
    assert collected(spark, lines, "staggered_times_whole") == due
