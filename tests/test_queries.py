"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from foldwise.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
SOME = "horizons_overlap merge_intervals_half_open interval_semi_join point_in_interval purge_padded embargo_duration purged_kfold split_stages cpcv_purged walk_forward_sliding purged_group_kfold audit_purged_kfold reconstruct_paths backtest_paths_ols max_drawdown dsr_full effective_n_trials positions rolling_features forward_mean_label interpolate causal_target_mean auc selection_regret".split()
SMALL_ROWS = {"walk_forward_sliding"}


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False)))


@pytest.mark.parametrize("name", [n for n in SOME if n not in SMALL_ROWS])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(con.sql(catalogue.oracle_sql()[name]).df())


def test_contract():
    import __spark_entry__

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(__spark_entry__.queries())
