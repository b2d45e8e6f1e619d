import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foldwise.errors import EmbargoViolationError, GroupLeakageError, TemporalLeakageError
from foldwise.operators import audit, folds, intervals, paths, pbo
from foldwise.operators.scan import with_positions

T0 = datetime(2024, 1, 1)
SCHEMA = "pos bigint, p timestamp_ntz, e timestamp_ntz, g bigint"


def daily(spark, n, days=1, group=lambda i: i):
    rows = [(i, T0 + timedelta(i), T0 + timedelta(i + days), group(i)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def kept(df):
    return sorted(r["pos"] for r in df.select("pos").collect())


def part(df, where):
    return df.where(F.col("pos").isin(list(where)))


def test_purge_published_snippet(spark):
    s = daily(spark, 10, 3)
    train, test = part(s, [0, 1, 2, 3, 4, 8, 9]), part(s, [5, 6, 7])
    assert kept(intervals.purge(train, test)) == [0, 1, 2]
    assert kept(intervals.purge(train, test, timedelta(1))) == [0, 1]


def test_embargo_cases(spark):
    s = daily(spark, 16)
    assert kept(intervals.apply_embargo(part(s, [*range(6), *range(10, 16)]), part(s, range(6, 10)), 16, embargo="3D")) == [0, 1, 2, 3, 4, 5, 14, 15]
    s = daily(spark, 12)
    assert kept(intervals.apply_embargo(part(s, range(3, 9)), part(s, [0, 1, 2, 9, 10, 11]), 12, embargo="1D")) == [5, 6, 7, 8]
    s = daily(spark, 20)
    train, test = part(s, [*range(5), *range(10, 20)]), part(s, range(5, 10))
    want = [*range(5), *range(13, 20)]
    assert kept(intervals.apply_embargo(train, test, 20, embargo_observations=3)) == want
    assert kept(intervals.apply_embargo(train, test, 20, embargo_fraction=0.19)) == want
    assert kept(intervals.apply_embargo(train, test, 20, embargo="0D")) == kept(train)
    s = daily(spark, 15)
    assert kept(intervals.apply_embargo(part(s, [*range(3, 9), 12, 13, 14]), part(s, [0, 1, 2, 9, 10, 11]), 15, embargo_observations=2)) == [5, 6, 7, 8, 14]


def split_of(cv, s, fold):
    rows = cv.split(s).where(F.col("fold") == fold).collect()
    return sorted(r["pos"] for r in rows if r["role"] == "train"), sorted(r["pos"] for r in rows if r["role"] == "test")


def test_walk_forward(spark):
    cv = folds.WalkForwardSplit(3, 4, purge_horizon="2D")
    s = daily(spark, 24, 2)
    assert [max(split_of(cv, s, f)[0]) for f in range(3)] == [8, 12, 16]
    report = audit.audit_splitter(folds.WalkForwardSplit(3, 2, train_size=5, window="sliding", purge_horizon="1D"), daily(spark, 20)).orderBy("fold").collect()
    assert [r["rows_removed_by_purge"] for r in report] == [1, 1, 1]
    assert [r["rows_removed_by_finalization"] for r in report] == [8, 10, 12]
    assert [r["final_train_size"] for r in report] == [5, 5, 5]


def test_kfold_audit(spark):
    s = daily(spark, 20)
    r = audit.audit_splitter(folds.PurgedKFold(4, purge_horizon="1D", embargo_observations=2), s).where("fold = 0").first()
    assert (r["candidate_train_size"], r["rows_removed_by_purge"], r["rows_removed_by_embargo"], r["final_train_size"]) == (15, 1, 1, 13)
    assert r["candidate_overlap_fraction"] == pytest.approx(1 / 15) and r["temporal_leakage_free"] and r["groups_disjoint"] is None
    train, _ = split_of(folds.PurgedKFold(4, embargo_fraction=0.1), s, 1)
    assert 10 not in train and 11 not in train and 12 in train


def test_groups(spark):
    s = daily(spark, 24, group=lambda i: i % 6)
    train, test = split_of(folds.PurgedGroupKFold(3, embargo_observations=2), s, 0)
    assert test == [0, 1, 6, 7, 12, 13, 18, 19] and train == [4, 5, 10, 11, 16, 17, 22, 23]
    blocks = folds.group_blocks(daily(spark, 12, group=lambda i: 9 - i // 3), 2).orderBy("g").collect()
    assert [(r["g"], r["block"]) for r in blocks] == [(6, 1), (7, 1), (8, 0), (9, 0)]
    with pytest.raises(ValueError):
        folds.group_blocks(s, 7)
    with pytest.raises(GroupLeakageError):
        audit.assert_groups_disjoint(part(s, range(6)), part(s, range(6, 12)))


def test_cpcv_and_paths(spark):
    s = daily(spark, 16)
    cv = folds.CombinatorialPurgedCV(4, 2, embargo_observations=1)
    train, test = split_of(cv, s, cv.folds().index(0b0101))
    assert test == [0, 1, 2, 3, 8, 9, 10, 11] and 4 not in train and 12 not in train and 5 in train and 13 in train
    predictions = cv.stages(s).where("is_test").select("fold", "pos", F.col("fold").cast("double").alias("prediction"))
    got = {(r["path"], r["pos"]): r["prediction"] for r in paths.reconstruct_paths(predictions, cv, 16, validate=True).collect()}
    for path, want in enumerate([[0, 0, 1, 2], [1, 3, 3, 4], [2, 4, 5, 5]]):
        assert [got[path, 4 * b] for b in range(4)] == want
    with pytest.raises(ValueError):
        paths.reconstruct_paths(predictions.where("fold > 0"), cv, 16, validate=True)
    assert cv.get_n_splits() == 6 and cv.n_paths() == 3


def brute(rows, tests, pad, after):
    purged = {i for i, p, e in rows if p < e and any(a - pad < b + pad and a - pad < e and b + pad > p for _, a, b in tests)}
    embargoed = {i for i, p, e in rows if after is not None and after > 0 and any(b <= p <= b + after for _, _, b in tests)}
    return purged, embargoed


@pytest.mark.parametrize("seed", range(4))
def test_masks_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    at, rows = 0, []
    for i in range(60):
        at += rnd.choice([0, 0, 1, 2])
        rows.append((i, at, at + rnd.choice([0, 1, 3, 7])))
    s = spark.createDataFrame([(i, T0 + timedelta(p), T0 + timedelta(e), i) for i, p, e in rows], SCHEMA)
    pad, after = rnd.choice([0, 2]), rnd.choice([1, 4])
    cv = folds.CombinatorialPurgedCV(5, 2, purge_horizon=timedelta(pad), embargo=timedelta(after))
    stages = cv.stages(s).collect()
    cv.prune_from = 0
    pruned = cv.stages(s).collect()
    assert sorted(map(tuple, pruned)) == sorted(map(tuple, stages))
    by_group = folds.PurgedGroupKFold(3, purge_horizon=timedelta(pad), embargo=timedelta(after))
    whole = sorted(map(tuple, by_group.stages(s.withColumn("g", F.col("pos") % 7)).collect()))
    by_group.prune_from = 0
    assert sorted(map(tuple, by_group.stages(s.withColumn("g", F.col("pos") % 7)).collect())) == whole
    for fold, mask in enumerate(cv.folds()):
        own = [r for r in stages if r["fold"] == fold]
        tests = [rows[r["pos"]] for r in own if r["is_test"]]
        assert {t[0] // 12 for t in tests} == {b for b in range(5) if mask >> b & 1}
        purged, embargoed = brute(rows, tests, pad, after)
        for r in own:
            if not r["is_test"]:
                assert r["is_purged"] == (r["pos"] in purged)
                assert r["is_final"] == (r["pos"] not in purged and r["pos"] not in embargoed)


def test_checks_name_the_first_row(spark):
    s = daily(spark, 10, 3)
    with pytest.raises(TemporalLeakageError, match="row 3"):
        audit.assert_no_temporal_leakage(part(s, [0, 3, 4]), part(s, [5, 6]))
    with pytest.raises(EmbargoViolationError):
        audit.assert_embargo_respected(part(s, [0, 7]), part(s, [4]), 10, embargo="1D")
    with pytest.raises(ValueError):
        audit.assert_embargo_respected(part(s, [0]), part(s, [4]), 10)
    audit.assert_no_temporal_leakage(part(s, [0, 1]), part(s, [5, 6]))


def test_both_scans_agree(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("a"), "id")
    one, many = (sorted(map(tuple, with_positions(df, ["a", "id"], parallel=x).select("id", "pos").collect())) for x in (False, True))
    assert one == many


def test_empty_and_zero_length(spark):
    s = daily(spark, 10, 0)
    assert kept(intervals.purge(part(s, range(5)), part(s, [2]))) == [0, 1, 2, 3, 4]
    none = s.where("false")
    assert kept(intervals.purge(s, none)) == list(range(10)) and kept(intervals.purge(none, s)) == []
    assert audit.overlap_fraction(none, s).first()[0] == 0.0


def test_path_metrics(spark):
    rows = [(0, i, r) for i, r in enumerate([0.01, -0.02, 0.03, 0.0])] + [(1, i, r) for i, r in enumerate([-0.1, 0.05])] + [(2, 0, None), (2, 1, 0.5)]
    got = {r["path"]: r for r in paths.path_metrics(spark.createDataFrame(rows, "path int, pos bigint, prediction double")).collect()}
    assert got[0]["total_return"] == pytest.approx(0.02) and got[0]["max_drawdown"] == pytest.approx(0.02) and got[0]["calmar"] == pytest.approx(1)
    assert got[1]["max_drawdown"] == pytest.approx(0.1)
    assert got[2]["sharpe"] is None and got[2]["max_drawdown"] is None


def test_pbo(spark):
    import numpy as np

    r = np.random.default_rng(3).standard_normal((5, 160)) * 0.01
    r[0] += 0.05
    frame = spark.createDataFrame([(c, i, float(r[c, i])) for c in range(5) for i in range(160)], "config int, pos bigint, r double")
    got = pbo.probability_of_backtest_overfitting(frame, 8)
    assert got.pbo == 0.0 and got.n_combos == 70
    at = [T0 + timedelta(i) for i in range(160)]
    times = spark.createDataFrame([(i, at[i], at[i]) for i in range(160)], "pos bigint, p timestamp_ntz, e timestamp_ntz")
    same = pbo.probability_of_backtest_overfitting(frame, 8, times)
    assert same.n_combos == 70 and same.slope == pytest.approx(got.slope)
    sharpe = lambda x: x.mean() / x.std(ddof=1)
    custom = pbo.summary(pbo.logits(pbo.scores_with(frame, sharpe, 6))).first()
    own = pbo.summary(pbo.logits(pbo.scores(frame, 6))).first()
    assert custom["pbo"] == own["pbo"] and custom["slope"] == pytest.approx(own["slope"])
    with pytest.raises(ValueError):
        pbo.scores(frame, 7)
    with pytest.raises(ValueError):
        pbo.scores(frame.where("config = 0"), 6)


def test_custom_models_and_metrics(spark):
    s = daily(spark, 20).withColumn("y", F.col("pos").cast("double"))
    cv = folds.CombinatorialPurgedCV(4, 1)
    by_rows = paths.backtest_paths_with(s, cv, lambda train, test: [train.y.mean()] * len(test), ["y"])
    by_sums = paths.backtest_paths(s, cv, {"m": F.avg("y")}, F.col("m"))
    assert sorted(map(tuple, by_rows.collect())) == sorted(map(tuple, by_sums.collect()))
    top = paths.path_metrics_with(by_sums, lambda x: {"top": x.max()}, ["top"]).collect()
    assert [r["path"] for r in top] == [0]


def test_ml_estimator_equals_ols(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    s = daily(spark, 24).withColumn("x", (F.col("pos") % 7).cast("double")).withColumn("y", F.col("x") * 2 + F.col("pos") % 3)
    cv = folds.CombinatorialPurgedCV(4, 2, purge_horizon="1D")
    estimator = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v"), LinearRegression(featuresCol="v", labelCol="y")])
    fitted = {(r["path"], r["pos"]): r["prediction"] for r in paths.backtest_paths_ml(s, cv, estimator, ["x", "y"]).collect()}
    sums = paths.backtest_paths(s, cv, {"b": F.regr_slope("y", "x"), "a": F.regr_intercept("y", "x")}, F.col("a") + F.col("b") * F.col("x"))
    for r in sums.collect():
        assert fitted[r["path"], r["pos"]] == pytest.approx(r["prediction"], abs=1e-6)
