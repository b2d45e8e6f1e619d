"""The ways for large inputs and many folds against the small ones or brute force; warnings and checks."""

import io
import random
import tarfile
import warnings
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from foldwise import runtime
from foldwise.functions import horizon, stats
from foldwise.operators import audit, features, folds, intervals, paths, pbo
from foldwise.operators.scan import ordered_scan
from foldwise.operators.search import TrialSharpeRecorder
from foldwise.sources import readers

T0 = datetime(2024, 1, 1)
SCHEMA = "pos bigint, p timestamp_ntz, e timestamp_ntz, g bigint"


def samples(spark, n, seed=1, longest=4):
    rnd, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rnd.choice([0, 1, 1, 2])
        rows.append((i, T0 + timedelta(at), T0 + timedelta(at + rnd.randint(0, longest)), i % 90))
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_ordered_scans_agree(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, "a", "b", "c"]), rnd.choice([None, rnd.randint(-9, 9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "i bigint, k string, v int")
    outputs = {f"{how}{at}": (how, F.col("v"), *([at] if at else [])) for how in ("sum", "max", "min", "count", "last") for at in ("", "before")}
    for by in ((), ("k",)):
        for order in (["i"], [F.desc("i")]):
            same(ordered_scan(df, order, outputs, False, by), ordered_scan(df, order, outputs, True, by))


def test_large_ways_agree(spark):
    s = samples(spark, 200)
    same(intervals.merge_intervals(s, "p", "e", False, False), intervals.merge_intervals(s, "p", "e", False, True))
    some = s.where("pos % 7 < 3")
    same(intervals.run_ends(some, False), intervals.run_ends(some, True))
    assert sorted(r["end"] for r in intervals.run_ends(some).collect()) == [i for i in range(200) if i % 7 < 3 and not (i + 1 < 200 and (i + 1) % 7 < 3)]
    holed = s.withColumn("p", F.when(F.col("pos") % 11 != 3, F.col("p") - F.make_dt_interval(F.col("pos").cast("int") % 5)))
    same(horizon.time_faults(holed, "pos", "p", "e", False), horizon.time_faults(holed, "pos", "p", "e", True))
    same(audit.block_count(some, "g", parallel=False), audit.block_count(some, "g", parallel=True))
    path = s.select((F.col("pos") % 3).alias("path"), "pos", ((F.col("pos") * 7 % 13 - 6) / 64).alias("prediction"))
    same(paths.path_metrics(path, parallel=False), paths.path_metrics(path, parallel=True))
    cv = folds.WalkForwardSplit(3, 20, train_size=30, window="sliding", purge_horizon="1D", embargo="1D")
    same(audit.audit_splitter(cv, s, False), audit.audit_splitter(cv, s, True))


def test_sliding_windows_and_group_embargo_by_ranges(spark, monkeypatch):
    from foldwise.operators import scan

    s = samples(spark, 120)
    ways = [folds.WalkForwardSplit(3, 15, train_size=20, window="sliding", embargo_observations=2), folds.PurgedGroupKFold(4, embargo_observations=3)]
    small = [sorted(map(str, cv.stages(s).collect())) for cv in ways]
    monkeypatch.setattr(scan, "ONE_TASK_BYTES", 0)
    assert [sorted(map(str, cv.stages(s).collect())) for cv in ways] == small


def brute_stages(rows, blocks, fold_blocks, pad, after, positions):
    out = {}
    for fold, tested in enumerate(fold_blocks):
        tests = [r for r in rows if blocks[r[0]] in tested]
        for i, p, e in rows:
            if blocks[i] in tested:
                continue
            purged = p < e and any(a - pad < b + pad and a - pad < e and b + pad > p for _, a, b in tests)
            near = any(b <= p <= b + after for _, _, b in tests) if after else False
            if positions:
                near = any(j < i <= j + positions and blocks[i] != blocks[j] for j, _, _ in tests)
            out[fold, i] = (purged, near and not purged)
    return out


@pytest.mark.parametrize("kind", ["time", "positions", "groups", "combinations"])
def test_more_folds_than_a_number_has_bits(spark, kind):
    s = samples(spark, 150)
    rows = [(r["pos"], r["p"], r["e"]) for r in s.collect()]
    settings = {"purge_horizon": "1D"} | ({"embargo_observations": 2} if kind == "positions" else {"embargo": "2D"})
    if kind == "groups":
        cv = folds.PurgedGroupKFold(70, **settings)
        blocks = {r["pos"]: r["block"] for r in s.join(folds.group_blocks(s, 70), "g").collect()}
    else:
        cv = folds.PurgedKFold(70, **settings) if kind != "combinations" else folds.CombinatorialPurgedCV(64, 63, **settings)
        sizes = folds.block_sizes(150, cv.n_blocks)
        blocks = {}
        for b, n in enumerate(sizes):
            blocks |= {len(blocks) + k: b for k in range(n)}
    fold_blocks = [{b for b in range(cv.n_blocks) if m >> b & 1} for m in cv.folds()]
    due = brute_stages(rows, blocks, fold_blocks, timedelta(1), None if kind == "positions" else timedelta(2), 2 if kind == "positions" else 0)
    got = cv.stages(s).collect()
    assert {(r["fold"], r["pos"]) for r in got if r["is_test"]} == {(f, i) for f, t in enumerate(fold_blocks) for i in blocks if blocks[i] in t}
    assert {(r["fold"], r["pos"]): (r["is_purged"], r["is_embargoed"]) for r in got if not r["is_test"]} == due


def test_the_audit_does_not_trust_the_splitter(spark):
    class Blind(folds.PurgedKFold):
        def masks(self, x):
            rows, n = super().masks(x)
            return rows.withColumn("purge_mask", F.lit(0).cast("bigint")), n

    s = samples(spark, 60, longest=6)
    honest = {r["fold"]: r for r in audit.audit_splitter(folds.PurgedKFold(4, purge_horizon="1D"), s).collect()}
    blind = {r["fold"]: r for r in audit.audit_splitter(Blind(4, purge_horizon="1D"), s).collect()}
    for f, r in honest.items():
        assert r["temporal_leakage_free"] and r["candidate_overlap_fraction"] == pytest.approx(r["rows_removed_by_purge"] / r["candidate_train_size"])
        assert not blind[f]["temporal_leakage_free"] and blind[f]["final_overlap_fraction"] == pytest.approx(r["candidate_overlap_fraction"]) and blind[f]["rows_removed_by_purge"] == 0


def test_settings_are_checked(spark):
    cv = folds.PurgedKFold(4, purge_horizon="1D", embargo="2D")
    other = cv.with_settings(purge_horizon="5D", embargo_observations=3)
    assert other.horizon == timedelta(5) and other.mode == ("count", 3) and other.n_blocks == 4 and cv.mode[0] == "time"
    assert folds.WalkForwardSplit(3, 4).with_settings(test_size=5).test_size == 5
    with pytest.raises(TypeError):
        cv.with_settings(horizont="5D")
    with pytest.raises(ValueError):
        cv.with_settings(n_splits=1)
    s = samples(spark, 20)
    for bad in (s.where("pos <> 4"), s.withColumn("pos", F.col("pos") + 1), s.unionByName(s.where("pos = 3"))):
        with pytest.raises(ValueError):
            cv.stages(bad)
    with pytest.raises(TypeError):
        cv.stages(s.withColumn("pos", F.col("pos").cast("double")))


def test_instants_and_times_without_a_zone(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 2, 3, 4, 5, 678901))], "id int, e timestamp_ntz").withColumn("p", F.timestamp_micros(F.lit(1704164645678901)))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = folds.TemporalSplitter.samples(df, "p", "e", ["id"]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r["p"] == r["e"] == datetime(2024, 1, 2, 3, 4, 5, 678901)


def test_overfitting_tells_what_it_dropped(spark):
    import numpy as np

    r = np.random.default_rng(5).standard_normal((3, 40)) * 0.01
    frame = spark.createDataFrame([(c, i, float(r[c, i])) for c in range(3) for i in range(40)], "config int, pos bigint, r double")
    at = [T0 + timedelta(i) for i in range(40)]
    times = spark.createDataFrame([(i, at[i], at[i] + timedelta(1)) for i in range(40)], "pos bigint, p timestamp_ntz, e timestamp_ntz")
    with pytest.warns(UserWarning, match="combinations"):
        few = pbo.probability_of_backtest_overfitting(frame, 4, times, purge_horizon="11D")
    assert 0 < few.n_combos < 6
    sharpe = lambda x: x.mean() / x.std(ddof=1) if len(x) > 1 else 0.0
    key = lambda x: (x["combo"], x["config"])
    a, b = (sorted(df.collect(), key=key) for df in (pbo.scores(frame, 4, times, purge_horizon="2D", embargo="1D"), pbo.scores_with(frame, sharpe, 4, times, purge_horizon="2D", embargo="1D")))
    assert [(key(x), x["n_is"]) for x in a] == [(key(x), x["n_is"]) for x in b]
    assert [x["is_perf"] for x in a] == pytest.approx([x["is_perf"] for x in b]) and [x["oos_perf"] for x in a] == pytest.approx([x["oos_perf"] for x in b])
    with pytest.raises(ValueError):
        pbo.scores_with(frame, sharpe, 4, purge_horizon="2D")


def test_empty_folds_warn(spark):
    s = samples(spark, 12, longest=0).withColumn("e", F.lit(T0 + timedelta(999)).cast("timestamp_ntz")).withColumn("y", F.lit(1.0))
    cv = folds.CombinatorialPurgedCV(3, 2)
    for run in (lambda: paths.backtest_paths(s, cv, {"m": F.avg("y")}, F.col("m")), lambda: paths.backtest_paths_with(s, cv, lambda a, b: [0.0] * len(b), ["y"])):
        with pytest.warns(UserWarning, match="no rows to train on"):
            run()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        paths.backtest_paths(samples(spark, 12, longest=0).withColumn("y", F.lit(1.0)), cv, {"m": F.avg("y")}, F.col("m"))


def test_cluster_bootstrap_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("abcdefg"), float(rnd.randint(0, 50))) for _ in range(60)]
    df = spark.createDataFrame(rows, "k string, v double")
    names = sorted({k for k, _ in rows})
    drawn = [r[0] for r in spark.range(5 * len(names)).select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(len(names)))).collect()]
    due = []
    for b in range(5):
        own = [v for i in drawn[b * len(names) : (b + 1) * len(names)] for k, v in rows if k == names[i]]
        due.append(sum(own) / len(own))
    got = sorted((r["b"], r["mean"]) for r in features.cluster_bootstrap(df, "k", "v", 5, 3).collect())
    assert [m for _, m in got] == pytest.approx(due)


def test_trials_without_keys(spark):
    rows = [(i, float((i * 37) % 11)) for i in range(80)]
    df = spark.createDataFrame(rows, "t int, v double")
    one = stats.effective_trials(df, "v", "t").first()
    assert one["effective"] == stats.effective_trials(df.withColumn("k", F.lit(1)), "v", "t", "k").first()["effective"]
    rec = TrialSharpeRecorder()
    for _, v in rows:
        rec(None, SimpleNamespace(value=v, user_attrs={}))
    assert rec.n_effective(method="autocorr") == one["effective"] and TrialSharpeRecorder().n_effective() == 0
    with pytest.raises(ValueError):
        rec.n_effective(method="other")


def test_csv_and_archives(spark, tmp_path):
    rows = [(1, "a,b \"c\"", 0.5, datetime(2024, 1, 1, 2, 3, 4, 500)), (2, "", None, None), (3, None, 1.0, T0)]
    df = spark.createDataFrame(rows, "i int, s string, x double, t timestamp_ntz")
    readers.write_csv(df, str(tmp_path / "out"))
    back = sorted(map(tuple, readers.csv(spark, str(tmp_path / "out"), "i int, s string, x double, t timestamp_ntz").collect()))
    assert [r[0] for r in back] == [1, 2, 3] and back[0] == rows[0] and back[2][2:] == rows[2][2:] and back[1][2:] == (None, None)
    for name, mode in (("a.tar", "w"), ("b.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as archive:
            for k in (1, 2):
                body = f"Time,Parameter,Value\n00:0{k},HR,{70 + k}\nbad\n01:00,Temp,x\n".encode()
                info = tarfile.TarInfo(f"set/{name[0]}{k}.txt")
                info.size = len(body)
                archive.addfile(info, io.BytesIO(body))
    got = sorted(map(tuple, readers.archive_records(spark, f"{tmp_path}/*.tar*").collect()))
    assert got == [("a1.txt", 1, "HR", 71.0), ("a2.txt", 2, "HR", 72.0), ("b1.txt", 1, "HR", 71.0), ("b2.txt", 2, "HR", 72.0)]


def test_a_cluster_needs_a_shared_folder():
    unset = SimpleNamespace(get=lambda *a: None)
    for master, fine in (("spark://host:7077", False), ("local-cluster[2,1,1024]", False), ("yarn", False), ("local[4]", True), ("local", True)):
        sc = SimpleNamespace(master=master, getConf=lambda: unset, applicationId=f"test-{master}", setCheckpointDir=lambda d: None)
        session = SimpleNamespace(sparkContext=sc, conf=unset)
        if fine:
            assert runtime.shared_dir(session)
        else:
            with pytest.raises(RuntimeError):
                runtime.shared_dir(session)
