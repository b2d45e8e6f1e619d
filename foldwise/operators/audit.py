"""Audits of splits: overlap, embargo and group checks, and the report with one row a fold."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from foldwise.errors import EmbargoViolationError, GroupLeakageError, TemporalLeakageError
from foldwise.functions.horizon import embargo_mode, parse_horizon
from foldwise.operators.folds import TemporalSplitter
from foldwise.operators.intervals import apply_embargo, purge_masks
from foldwise.operators.scan import ONE_TASK_BYTES, estimated_bytes, ordered_scan
from foldwise.runtime import materialise


def overlap_fraction(train: DataFrame, test: DataFrame, purge_horizon=None) -> DataFrame:
    """One row: the share of training rows whose label overlaps a test label; 0 if a side is empty."""
    h = parse_horizon(purge_horizon) if purge_horizon is not None else None
    hit = purge_masks(train, test.withColumn("block", F.lit(0)), 1, h)
    return hit.agg(F.coalesce(F.avg(F.when(F.col("mask") != 0, 1.0).otherwise(0.0)), F.lit(0.0)).alias("overlap"))


def assert_no_temporal_leakage(train: DataFrame, test: DataFrame, purge_horizon=None, order: str = "pos") -> None:
    h = parse_horizon(purge_horizon) if purge_horizon is not None else None
    bad = purge_masks(train, test.withColumn("block", F.lit(0)), 1, h).where("mask <> 0").orderBy(order).limit(1).collect()
    if bad:
        raise TemporalLeakageError(f"training row {bad[0]['pos']} with label {bad[0]['p']} to {bad[0]['e']} overlaps a test label")


def assert_embargo_respected(train: DataFrame, test: DataFrame, n_samples: int, order: str = "pos", **mode) -> None:
    if embargo_mode(**mode) is None:
        raise ValueError("give one kind of embargo")
    kept = apply_embargo(train, test, n_samples, **mode)
    bad = train.join(kept.select("pos"), "pos", "left_anti").orderBy(order).limit(1).collect()
    if bad:
        raise EmbargoViolationError(f"training row {bad[0]['pos']} at {bad[0]['p']} is in the embargo after a test row")


def shared_groups(train: DataFrame, test: DataFrame) -> DataFrame:
    """(g): groups on both sides."""
    return train.select("g").intersect(test.select("g"))


def assert_groups_disjoint(train: DataFrame, test: DataFrame) -> None:
    if train.where("g IS NULL").limit(1).count() or test.where("g IS NULL").limit(1).count():
        raise ValueError("group labels are missing")
    r = shared_groups(train, test).agg(F.min(F.col("g").cast("string")).alias("g"), F.count("*").alias("n")).first()
    if r["n"]:
        raise GroupLeakageError(f"{r['n']} groups are on both sides, the first is {r['g']}")


def block_count(rows: DataFrame, *by: str, parallel: bool | None = None) -> DataFrame:
    """by..., blocks: the number of runs of consecutive positions."""
    before = ordered_scan(rows.select(*by, "pos"), ["pos"], {"_before": ("last", F.col("pos"), "before")}, parallel, by)
    new = before.select(*by, F.when(F.col("_before") == F.col("pos") - 1, 0).otherwise(1).alias("_new"))
    return new.groupBy(*by).agg(F.sum("_new").cast("bigint").alias("blocks"))


def fold_overlaps(stages: DataFrame, purge_horizon: timedelta | None = None, parallel: bool | None = None) -> DataFrame:
    """fold, candidates and finals whose label overlaps a padded test label of their fold, whatever the splitter said of
    them: from times and roles alone, in one sweep inside each fold."""
    pad = F.lit(purge_horizon or timedelta(0))
    kinds = stages.schema
    none = F.lit(None).cast(kinds["e"].dataType)
    probes = stages.where("is_candidate OR is_final").select("fold", "p", "e", "is_candidate", "is_final", F.col("e").alias("_k"), F.lit(0).alias("_o"), none.alias("_r"))
    marks = stages.where(F.col("is_test") & (F.col("p") - pad < F.col("e") + pad))
    empty = [F.lit(None).cast(kinds[c].dataType).alias(c) for c in ("p", "e", "is_candidate", "is_final")]
    marks = marks.select("fold", *empty, (F.col("p") - pad).alias("_k"), F.lit(1).alias("_o"), (F.col("e") + pad).alias("_r"))
    # On equal keys probes come first, as touching is no overlap.
    swept = ordered_scan(probes.unionByName(marks), ["_k", "_o"], {"_reach": ("max", F.col("_r"))}, parallel, ["fold"])
    hit = (F.col("p") < F.col("e")) & (F.col("_reach") > F.col("p"))
    n = lambda c: F.sum((F.col(c) & F.coalesce(hit, F.lit(False))).cast("bigint"))
    return swept.where("_o = 0").groupBy("fold").agg(n("is_candidate").alias("_candidate_hits"), n("is_final").alias("_leaks"))


def audit_splitter(cv: TemporalSplitter, samples: DataFrame, parallel: bool | None = None) -> DataFrame:
    """The 19-column report. Leaks are reported, not raised; overlaps are computed anew from the times."""
    if not isinstance(cv, TemporalSplitter):
        raise TypeError("an audit takes a splitter of this library")
    if type(cv).split is not TemporalSplitter.split:
        raise TypeError("a splitter with its own split has no stages to audit")
    s = cv.stages(samples)
    if parallel or parallel is None and estimated_bytes(s) > ONE_TASK_BYTES:
        s = materialise(s, "stages")
    overlaps = fold_overlaps(s, cv.horizon, parallel)
    # A run starts where the row before, by position inside a fold, is not of the same role.
    s = ordered_scan(s, ["pos"], {"_last": ("last", F.struct("pos", "is_final", "is_test"), "before")}, parallel, ["fold"])
    run = lambda c: F.col(c) & ~F.coalesce(F.col(f"_last.{c}") & (F.col("_last.pos") == F.col("pos") - 1), F.lit(False))
    s = s.withColumns({"_train_run": run("is_final"), "_test_run": run("is_test")})
    n = lambda c: F.sum(F.col(c).cast("bigint")) if isinstance(c, str) else F.sum(c.cast("bigint"))
    out = s.groupBy("fold").agg(
        n("is_candidate").alias("candidate_train_size"), n("is_final").alias("final_train_size"), n("is_test").alias("test_size"),
        n("is_purged").alias("rows_removed_by_purge"), n("is_embargoed").alias("rows_removed_by_embargo"),
        n(F.col("is_candidate") & ~F.col("is_purged") & ~F.col("is_embargoed") & ~F.col("is_final")).alias("rows_removed_by_finalization"),
        n(F.col("is_final") & ~(F.col("is_candidate") & ~F.col("is_purged") & ~F.col("is_embargoed"))).alias("rows_added_by_finalization"),
        n("_train_run").alias("train_block_count"), n("_test_run").alias("test_block_count"),
        F.min(F.when(F.col("is_final"), F.col("p"))).alias("train_time_envelope_start"), F.max(F.when(F.col("is_final"), F.col("e"))).alias("train_time_envelope_end"),
        F.min(F.when(F.col("is_test"), F.col("p"))).alias("test_time_envelope_start"), F.max(F.when(F.col("is_test"), F.col("e"))).alias("test_time_envelope_end"),
    )
    out = out.join(overlaps, "fold", "left").fillna(0, ["_candidate_hits", "_leaks"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = out.withColumns(
        {
            "train_nonempty": F.col("final_train_size") > 0, "candidate_overlap_fraction": share("_candidate_hits", "candidate_train_size"),
            "final_overlap_fraction": share("_leaks", "final_train_size"), "temporal_leakage_free": F.col("_leaks") == 0,
        }
    )
    if cv.uses_groups:
        both = s.groupBy("fold", "g").agg((F.max("is_final") & F.max("is_test")).alias("x")).groupBy("fold").agg((~F.max("x")).alias("groups_disjoint"))
        out = out.join(both, "fold", "left")
    else:
        out = out.withColumn("groups_disjoint", F.lit(None).cast("boolean"))
    return out.select(
        "fold", "candidate_train_size", "final_train_size", "test_size", "train_nonempty", "rows_removed_by_purge", "rows_removed_by_embargo", "rows_removed_by_finalization",
        "rows_added_by_finalization", "candidate_overlap_fraction", "final_overlap_fraction", "temporal_leakage_free", "train_block_count", "test_block_count",
        "train_time_envelope_start", "train_time_envelope_end", "test_time_envelope_start", "test_time_envelope_end", "groups_disjoint",
    )
