"""Interval operators: merging, semi joins by sweep, purge and embargo.

A pure range condition would plan as a nested loop. A sweep sorts probes and intervals together once and carries the
largest end seen so far: a probe is hit if that end lies beyond its start. Equal to testing each pair, in n log n.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.functions.horizon import embargo_mode, parse_horizon
from foldwise.operators.scan import ordered_scan


def merge_intervals(df: DataFrame, start: str, end: str, closed: bool = False, parallel: bool | None = None) -> DataFrame:
    """(start, end) of the union of the intervals. Touching ones merge. Half-open: empty ones are left out; closed: kept."""
    own = df.select(F.col(start).alias("start"), F.col(end).alias("end")).where(F.col("start") <= F.col("end") if closed else F.col("start") < F.col("end")).distinct()
    # The reach before a row decides whether a new island starts.
    swept = ordered_scan(own, ["start", "end"], {"_reach": ("max", F.col("end"), "before")}, parallel)
    marked = swept.withColumn("_new", F.coalesce((F.col("start") > F.col("_reach")).cast("int"), F.lit(1)))
    return ordered_scan(marked, ["start", "end"], {"_island": ("sum", F.col("_new"))}, parallel).groupBy("_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def sweep_masks(rows: DataFrame, tests: DataFrame, n_blocks: int, row_key: Column, test_key: Column, reach: Column, rows_first: bool, hit) -> DataFrame:
    """``rows`` with ``mask``: bit b is set if ``hit(largest reach of block b's tests up to the row's key)``.

    tests has a column ``block``. On equal keys rows come before tests if ``rows_first``."""
    probes = rows.select(*rows.columns, row_key.alias("_k"), F.lit(0 if rows_first else 1).alias("_o"), F.lit(None).cast("int").alias("_b"), F.lit(None).cast(_type(tests, reach)).alias("_r"))
    marks = tests.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema], test_key.alias("_k"), F.lit(1 if rows_first else 0).alias("_o"), F.col("block").cast("int").alias("_b"), reach.alias("_r"))
    both = ordered_scan(probes.unionByName(marks), ["_k", "_o"], {f"_m{b}": ("max", F.when(F.col("_b") == b, F.col("_r"))) for b in range(n_blocks)})
    mask = F.lit(0).cast("bigint")
    for b in range(n_blocks):
        mask = mask + F.when(F.coalesce(hit(F.col(f"_m{b}")), F.lit(False)), F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return both.where(F.col("_b").isNull()).select(*rows.columns, mask.alias("mask"))


def _type(df: DataFrame, c: Column):
    return df.select(c.alias("x")).schema["x"].dataType


def purge_masks(rows: DataFrame, tests: DataFrame, n_blocks: int, horizon: timedelta | None = None) -> DataFrame:
    """rows (p, e, ...) with the blocks of tests (block, p, e) whose labels, padded by ``horizon``, overlap the row's label.
    An empty label of a row is never hit; an empty test label counts only when padded."""
    pad = F.lit(horizon or timedelta(0))
    tests = tests.select("block", (F.col("p") - pad).alias("p"), (F.col("e") + pad).alias("e")).where("p < e")
    return sweep_masks(rows, tests, n_blocks, F.col("e"), F.col("p"), F.col("e"), True, lambda reach: (F.col("p") < F.col("e")) & (reach > F.col("p")))


def embargo_masks(rows: DataFrame, tests: DataFrame, n_blocks: int, embargo: timedelta) -> DataFrame:
    """rows (p, ...) with the blocks of tests (block, e) after whose label end the row starts, at most ``embargo`` later."""
    return sweep_masks(rows, tests, n_blocks, F.col("p"), F.col("e"), F.col("e"), False, lambda last: F.col("p") <= last + F.lit(embargo))


def _in_blocks(rows: DataFrame, tests: DataFrame, row_key: Column, test_key: Column, reach: Column, rows_first: bool, hit) -> DataFrame:
    """(pos, block) of those pairs (pos, block, p, e) for which ``hit(largest reach of the block's tests up to the row's key)``
    holds: one sweep inside each block, whatever the number of blocks."""
    kinds = rows.schema
    probes = rows.select("pos", "block", "p", "e", row_key.alias("_k"), F.lit(0 if rows_first else 1).alias("_o"), F.lit(None).cast(_type(tests, reach)).alias("_r"))
    empty = [F.lit(None).cast(kinds[c].dataType).alias(c) for c in ("p", "e")]
    marks = tests.select(F.lit(None).cast("bigint").alias("pos"), F.col("block").cast("int").alias("block"), *empty, test_key.alias("_k"), F.lit(1 if rows_first else 0).alias("_o"), reach.alias("_r"))
    swept = ordered_scan(probes.unionByName(marks), ["_k", "_o"], {"_reach": ("max", F.col("_r"))}, by=["block"])
    return swept.where(F.col("pos").isNotNull() & F.coalesce(hit(F.col("_reach")), F.lit(False))).select("pos", "block")


def purged_pairs(pairs: DataFrame, tests: DataFrame, horizon: timedelta | None = None) -> DataFrame:
    """As ``purge_masks``, for given pairs of rows and blocks."""
    pad = F.lit(horizon or timedelta(0))
    tests = tests.select("block", (F.col("p") - pad).alias("p"), (F.col("e") + pad).alias("e")).where("p < e")
    return _in_blocks(pairs, tests, F.col("e"), F.col("p"), F.col("e"), True, lambda reach: (F.col("p") < F.col("e")) & (reach > F.col("p")))


def embargoed_pairs(pairs: DataFrame, tests: DataFrame, embargo: timedelta) -> DataFrame:
    """As ``embargo_masks``, for given pairs of rows and blocks."""
    return _in_blocks(pairs, tests, F.col("p"), F.col("e"), F.col("e"), False, lambda last: F.col("p") <= last + F.lit(embargo))


def hit_blocks(rows: DataFrame, tests: DataFrame, a: Column, z: Column, low: Column, high: Column, in_blocks) -> DataFrame:
    """(pos, blocks): the blocks that hit each row that any hits. ``in_blocks`` keeps those pairs of rows and blocks that
    do, out of the pairs in which the row meets the hull of the block's tests; see ``prune`` for the other arguments."""
    hulls = tests.groupBy("block").agg(F.min(a).alias("a"), F.max(z).alias("z")).collect()  # one row a block
    if not hulls:
        return rows.where("false").select("pos", F.array().cast("array<int>").alias("blocks"))
    known = F.array(*[F.struct(F.lit(h["block"]).cast("int").alias("b"), F.lit(h["a"]).alias("a"), F.lit(h["z"]).alias("z")) for h in hulls])
    met = F.filter(known, lambda h: (low <= h["z"]) & (high >= h["a"]) & ~h["b"].eqNullSafe(F.col("block")))
    pairs = rows.select("pos", "p", "e", F.explode(F.transform(met, lambda h: h["b"])).alias("block"))
    return in_blocks(pairs, tests).groupBy("pos").agg(F.collect_set("block").alias("blocks"))


def prune(rows: DataFrame, tests: DataFrame, a: Column, z: Column, low: Column, high: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that may be hit, all other rows, tests that may hit). Both sides have pos and block; a test reaches from ``a``
    to ``z`` and a row from ``low`` to ``high``.

    Only rows in the hull of another block's tests can be hit, and only tests that meet such rows can hit. Where blocks
    are runs in time these are the rows at the borders, so two small aggregates take the place of a sort of everything.
    What is left out can't overlap, so results don't change; interleaved blocks just leave nothing out."""
    hulls = tests.groupBy("block").agg(F.min(a).alias("a"), F.max(z).alias("z"), F.min("pos").alias("first"), F.max("pos").alias("last")).collect()  # one row a block
    near = {h["block"]: (F.col("block").isNull() | (F.col("block") != h["block"])) & (low <= F.lit(h["z"])) & (high >= F.lit(h["a"])) for h in hulls}
    some = F.lit(False)
    for c in near.values():
        some = some | c
    some = F.coalesce(some, F.lit(True))
    sides = []
    for h in hulls:
        left, right = F.col("pos") < h["first"], F.col("pos") > h["last"]
        for k, side in (("l", left), ("r", right), ("m", ~left & ~right)):
            hit = near[h["block"]] & side
            sides += [F.min(F.when(hit, low)).alias(f"a{k}{h['block']}"), F.max(F.when(hit, high)).alias(f"z{k}{h['block']}")]
    met = F.lit(False)
    if sides:
        r = rows.where(some).agg(*sides).first()
        for h in hulls:
            for k in "lrm":
                if (x := r[f"a{k}{h['block']}"]) is not None:
                    met = met | ((F.col("block") == h["block"]) & (a <= F.lit(r[f"z{k}{h['block']}"])) & (z >= F.lit(x)))
    return rows.where(some), rows.where(~some), tests.where(met)


def overlaps_any(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """rows (p, e, ...) with ``hit``: whether the half-open label overlaps any of the intervals (p, e)."""
    return purge_masks(rows, intervals.withColumn("block", F.lit(0)), 1).withColumn("hit", F.col("mask") != 0).drop("mask")


def in_any_closed(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points (p, ...) with ``hit``: whether p is in any closed interval (p, e)."""
    tests = intervals.where("p <= e").withColumn("block", F.lit(0))
    return sweep_masks(points, tests, 1, F.col("p"), F.col("p"), F.col("e"), False, lambda reach: reach >= F.col("p")).withColumn("hit", F.col("mask") != 0).drop("mask")


def purge(train: DataFrame, test: DataFrame, purge_horizon: timedelta | None = None) -> DataFrame:
    """The rows of train (p, e, ...) whose labels overlap none of test's, padded by the horizon (a duration, no text)."""
    if purge_horizon is not None and not isinstance(purge_horizon, timedelta):
        raise TypeError("purge takes a timedelta")
    h = parse_horizon(purge_horizon) if purge_horizon is not None else None
    return purge_masks(train, test.withColumn("block", F.lit(0)), 1, h).where("mask = 0").drop("mask")


def run_ends(test: DataFrame, parallel: bool | None = None) -> DataFrame:
    """(end): the last position of each run of consecutive test positions."""
    backwards = ordered_scan(test.select("pos").distinct(), [F.desc("pos")], {"_next": ("last", F.col("pos"), "before")}, parallel)
    return backwards.where("_next IS NULL OR _next > pos + 1").select(F.col("pos").alias("end"))


def apply_embargo(train: DataFrame, test: DataFrame, n_samples: int, embargo=None, embargo_observations=None, embargo_fraction=None) -> DataFrame:
    """The rows of train (pos, p, e) outside the embargo after test's. A zero embargo keeps all."""
    mode = embargo_mode(embargo, embargo_observations, embargo_fraction)
    if mode is None:
        return train
    kind, width = mode
    if kind == "time":
        return embargo_masks(train, test.withColumn("block", F.lit(0)), 1, width).where("mask = 0").drop("mask") if width else train
    k = width if kind == "count" else int(n_samples * width)
    if not k:
        return train
    ends = run_ends(test).select(F.lit(0).alias("block"), F.col("end").alias("e"))
    near = sweep_masks(train, ends, 1, F.col("pos"), F.col("e"), F.col("e"), False, lambda last: F.col("pos") <= last + F.lit(k))
    return near.where("mask = 0").drop("mask")
