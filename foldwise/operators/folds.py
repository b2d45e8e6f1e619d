"""Fold generators. All folds of a splitter are one plan.

Each row gets its block once, with bit masks of the blocks that purge it and that embargo it; a fold is a mask of test
blocks. Overlap with a union is the union of overlaps, so combinatorial folds need one sweep, not one a fold.

A mask is a number for up to ``WORD`` blocks; for more it is the array of the blocks that hit the row, found by a sweep
inside each block over the rows that its hull meets.
"""

from __future__ import annotations

import inspect
import json
import math
from datetime import timedelta
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.errors import GroupLeakageError
from foldwise.functions.horizon import aligned, check_integer, check_positions, check_times_schema, embargo_mode, parse_horizon, validate_times
from foldwise.operators.intervals import embargo_masks, embargoed_pairs, hit_blocks, prune, purge_masks, purged_pairs
from foldwise.operators.scan import ordered_scan, with_positions

#: Blocks of one number.
WORD = 62


def block_of(pos: Column, n: int, k: int) -> Column:
    """The block of a position when n rows make k runs and the first ``n mod k`` runs have one row more."""
    q, r = divmod(n, k)
    if not q:
        return pos.cast("int")
    head = F.lit(r * (q + 1)).cast("bigint")
    return F.when(pos < head, F.floor(pos / F.lit(q + 1))).otherwise(F.lit(r) + F.floor((pos - head) / F.lit(q))).cast("int")


def block_sizes(n: int, k: int) -> list[int]:
    q, r = divmod(n, k)
    return [q + (i < r) for i in range(k)]


class TemporalSplitter:
    """Settings of a splitter. ``samples`` needs columns pos (0-based), p and e, and g where groups are used."""

    uses_groups = False
    #: From this many rows on, rows that can't be hit are set aside before the sweep.
    prune_from: int | None = 200_000

    def __new__(cls, *args, **settings):
        new = super().__new__(cls)
        new._given = (args, settings)
        return new

    def __init__(self, *, purge_horizon=None, embargo=None, embargo_observations=None, embargo_fraction=None):
        self.horizon = parse_horizon(purge_horizon) if purge_horizon is not None else None
        self.mode = embargo_mode(embargo, embargo_observations, embargo_fraction)

    def with_settings(self, **changes) -> "TemporalSplitter":
        """A splitter of the same kind with other settings, checked as new ones are; another kind of embargo takes the
        place of the one before. The splitter holds no data, so other times are just other samples."""
        args, settings = self._given
        names = [n for n in inspect.signature(type(self).__init__).parameters if n != "self"]
        merged = dict(zip(names, args)) | settings
        kinds = {"embargo", "embargo_observations", "embargo_fraction"}
        if kinds & changes.keys():
            merged = {k: v for k, v in merged.items() if k not in kinds}
        other = type(self)(**merged | changes)
        other.prune_from = self.prune_from
        return other

    @staticmethod
    def samples(df: DataFrame, pred: str, eval_: str, order: list[str], group: str | None = None, keep: list[str] = ()) -> DataFrame:
        check_times_schema(df, pred, eval_)
        p, e = aligned(df, pred, eval_)
        own = df.select(p.alias("p"), e.alias("e"), *([F.col(group).alias("g")] if group else []), *keep, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
        return with_positions(own, [f"_o{i}" for i in range(len(order))]).drop(*[f"_o{i}" for i in range(len(order))])

    def get_n_splits(self) -> int:
        raise NotImplementedError

    def folds(self) -> list[int]:
        """Test blocks of each fold as bit masks."""
        return [1 << b for b in range(self.n_blocks)]

    def with_blocks(self, samples: DataFrame, n: int) -> DataFrame:
        """samples with ``block`` (null: never tested)."""
        return samples.withColumn("block", block_of(F.col("pos"), n, self.n_blocks))

    def check(self, n: int) -> None:
        pass

    def candidates(self, n: int) -> Column | None:
        """A further condition on (fold, pos) of candidates; by default all rows that aren't tested are."""
        return None

    @property
    def wide(self) -> bool:
        return self.n_blocks > WORD

    def masks(self, samples: DataFrame) -> tuple[DataFrame, int]:
        """samples with block, purge_mask and embargo_mask; and the number of rows. Positions have to be 0 to n - 1, as
        their number, ends and sum show; ``split`` with ``validate`` looks at each."""
        if samples.schema["pos"].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise TypeError("positions are integers")
        x = samples.agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("z"), F.try_sum(F.col("pos").cast("bigint")).alias("s"), F.count("pos").alias("there")).first()
        n = x["n"]
        if n and ((x["there"], x["a"], x["z"]) != (n, 0, n - 1) or x["s"] not in (None, n * (n - 1) // 2)):  # no sum: over 64 bits
            raise ValueError(f"positions are not 0 to {n - 1}")
        self.check(n)
        rows = self.with_blocks(samples, n)
        tests = rows.where("block IS NOT NULL")
        none = F.lit(0).cast("bigint")
        pad = F.lit(self.horizon or timedelta(0))
        prune_from = n if self.prune_from is None else self.prune_from

        def swept(rows, name, a, z, low, high, sweep, in_blocks):
            if self.wide:
                found = hit_blocks(rows.select("pos", "block", "p", "e"), tests, a, z, low, high, in_blocks).select(F.col("pos").alias("_at"), F.col("blocks").alias(name))
                return rows.join(found, F.col("pos") == F.col("_at"), "left").drop("_at").withColumn(name, F.coalesce(name, F.array().cast("array<int>")))
            if n <= prune_from:
                return sweep(rows, tests).withColumnRenamed("mask", name)
            some, others, met = prune(rows, tests, a, z, low, high)
            return sweep(some, met).withColumnRenamed("mask", name).unionByName(others.withColumn(name, none))

        p, e = F.col("p"), F.col("e")
        purging = lambda r, t: purge_masks(r, t.select("block", "p", "e"), self.n_blocks, self.horizon)
        rows = swept(rows, "purge_mask", p - pad, e + pad, p, e, purging, lambda r, t: purged_pairs(r, t, self.horizon))
        if self.mode is None:
            return rows.withColumn("embargo_mask", self.mask_of({})), n
        kind, width = self.mode
        if kind == "time":
            if not width:
                return rows.withColumn("embargo_mask", self.mask_of({})), n
            after = F.lit(width)
            embargoing = lambda r, t: embargo_masks(r, t.select("block", "e"), self.n_blocks, width)
            return swept(rows, "embargo_mask", e, e + after, p, p, embargoing, lambda r, t: embargoed_pairs(r, t, width)), n
        k = width if kind == "count" else int(n * width)
        return self.positional_masks(rows, n, k), n

    def positional_masks(self, rows: DataFrame, n: int, k: int) -> DataFrame:
        """Blocks are runs of positions here: after each stand up to k embargoed rows."""
        near, stop = {}, self.first_test(n)
        for b, size in enumerate(self.sizes(n)):
            stop += size
            if size and k:
                near[b] = stop
        if self.wide:
            stops = F.from_json(F.lit(json.dumps([{"b": b, "stop": at} for b, at in near.items()])), "array<struct<b:int,stop:bigint>>")
            hit = F.filter(stops, lambda x: (x["stop"] <= F.col("pos")) & (F.col("pos") < x["stop"] + k))
            return rows.withColumn("embargo_mask", F.transform(hit, lambda x: x["b"]))
        return rows.withColumn("embargo_mask", self.mask_of({b: (F.col("pos") >= at) & (F.col("pos") < at + k) for b, at in near.items()}))

    def mask_of(self, hit: dict[int, Column]) -> Column:
        """The mask of those blocks whose condition holds."""
        if self.wide:
            near = [F.when(F.coalesce(c, F.lit(False)), F.lit(b)) for b, c in hit.items()]
            return F.array_compact(F.array(*near)).cast("array<int>") if near else F.array().cast("array<int>")
        mask = F.lit(0).cast("bigint")
        for b, c in hit.items():
            mask = mask + F.when(F.coalesce(c, F.lit(False)), F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return mask

    def first_test(self, n: int) -> int:
        return 0

    def sizes(self, n: int) -> list[int]:
        return block_sizes(n, self.n_blocks)

    def stages(self, samples: DataFrame) -> DataFrame:
        """One row for each fold and row: fold, pos, p, e (g), is_test, is_candidate, is_purged, is_embargoed, is_final."""
        rows, n = self.masks(samples)
        folds = self.folds()
        if not self.wide:
            both = rows.select(*rows.columns, F.posexplode(F.lit(folds).cast("array<bigint>")).alias("fold", "fmask"))
            tested = F.coalesce(F.expr("shiftleft(1L, block)"), F.lit(0).cast("bigint")).bitwiseAND(F.col("fmask")) != 0
        elif folds == [1 << b for b in range(self.n_blocks)]:
            both = rows.select(*rows.columns, F.explode(F.sequence(F.lit(0), F.lit(self.n_blocks - 1))).alias("fold"))
            tested = F.coalesce(F.col("block") == F.col("fold"), F.lit(False))
        else:
            blocks = json.dumps([[b for b in range(self.n_blocks) if m >> b & 1] for m in folds])
            both = rows.select(*rows.columns, F.posexplode(F.from_json(F.lit(blocks), "array<array<int>>")).alias("fold", "fmask"))
            tested = F.coalesce(F.array_contains("fmask", F.col("block")), F.lit(False))
        further = self.candidates(n)
        out = both.withColumn("is_test", tested)
        out = out.withColumn("is_candidate", ~F.col("is_test") & further if further is not None else ~F.col("is_test"))
        out = out.withColumn("is_purged", F.col("is_candidate") & self.hit(out, "purge_mask"))
        out = self.embargoed(out, n)
        out = out.withColumn("is_kept", F.col("is_candidate") & ~F.col("is_purged") & ~F.col("is_embargoed"))
        out = self.finalize(out)
        keep = [c for c in rows.columns if c not in ("block", "purge_mask", "embargo_mask", "fmask")]
        return out.select("fold", *keep, "is_test", "is_candidate", "is_purged", "is_embargoed", "is_final")

    def hit(self, out: DataFrame, mask: str) -> Column:
        """Whether a block of the fold is in the row's mask."""
        if not self.wide:
            return F.col(mask).bitwiseAND(F.col("fmask")) != 0
        return F.arrays_overlap(mask, "fmask") if "fmask" in out.columns else F.array_contains(mask, F.col("fold"))

    def embargoed(self, out: DataFrame, n: int) -> DataFrame:
        return out.withColumn("is_embargoed", F.col("is_candidate") & ~F.col("is_purged") & self.hit(out, "embargo_mask"))

    def finalize(self, out: DataFrame) -> DataFrame:
        return out.withColumn("is_final", F.col("is_kept"))

    def split(self, samples: DataFrame, validate: bool = False) -> DataFrame:
        """(fold, pos, role) with role train or test."""
        if validate:
            check_positions(samples, samples.count())
            validate_times(samples, "p", "e")
        s = self.stages(samples)
        if self.uses_groups and validate:
            bad = shared_groups(s).limit(1).collect()
            if bad:
                raise GroupLeakageError(f"group {bad[0]['g']} is on both sides of fold {bad[0]['fold']}")
        return s.where("is_test OR is_final").select("fold", "pos", F.when(F.col("is_test"), "test").otherwise("train").alias("role"))


def shared_groups(stages: DataFrame) -> DataFrame:
    """(fold, g) of groups that are trained on and tested."""
    one = stages.groupBy("fold", "g").agg(F.max("is_final").alias("a"), F.max("is_test").alias("b"))
    return one.where("a AND b").select("fold", "g")


class PurgedKFold(TemporalSplitter):
    """Runs of positions as test folds."""

    def __init__(self, n_splits: int = 5, **settings):
        super().__init__(**settings)
        self.n_blocks = check_integer(n_splits, "n_splits", 2)

    def get_n_splits(self) -> int:
        return self.n_blocks


class WalkForwardSplit(TemporalSplitter):
    """Test folds tile the end of the series; training is what stands before, or its last ``train_size`` kept rows."""

    def __init__(self, n_splits: int, test_size: int, *, train_size: int | None = None, window: str = "expanding", **settings):
        super().__init__(**settings)
        self.n_blocks, self.test_size = check_integer(n_splits, "n_splits", 1), check_integer(test_size, "test_size", 1)
        if window not in ("expanding", "sliding"):
            raise ValueError("window is expanding or sliding")
        if (window == "sliding") != (train_size is not None):
            raise ValueError("train_size belongs to a sliding window")
        self.train_size = check_integer(train_size, "train_size", 1) if train_size is not None else None

    def get_n_splits(self) -> int:
        return self.n_blocks

    def check(self, n: int) -> None:
        if self.n_blocks * self.test_size >= n:
            raise ValueError("the test folds leave no rows to train on")

    def first_test(self, n: int) -> int:
        return n - self.n_blocks * self.test_size

    def sizes(self, n: int) -> list[int]:
        return [self.test_size] * self.n_blocks

    def with_blocks(self, samples: DataFrame, n: int) -> DataFrame:
        first = self.first_test(n)
        return samples.withColumn("block", F.when(F.col("pos") >= first, F.floor((F.col("pos") - first) / self.test_size).cast("int")))

    def candidates(self, n: int) -> Column:
        return F.col("pos") < F.lit(self.first_test(n)) + F.col("fold") * F.lit(self.test_size)

    def finalize(self, out: DataFrame) -> DataFrame:
        if self.train_size is None:
            return super().finalize(out)
        later = ordered_scan(out, [F.desc("pos")], {"_kept": ("count", F.when(F.col("is_kept"), 1))}, by=["fold"])
        return later.withColumn("is_final", F.col("is_kept") & (F.col("_kept") <= self.train_size))


class PurgedGroupKFold(TemporalSplitter):
    """Groups in order of first appearance, cut into blocks; a group's rows are tested together."""

    uses_groups = True

    def __init__(self, n_splits: int, **settings):
        super().__init__(**settings)
        self.n_blocks = check_integer(n_splits, "n_splits", 2)

    def get_n_splits(self) -> int:
        return self.n_blocks

    def with_blocks(self, samples: DataFrame, n: int) -> DataFrame:
        return samples.join(group_blocks(samples, self.n_blocks).select("g", "block"), "g")

    def positional_masks(self, rows: DataFrame, n: int, k: int) -> DataFrame:
        """Runs of each fold's test positions: a row is embargoed by the last test run's end at most k before it."""
        out = ordered_scan(rows, [F.desc("pos")], {"_next": ("last", F.col("block"), "before")})
        # The end of a run: a row of the block whose successor is of another.
        is_end = F.col("_next").isNull() | (F.col("_next") != F.col("block"))
        out = ordered_scan(out, ["pos"], {f"_end{b}": ("max", F.when((F.col("block") == b) & is_end, F.col("pos"))) for b in range(self.n_blocks)})
        near = {b: (F.col(f"_end{b}") < F.col("pos")) & (F.col("pos") <= F.col(f"_end{b}") + F.lit(k)) for b in range(self.n_blocks)}
        return out.withColumn("embargo_mask", self.mask_of(near)).drop("_next", *[f"_end{b}" for b in near])


def group_blocks(samples: DataFrame, k: int) -> DataFrame:
    """(g, first_pos, rank, block): groups by first appearance in k blocks. ValueError: missing labels or too few groups."""
    if samples.where("g IS NULL").limit(1).count():
        raise ValueError("group labels are missing")
    firsts = samples.groupBy("g").agg(F.min("pos").alias("first_pos"))
    ranked = with_positions(firsts, ["first_pos"], "rank")
    n = firsts.count()
    if k > n:
        raise ValueError(f"{k} splits of {n} groups")
    return ranked.withColumn("block", block_of(F.col("rank"), n, k))


class CombinatorialPurgedCV(TemporalSplitter):
    """Every choice of ``n_test_groups`` of ``n_splits`` runs is a fold, in lexicographic order."""

    def __init__(self, n_splits: int = 6, n_test_groups: int = 2, **settings):
        super().__init__(**settings)
        self.n_blocks = check_integer(n_splits, "n_splits", 2)
        self.n_test = check_integer(n_test_groups, "n_test_groups", 1)
        if self.n_test >= self.n_blocks:
            raise ValueError("n_test_groups is below n_splits")

    def check(self, n: int) -> None:
        if n < self.n_blocks:
            raise ValueError("fewer rows than blocks")

    def get_n_splits(self) -> int:
        return math.comb(self.n_blocks, self.n_test)

    def n_paths(self) -> int:
        return math.comb(self.n_blocks - 1, self.n_test - 1)

    def folds(self) -> list[int]:
        return [sum(1 << b for b in c) for c in combinations(range(self.n_blocks), self.n_test)]


class CombinatoriallySymmetricCV(CombinatorialPurgedCV):
    """Half of the blocks are tested in each fold."""

    def __init__(self, n_splits: int = 16, **settings):
        if check_integer(n_splits, "n_splits", 2) % 2:
            raise ValueError("n_splits is even")
        super().__init__(n_splits, n_splits // 2, **settings)


def shuffled_kfold(samples: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Baseline that leaks: (pos, fold) by a hash order of positions."""
    n = samples.count()
    mixed = samples.select("pos", F.md5(F.concat(F.lit(f"{seed}:"), F.col("pos").cast("string")).cast("binary")).alias("_h"))
    return with_positions(mixed, ["_h", "pos"], "_r").select("pos", block_of(F.col("_r"), n, k).alias("fold"))


def gap_split(samples: DataFrame, n_splits: int, gap: int = 0) -> DataFrame:
    """Baseline: test folds of n / (n_splits + 1) rows at the end, training all rows at least ``gap`` before."""
    n = samples.count()
    size = n // (n_splits + 1)
    first = n - n_splits * size
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")
    s = samples.select("pos", folds).withColumn("_a", F.lit(first) + F.col("fold") * size)
    role = F.when((F.col("pos") >= F.col("_a")) & (F.col("pos") < F.col("_a") + size), "test").when(F.col("pos") < F.col("_a") - gap, "train")
    return s.withColumn("role", role).where("role IS NOT NULL").select("fold", "pos", "role")
