"""Running aggregates over a total order, and positions, without one task holding all rows.

Small inputs take one window. Larger ones are dealt by ranges of the order and written to the shared folder (range
borders are sampled, so they must not be drawn twice); each range is scanned on its own, and the aggregate of all ranges
before it, a table with one row a range, is added by a broadcast join. Inside keys (``by``) the table has a row for each
key and range, and is joined as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldwise.runtime import materialise

ONE_TASK_BYTES = 256 << 20
_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ordered_scan(df: DataFrame, order: list[str | Column], outputs: dict[str, tuple], parallel: bool | None = None, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``df`` with running aggregates (sum, max, min, count or last, the latest that isn't null) in the given order, each
    by itself for each key of ``by``. An output is (how, column), this row included, or (how, column, "before")."""
    if parallel is None:
        parallel = estimated_bytes(df) > ONE_TASK_BYTES
    keys = [F.col(c) if isinstance(c, str) else c for c in order]

    def over(window):
        frames = {"": window.rowsBetween(Window.unboundedPreceding, 0), "before": window.rowsBetween(Window.unboundedPreceding, -1)}
        return {name: _FOLD[how](c).over(frames[rest[0] if rest else ""]) for name, (how, c, *rest) in outputs.items()}

    if not parallel:
        return df.withColumns(over((Window.partitionBy(*by) if by else Window).orderBy(*keys)))
    ranged = materialise(df.repartitionByRange(*by, *keys).withColumn("_range", F.spark_partition_id()), "ranged")
    own = Window.partitionBy(*by, "_range").orderBy(*keys)
    numbered = ranged.withColumn("_nth", F.row_number().over(own)) if any(x[0] == "last" for x in outputs.values()) else ranged
    fold = lambda how, c: F.max_by(c, F.when(c.isNotNull(), F.col("_nth"))) if how == "last" else _FOLD[how](c)
    whole = numbered.groupBy(*by, "_range").agg(*[fold(how, c).alias(f"_{name}_in") for name, (how, c, *_) in outputs.items()])
    earlier = (Window.partitionBy(*by) if by else Window).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda how, name: _FOLD["sum" if how == "count" else how](F.col(f"_{name}_in")).over(earlier)
    names = [f"_by{i}" for i in range(len(by))]
    before = whole.select(*[F.col(c).alias(k) for c, k in zip(by, names)], F.col("_range").alias("_at"), *[total(how, name).alias(f"_{name}_before") for name, (how, *_) in outputs.items()])
    same = F.col("_range") == F.col("_at")
    for c, k in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(k))
    out = ranged.withColumns(over(own)).join(before if by else F.broadcast(before), same)  # one row a range without keys
    for name, (how, *_) in outputs.items():
        x, b = F.col(name), F.col(f"_{name}_before")
        joined = {"max": F.greatest, "min": F.least, "last": F.coalesce}.get(how)
        out = out.withColumn(name, joined(x, b) if joined else F.when(b.isNull(), x).when(x.isNull(), b).otherwise(x + b))
    return out.drop("_range", "_at", *names, *[f"_{name}_before" for name in outputs])


def with_positions(df: DataFrame, order: list[str | Column], name: str = "pos", parallel: bool | None = None) -> DataFrame:
    """``df`` with 0-based positions in the given total order (ties need more keys)."""
    out = ordered_scan(df, order, {name: ("count", F.lit(1))}, parallel)
    return out.withColumn(name, (F.col(name) - 1).cast("bigint"))
