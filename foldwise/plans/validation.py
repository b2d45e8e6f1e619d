"""Folds, purging, audits, paths, overfitting and Sharpe statistics."""

from __future__ import annotations

from datetime import timedelta
from itertools import combinations

from pyspark.sql import functions as F

from foldwise.functions import horizon, stats
from foldwise.operators import audit, folds, intervals, paths, pbo, search
from foldwise.operators.scan import with_positions
from foldwise.runtime import table

HOUR = timedelta(hours=1)


def events(spark, sf, *keep):
    e = table(spark, sf, "events").withColumn("label_end", F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    return folds.TemporalSplitter.samples(e, "ts", "label_end", ["ts", "event_id"], "user_id", list(keep))


S = "s AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, ts AS p, ts + INTERVAL 6 HOUR AS e, user_id AS g, event_type, value AS y FROM events), n AS (SELECT count(*) AS n FROM s)"
ROUND = 6


def r6(c):
    return (F.round(c, ROUND) + F.lit(0.0)).alias(c) if isinstance(c, str) else F.round(c, ROUND) + F.lit(0.0)


def block_sql(k: int, pos: str = "pos", n: str = "n") -> str:
    return f"CASE WHEN {pos} < ({n} % {k}) * ({n} // {k} + 1) THEN {pos} // ({n} // {k} + 1) ELSE {n} % {k} + ({pos} - ({n} % {k}) * ({n} // {k} + 1)) // ({n} // {k}) END"


def masks(k: int, m: int = 1) -> list[int]:
    return [sum(1 << b for b in c) for c in combinations(range(k), m)]


def stages_sql(k: int, fold_masks: list[int], hours: int = 0, embargo: str = "false", blocks: str = "", extra: str = "true", source: str = S) -> str:
    """CTEs up to ``st``: fold, pos, p, e, g, is_test, is_candidate, is_purged, is_embargoed. ``embargo`` is a condition on
    a row r and a test row t of a block."""
    values = ", ".join(f"({i}, {m})" for i, m in enumerate(fold_masks))
    blocks = blocks or f"SELECT s.*, n.n, {block_sql(k)} AS block FROM s, n"
    return f"""{source}, b AS ({blocks}), f(fold, fmask) AS (VALUES {values}),
pm AS (SELECT r.pos, bit_or(1::BIGINT << t.block::INT) AS m FROM b r JOIN b t ON t.p - INTERVAL {hours} HOUR < r.e AND t.e + INTERVAL {hours} HOUR > r.p WHERE r.p < r.e AND t.block IS NOT NULL GROUP BY r.pos),
em AS (SELECT r.pos, bit_or(1::BIGINT << t.block::INT) AS m FROM b r JOIN b t ON {embargo} WHERE t.block IS NOT NULL GROUP BY r.pos),
x AS (SELECT f.fold, f.fmask, b.*, coalesce((1::BIGINT << b.block::INT) & f.fmask, 0) <> 0 AS is_test, coalesce(pm.m & f.fmask, 0) <> 0 AS hit, coalesce(em.m & f.fmask, 0) <> 0 AS near
  FROM b CROSS JOIN f LEFT JOIN pm ON pm.pos = b.pos LEFT JOIN em ON em.pos = b.pos),
st AS (SELECT *, NOT is_test AND {extra} AS is_candidate, NOT is_test AND {extra} AND hit AS is_purged, NOT is_test AND {extra} AND NOT hit AND near AS is_embargoed FROM x)"""


COUNTS = "CAST(fold AS BIGINT) AS fold, sum(is_candidate::INT)::BIGINT AS candidates, sum(is_purged::INT)::BIGINT AS purged, sum(is_embargoed::INT)::BIGINT AS embargoed, sum((is_candidate AND NOT is_purged AND NOT is_embargoed)::INT)::BIGINT AS final, sum(is_test::INT)::BIGINT AS tested"


def counts(stages):
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    return stages.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(n("is_candidate").alias("candidates"), n("is_purged").alias("purged"), n("is_embargoed").alias("embargoed"), n("is_final").alias("final"), n("is_test").alias("tested"))


def folds_query(cv, sql):
    return (lambda spark, sf: counts(cv().stages(events(spark, sf))), f"WITH {sql} SELECT {COUNTS} FROM st GROUP BY fold")


QUERIES: dict = {}

# Time kernel ------------------------------------------------------------------------------------------------------


def _horizons(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("a0"), (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("a1"))
    b0, b1 = F.lit("1995-03-15").cast("timestamp_ntz"), F.lit("1995-04-15").cast("timestamp_ntz")
    return o.select("o_orderkey", horizon.overlaps(F.col("a0"), F.col("a1"), b0, b1).alias("hit"))


QUERIES["horizons_overlap"] = (_horizons, "SELECT o_orderkey, NOT (o_orderdate + INTERVAL 7 DAY <= TIMESTAMP '1995-03-15' OR TIMESTAMP '1995-04-15' <= o_orderdate) AS hit FROM orders")
QUERIES["validate_times"] = (
    lambda spark, sf: horizon.time_faults(events(spark, sf), "pos", "p", "e"),
    f"WITH {S}, l AS (SELECT *, lag(p) OVER (ORDER BY pos) AS before FROM s) SELECT coalesce(sum((p IS NULL OR e IS NULL)::INT), 0)::BIGINT AS n_missing, coalesce(sum((e < p)::INT), 0)::BIGINT AS n_reversed, min(pos) FILTER (e < p) AS first_reversed, coalesce(sum((before > p)::INT), 0)::BIGINT AS n_backward FROM l",
)

# Intervals --------------------------------------------------------------------------------------------------------


def line_rows(spark, sf):
    x = table(spark, sf, "lineitem")
    return x.select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("p"), (F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("e"))


LINES = "SELECT l_orderkey, l_linenumber, l_shipdate AS p, l_shipdate + to_days(CAST(l_quantity AS INT)) AS e FROM lineitem"


def merged_sql(less: str) -> str:
    return f"""WITH i AS ({LINES}), k AS (SELECT DISTINCT p AS start, e AS "end" FROM i WHERE p {less} e),
m AS (SELECT *, max("end") OVER (ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT min(start) AS start, max("end") AS "end" FROM g GROUP BY island"""


QUERIES["merge_intervals_half_open"] = (lambda spark, sf: intervals.merge_intervals(line_rows(spark, sf), "p", "e"), merged_sql("<"))
QUERIES["merge_intervals_closed"] = (lambda spark, sf: intervals.merge_intervals(line_rows(spark, sf), "p", "e", closed=True), merged_sql("<="))


def urgent(spark, sf):
    """The first day of each open urgent order: days that some lines' labels meet and others don't."""
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    return o.select(F.col("o_orderdate").alias("p"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("e"))


URGENT = "SELECT DISTINCT o_orderdate AS p, o_orderdate + INTERVAL 1 DAY AS e FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"
QUERIES["interval_semi_join"] = (
    lambda spark, sf: intervals.overlaps_any(line_rows(spark, sf), urgent(spark, sf)).select("l_orderkey", "l_linenumber", "hit"),
    f"WITH r AS ({LINES}), t AS ({URGENT}), d AS (SELECT DISTINCT p, e FROM r), h AS (SELECT p, e, EXISTS (SELECT 1 FROM t WHERE t.p < d.e AND t.e > d.p) AS x FROM d) SELECT l_orderkey, l_linenumber, r.p < r.e AND h.x AS hit FROM r JOIN h USING (p, e)",
)
QUERIES["point_in_interval"] = (
    lambda spark, sf: intervals.in_any_closed(line_rows(spark, sf), urgent(spark, sf)).select("l_orderkey", "l_linenumber", "hit"),
    f"WITH r AS ({LINES}), t AS ({URGENT}), d AS (SELECT DISTINCT p FROM r), h AS (SELECT p, EXISTS (SELECT 1 FROM t WHERE t.p <= d.p AND t.e >= d.p) AS x FROM d) SELECT l_orderkey, l_linenumber, h.x AS hit FROM r JOIN h USING (p)",
)

# Lines against all lines, tested against brute force.
QUERIES["merge_intervals_half_open_whole"] = (lambda spark, sf: intervals.merge_intervals(line_rows(spark, sf), "p", "e"), None)
QUERIES["merge_intervals_closed_whole"] = (lambda spark, sf: intervals.merge_intervals(line_rows(spark, sf), "p", "e", closed=True), None)
QUERIES["interval_semi_join_whole"] = (lambda spark, sf: intervals.overlaps_any(line_rows(spark, sf), line_rows(spark, sf)).select("l_orderkey", "l_linenumber", "hit"), None)
QUERIES["point_in_interval_whole"] = (lambda spark, sf: intervals.in_any_closed(line_rows(spark, sf), line_rows(spark, sf)).select("l_orderkey", "l_linenumber", "hit"), None)


def halves(spark, sf, lo, hi):
    s = events(spark, sf)
    n = s.count()
    inside = (F.col("pos") >= int(n * lo)) & (F.col("pos") < int(n * hi))
    return s.where(~inside), s.where(inside), n


def _purge(lo, hi, hours):
    def q(spark, sf):
        train, test, _ = halves(spark, sf, lo, hi)
        return intervals.purge(train, test, timedelta(hours=hours) if hours else None).select("pos")

    sql = f"WITH {S}, t AS (SELECT s.* FROM s, n WHERE pos >= floor(n * {lo}) AND pos < floor(n * {hi})) SELECT pos FROM s, n WHERE NOT (pos >= floor(n * {lo}) AND pos < floor(n * {hi})) AND NOT EXISTS (SELECT 1 FROM t WHERE t.p - INTERVAL {hours} HOUR < s.e AND t.e + INTERVAL {hours} HOUR > s.p)"
    return q, sql


QUERIES["purge_basic"] = _purge(0.4, 0.5, 0)
QUERIES["purge_padded"] = _purge(0.4, 0.5, 24)


def _purge_disjoint(spark, sf):
    s = events(spark, sf)
    return intervals.purge(s.where("pos % 1000 >= 100"), s.where("pos % 1000 < 100"), HOUR).select("pos")


QUERIES["purge_disjoint_blocks"] = (
    _purge_disjoint,
    f"WITH {S} SELECT pos FROM s WHERE pos % 1000 >= 100 AND NOT EXISTS (SELECT 1 FROM s t WHERE t.pos % 1000 < 100 AND t.p - INTERVAL 1 HOUR < s.e AND t.e + INTERVAL 1 HOUR > s.p)",
)


def _embargo(name, sql_cond, **mode):
    def q(spark, sf):
        train, test, n = halves(spark, sf, 0.4, 0.5)
        return intervals.apply_embargo(train, test, n, **mode).select("pos")

    QUERIES[name] = (q, f"WITH {S}, t AS (SELECT s.* FROM s, n WHERE pos >= floor(n * 0.4) AND pos < floor(n * 0.5)) SELECT pos FROM s, n WHERE NOT (pos >= floor(n * 0.4) AND pos < floor(n * 0.5)) AND NOT EXISTS (SELECT 1 FROM t WHERE {sql_cond})")


_embargo("embargo_duration", "s.p >= t.e AND s.p <= t.e + INTERVAL 24 HOUR", embargo="24h")
_embargo("embargo_observations", "s.pos > t.pos AND s.pos <= t.pos + 250", embargo_observations=250)
_embargo("embargo_fraction", "s.pos > t.pos AND s.pos <= t.pos + floor(n * 0.01)", embargo_fraction=0.01)

GROUPS = "gf AS (SELECT g, min(pos) AS first_pos FROM s GROUP BY g), gr AS (SELECT *, row_number() OVER (ORDER BY first_pos) - 1 AS rank, count(*) OVER () AS n FROM gf)"
QUERIES["group_blocks"] = (
    lambda spark, sf: folds.group_blocks(events(spark, sf), 5).select("g", "first_pos", "rank", F.col("block").cast("bigint").alias("block")),
    f"WITH {S}, {GROUPS} SELECT g, first_pos, rank, CAST({block_sql(5, 'rank')} AS BIGINT) AS block FROM gr",
)
QUERIES["group_overlap"] = (
    lambda spark, sf: (lambda x: audit.shared_groups(x[0], x[1]))(halves(spark, sf, 0.4, 0.5)),
    f"WITH {S}, m AS (SELECT g, pos >= floor(n * 0.4) AND pos < floor(n * 0.5) AS t FROM s, n) SELECT g FROM m WHERE t INTERSECT SELECT g FROM m WHERE NOT t",
)

# Folds ------------------------------------------------------------------------------------------------------------

DAY_AFTER = "r.p >= t.e AND r.p <= t.e + INTERVAL 24 HOUR"
KF = lambda **kw: (lambda: folds.PurgedKFold(5, **kw))
QUERIES["purged_kfold"] = folds_query(KF(purge_horizon="1h"), stages_sql(5, masks(5), 1))
QUERIES["purged_kfold_embargo"] = folds_query(KF(purge_horizon="1h", embargo="24h"), stages_sql(5, masks(5), 1, DAY_AFTER))
QUERIES["purged_kfold_fraction"] = folds_query(KF(embargo_fraction=0.02), stages_sql(5, masks(5), 0, "r.pos > t.pos AND r.pos <= t.pos + floor(t.n * 0.02)"))
QUERIES["split_stages"] = (
    lambda spark, sf: folds.PurgedKFold(4, purge_horizon="1h", embargo_observations=100).stages(events(spark, sf)).select(F.col("fold").cast("bigint").alias("fold"), "pos", "is_test", "is_candidate", "is_purged", "is_embargoed", "is_final"),
    f"WITH {stages_sql(4, masks(4), 1, 'r.pos > t.pos AND r.pos <= t.pos + 100')} SELECT CAST(fold AS BIGINT) AS fold, pos, is_test, is_candidate, is_purged, is_embargoed, is_candidate AND NOT is_purged AND NOT is_embargoed AS is_final FROM st",
)
QUERIES["cpcv_folds"] = folds_query(lambda: folds.CombinatorialPurgedCV(6, 2), stages_sql(6, masks(6, 2)))
QUERIES["cpcv_purged"] = folds_query(lambda: folds.CombinatorialPurgedCV(6, 2, purge_horizon="3h", embargo="24h"), stages_sql(6, masks(6, 2), 3, DAY_AFTER))
QUERIES["cscv_folds"] = folds_query(lambda: folds.CombinatoriallySymmetricCV(6, purge_horizon="1h"), stages_sql(6, masks(6, 3), 1))

WF_BLOCKS = "SELECT s.*, n.n, CASE WHEN pos >= n - 4 * 500 THEN (pos - (n - 4 * 500)) // 500 END AS block FROM s, n"
WF = stages_sql(4, masks(4), 1, blocks=WF_BLOCKS, extra="pos < n - 4 * 500 + fold * 500")
WF_SMALL = lambda **kw: folds.WalkForwardSplit(4, 500, purge_horizon="1h", **kw)
QUERIES["walk_forward_expanding"] = folds_query(lambda: WF_SMALL(), WF)
QUERIES["walk_forward_sliding"] = (
    lambda spark, sf: WF_SMALL(train_size=800, window="sliding").split(events(spark, sf)).select(F.col("fold").cast("bigint").alias("fold"), "pos", "role"),
    f"WITH {WF}, kept AS (SELECT fold, pos, row_number() OVER (PARTITION BY fold ORDER BY pos DESC) AS k FROM st WHERE is_candidate AND NOT is_purged) SELECT CAST(fold AS BIGINT) AS fold, pos, 'train' AS role FROM kept WHERE k <= 800 UNION ALL SELECT fold, pos, 'test' FROM st WHERE is_test",
)
def wide_sql(blocks: str, k: int, hours: int, embargo: str, extra: str) -> str:
    """Stages of many folds of one block each: pairs of rows and tested blocks instead of masks."""
    return f"""WITH {S}, b AS ({blocks}), f AS (SELECT unnest(range({k})) AS fold),
pm AS (SELECT DISTINCT r.pos, t.block AS fold FROM b r JOIN b t ON t.p - INTERVAL {hours} HOUR < r.e AND t.e + INTERVAL {hours} HOUR > r.p WHERE r.p < r.e AND t.block IS NOT NULL),
em AS (SELECT DISTINCT r.pos, t.block AS fold FROM b r JOIN b t ON {embargo} WHERE t.block IS NOT NULL),
x AS (SELECT f.fold, b.pos, coalesce(b.block = f.fold, false) AS is_test, pm.pos IS NOT NULL AS hit, em.pos IS NOT NULL AS near, {extra} AS fit
  FROM b CROSS JOIN f LEFT JOIN pm ON pm.pos = b.pos AND pm.fold = f.fold LEFT JOIN em ON em.pos = b.pos AND em.fold = f.fold),
st AS (SELECT *, NOT is_test AND fit AS is_candidate, NOT is_test AND fit AND hit AS is_purged, NOT is_test AND fit AND NOT hit AND near AS is_embargoed FROM x) SELECT {COUNTS} FROM st GROUP BY fold"""


MANY = "SELECT s.*, n.n, CASE WHEN pos >= n - 200 * 4 THEN (pos - (n - 200 * 4)) // 4 END AS block FROM s, n"
QUERIES["walk_forward_many"] = (
    lambda spark, sf: counts(folds.WalkForwardSplit(200, 4, purge_horizon="1h", embargo_observations=3).stages(events(spark, sf))),
    wide_sql(MANY, 200, 1, "r.pos > t.pos AND r.pos <= t.pos + 3", "b.pos < b.n - 800 + f.fold * 4"),
)
QUERIES["purged_kfold_many"] = (
    lambda spark, sf: counts(folds.PurgedKFold(100, purge_horizon="1h", embargo="24h").stages(events(spark, sf))),
    wide_sql(f"SELECT s.*, n.n, {block_sql(100)} AS block FROM s, n", 100, 1, DAY_AFTER, "true"),
)
GROUP_STAGES = stages_sql(5, masks(5), 0, blocks=f"SELECT s.*, n.n, {block_sql(5, 'gr.rank', 'gr.n')} AS block FROM s, n, gr WHERE gr.g = s.g", source=f"{S}, {GROUPS}")
QUERIES["purged_group_kfold"] = folds_query(lambda: folds.PurgedGroupKFold(5), GROUP_STAGES)
QUERIES["group_disjoint_check"] = (
    lambda spark, sf: folds.shared_groups(folds.PurgedKFold(5, purge_horizon="1h").stages(events(spark, sf))).groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count("*").alias("n_shared")),
    f"WITH {stages_sql(5, masks(5), 1)}, q AS (SELECT fold, g FROM st GROUP BY fold, g HAVING bool_or(is_test) AND bool_or(is_candidate AND NOT is_purged)) SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n_shared FROM q GROUP BY fold",
)
QUERIES["shuffled_kfold"] = (
    lambda spark, sf: folds.shuffled_kfold(events(spark, sf), 5).select("pos", F.col("fold").cast("bigint").alias("fold")),
    f"WITH {S}, h AS (SELECT pos, n, row_number() OVER (ORDER BY md5('0:' || pos), pos) - 1 AS r FROM s, n) SELECT pos, CAST({block_sql(5, 'r')} AS BIGINT) AS fold FROM h",
)
QUERIES["gap_split"] = (
    lambda spark, sf: folds.gap_split(events(spark, sf), 5, 20).groupBy(F.col("fold").cast("bigint").alias("fold"), "role").agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b")),
    f"WITH {S}, f AS (SELECT unnest(range(5)) AS fold), x AS (SELECT fold, pos, n // 6 AS size, n - 5 * (n // 6) + fold * (n // 6) AS a FROM s, n, f), y AS (SELECT fold, pos, CASE WHEN pos >= a AND pos < a + size THEN 'test' WHEN pos < a - 20 THEN 'train' END AS role FROM x) SELECT fold, role, count(*) AS n, min(pos) AS a, max(pos) AS b FROM y WHERE role IS NOT NULL GROUP BY fold, role",
)

# Diagnostics ------------------------------------------------------------------------------------------------------


def _overlap(spark, sf):
    train, test, _ = halves(spark, sf, 0.4, 0.5)
    return audit.overlap_fraction(train, test, "24h").select(r6("overlap"))


QUERIES["overlap_fraction"] = (
    _overlap,
    f"WITH {S}, m AS (SELECT s.*, pos >= floor(n * 0.4) AND pos < floor(n * 0.5) AS t FROM s, n) SELECT round(avg((EXISTS (SELECT 1 FROM m t WHERE t.t AND t.p - INTERVAL 24 HOUR < m.e AND t.e + INTERVAL 24 HOUR > m.p))::INT), 6) AS overlap FROM m WHERE NOT t",
)


def audit_sql(stages: str, final: str = "is_candidate AND NOT is_purged AND NOT is_embargoed", groups: bool = False) -> str:
    g = "(SELECT NOT bool_or(x) FROM (SELECT bool_or(is_test) AND bool_or(is_final) AS x FROM z q WHERE q.fold = y.fold GROUP BY g))" if groups else "CAST(NULL AS BOOLEAN)"
    return f"""WITH {stages}, z AS (SELECT *, {final} AS is_final FROM st),
y AS (SELECT *, is_final AND NOT coalesce(lag(is_final) OVER w AND lag(pos) OVER w = pos - 1, false) AS tr, is_test AND NOT coalesce(lag(is_test) OVER w AND lag(pos) OVER w = pos - 1, false) AS te FROM z WINDOW w AS (PARTITION BY fold ORDER BY pos))
SELECT CAST(fold AS BIGINT) AS fold, sum(is_candidate::INT)::BIGINT AS candidate_train_size, sum(is_final::INT)::BIGINT AS final_train_size, sum(is_test::INT)::BIGINT AS test_size, sum(is_final::INT) > 0 AS train_nonempty,
sum(is_purged::INT)::BIGINT AS rows_removed_by_purge, sum(is_embargoed::INT)::BIGINT AS rows_removed_by_embargo, sum((is_candidate AND NOT is_purged AND NOT is_embargoed AND NOT is_final)::INT)::BIGINT AS rows_removed_by_finalization, 0::BIGINT AS rows_added_by_finalization,
round(coalesce(sum(is_purged::INT) / nullif(sum(is_candidate::INT), 0), 0), 6) AS candidate_overlap_fraction, CAST(0 AS DOUBLE) AS final_overlap_fraction, true AS temporal_leakage_free, sum(tr::INT)::BIGINT AS train_block_count, sum(te::INT)::BIGINT AS test_block_count,
min(p) FILTER (is_final) AS train_time_envelope_start, max(e) FILTER (is_final) AS train_time_envelope_end, min(p) FILTER (is_test) AS test_time_envelope_start, max(e) FILTER (is_test) AS test_time_envelope_end, {g} AS groups_disjoint FROM y GROUP BY fold"""


def audited(cv):
    def q(spark, sf):
        a = audit.audit_splitter(cv(), events(spark, sf))
        return a.withColumns({"fold": F.col("fold").cast("bigint"), "candidate_overlap_fraction": r6(F.col("candidate_overlap_fraction")), "final_overlap_fraction": r6(F.col("final_overlap_fraction"))})

    return q


QUERIES["audit_purged_kfold"] = (audited(KF(purge_horizon="1h", embargo="24h")), audit_sql(stages_sql(5, masks(5), 1, DAY_AFTER)))
QUERIES["audit_cpcv"] = (audited(lambda: folds.CombinatorialPurgedCV(5, 2, purge_horizon="1h", embargo_observations=50)), audit_sql(stages_sql(5, masks(5, 2), 1, "r.block <> t.block AND r.pos > t.pos AND r.pos <= t.pos + 50")))
QUERIES["audit_walk_forward"] = (
    audited(lambda: WF_SMALL(train_size=800, window="sliding")),
    audit_sql(WF.replace("AS is_embargoed FROM x)", "AS is_embargoed FROM x), sl AS (SELECT fold, pos AS kp, row_number() OVER (PARTITION BY fold ORDER BY pos DESC) AS k FROM st WHERE is_candidate AND NOT is_purged)"), "EXISTS (SELECT 1 FROM sl WHERE sl.fold = st.fold AND sl.kp = st.pos AND sl.k <= 800)"),
)


class Unpurged(folds.PurgedKFold):
    """Leaks on purpose: it trains on what it has purged."""

    def finalize(self, out):
        return out.withColumn("is_final", F.col("is_candidate"))


QUERIES["audit_leaky"] = (
    audited(lambda: Unpurged(5, purge_horizon="1h")),
    audit_sql(stages_sql(5, masks(5), 1), "is_candidate")
    .replace("0::BIGINT AS rows_added_by_finalization", "sum((is_final AND is_purged)::INT)::BIGINT AS rows_added_by_finalization")
    .replace("CAST(0 AS DOUBLE) AS final_overlap_fraction, true AS temporal_leakage_free", "round(coalesce(sum((is_final AND hit)::INT) / nullif(sum(is_final::INT), 0), 0), 6) AS final_overlap_fraction, NOT bool_or(is_final AND hit) AS temporal_leakage_free"),
)
QUERIES["audit_group_kfold"] = (audited(lambda: folds.PurgedGroupKFold(5)), audit_sql(GROUP_STAGES, groups=True))
QUERIES["block_count"] = (
    lambda spark, sf: audit.block_count(events(spark, sf), "g"),
    f"WITH {S}, w AS (SELECT g, pos - row_number() OVER (PARTITION BY g ORDER BY pos) AS island FROM s) SELECT g, count(DISTINCT island) AS blocks FROM w GROUP BY g",
)


def _dose(spark, sf):
    s = events(spark, sf)
    n = s.count()
    # The largest padding that still leaves a row clean depends on its gap to the tests; one sweep a padding.
    out = None
    for h in range(0, 31, 6):
        one = counts(folds.PurgedKFold(3, purge_horizon=timedelta(hours=h)).stages(s)).select(F.lit(h).cast("bigint").alias("hours"), "fold", "purged")
        out = one if out is None else out.unionByName(one)
    return out if n else out


QUERIES["dose_response"] = (_dose, " UNION ALL ".join(f"(WITH {stages_sql(3, masks(3), h)} SELECT {h}::BIGINT AS hours, CAST(fold AS BIGINT) AS fold, sum(is_purged::INT)::BIGINT AS purged FROM st GROUP BY fold)" for h in range(0, 31, 6)))

# Paths ------------------------------------------------------------------------------------------------------------

CV = lambda **kw: folds.CombinatorialPurgedCV(6, 2, **kw)
PATHS = f"""pt AS (SELECT f.fold, k.block, row_number() OVER (PARTITION BY k.block ORDER BY f.fold) - 1 AS path FROM (VALUES {', '.join(f'({i}, {m})' for i, m in enumerate(masks(6, 2)))}) f(fold, fmask), (SELECT unnest(range(6)) AS block) k WHERE (1::BIGINT << k.block::INT) & f.fmask <> 0)"""


def _paths(spark, sf):
    s = events(spark, sf)
    cv = CV()
    predictions = cv.stages(s).where("is_test").select("fold", "pos", (F.col("pos") * 100 + F.col("fold")).cast("double").alias("prediction"))
    return paths.reconstruct_paths(predictions, cv, s.count()).withColumn("path", F.col("path").cast("bigint"))


QUERIES["reconstruct_paths"] = (_paths, f"WITH {S}, {PATHS} SELECT pt.path, s.pos, CAST(s.pos * 100 + pt.fold AS DOUBLE) AS prediction FROM s, n, pt WHERE pt.block = {block_sql(6)}")


def _mean_paths(spark, sf):
    s = events(spark, sf, "value")
    out = paths.backtest_paths(s, CV(purge_horizon="1h"), {"m": F.avg("value")}, F.col("m"))
    return out.select(F.col("path").cast("bigint").alias("path"), "pos", r6("prediction"))


QUERIES["backtest_paths_mean"] = (
    _mean_paths,
    f"WITH {stages_sql(6, masks(6, 2), 1)}, {PATHS}, m AS (SELECT fold, avg(y) AS m FROM st WHERE is_candidate AND NOT is_purged GROUP BY fold) SELECT pt.path, st.pos, round(m.m, 6) AS prediction FROM st JOIN m ON m.fold = st.fold JOIN pt ON pt.fold = st.fold AND pt.block = st.block WHERE st.is_test",
)


def _ols_paths(spark, sf):
    s = events(spark, sf, "value").withColumn("x", F.hour("p").cast("double"))
    fit = {"b": F.regr_slope("value", "x"), "a": F.regr_intercept("value", "x")}
    out = paths.backtest_paths(s, CV(purge_horizon="1h"), fit, F.col("a") + F.col("b") * F.col("x"))
    return out.select(F.col("path").cast("bigint").alias("path"), "pos", r6("prediction"))


QUERIES["backtest_paths_ols"] = (
    _ols_paths,
    f"WITH {stages_sql(6, masks(6, 2), 1)}, {PATHS}, m AS (SELECT fold, regr_slope(y, hour(p)) AS b, regr_intercept(y, hour(p)) AS a FROM st WHERE is_candidate AND NOT is_purged GROUP BY fold) SELECT pt.path, st.pos, round(m.a + m.b * hour(st.p), 6) AS prediction FROM st JOIN m ON m.fold = st.fold JOIN pt ON pt.fold = st.fold AND pt.block = st.block WHERE st.is_test",
)

# Returns: mean value by type and six hours, less the one before ------------------------------------------------------


def returns(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").groupBy("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21600000000).cast("bigint").alias("bin")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("event_type").orderBy("bin")
    r = e.select(F.col("event_type").alias("config"), "bin", (F.col("v") - F.lag("v").over(w)).alias("r")).where("r IS NOT NULL")
    first = r.agg(F.min("bin").alias("b0"))
    return r.join(F.broadcast(first), F.lit(True)).select("config", (F.col("bin") - F.col("b0")).alias("pos"), F.col("r"), "bin")  # one row


R = "q AS (SELECT event_type AS config, epoch_us(ts) // 21600000000 AS bin, avg(value) AS v FROM events GROUP BY ALL), q2 AS (SELECT config, bin, v - lag(v) OVER (PARTITION BY config ORDER BY bin) AS r FROM q), r AS (SELECT config, bin - (SELECT min(bin) FROM q2 WHERE r IS NOT NULL) AS pos, r, bin FROM q2 WHERE r IS NOT NULL)"


def _metrics(year=None):
    def q(spark, sf):
        out = paths.path_metrics(returns(spark, sf).withColumnRenamed("config", "path"), "r", year)
        return out.select("path", *[r6(c) for c in ("sharpe", "calmar", "max_drawdown", "total_return")])

    scale = f"* sqrt({year})" if year else ""
    gain = f"avg(r) * {year}" if year else "sum(r)"
    return q, f"WITH {R}, c AS (SELECT *, sum(r) OVER (PARTITION BY config ORDER BY pos ROWS UNBOUNDED PRECEDING) AS eq FROM r), d AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY config ORDER BY pos ROWS UNBOUNDED PRECEDING)) - eq AS dd FROM c) SELECT config AS path, round(avg(r) / stddev_samp(r) {scale}, 6) AS sharpe, round(({gain}) / max(dd), 6) AS calmar, round(max(dd), 6) AS max_drawdown, round(sum(r), 6) + 0.0 AS total_return FROM d GROUP BY config"


QUERIES["path_metrics"] = _metrics()
QUERIES["path_metrics_annual"] = _metrics(1461)
QUERIES["max_drawdown"] = (
    lambda spark, sf: paths.path_metrics(returns(spark, sf).withColumnRenamed("config", "path"), "r").select("path", r6("max_drawdown")),
    f"WITH {R}, c AS (SELECT *, sum(r) OVER (PARTITION BY config ORDER BY pos ROWS UNBOUNDED PRECEDING) AS eq FROM r) SELECT b.config AS path, round(greatest(max(a.eq - b.eq), max(-b.eq), 0), 6) AS max_drawdown FROM c b LEFT JOIN c a ON a.config = b.config AND a.pos <= b.pos GROUP BY b.config",
)

# Overfitting ------------------------------------------------------------------------------------------------------

PB = "({x} & fmask) <> 0"


def pbo_sql(drop: str = "0::BIGINT", extra: str = "") -> str:
    values = ", ".join(f"({i}, {m})" for i, m in enumerate(masks(6, 3)))
    sharpe = "CASE WHEN count(*) FILTER ({c}) < 2 OR max(r) FILTER ({c}) = min(r) FILTER ({c}) THEN 0 ELSE avg(r) FILTER ({c}) / stddev_samp(r) FILTER ({c}) END"
    return f"""{R}, rn AS (SELECT max(pos) + 1 AS n FROM r), f(fold, fmask) AS (VALUES {values}){extra},
rb AS (SELECT r.*, {block_sql(6)} AS block, {drop} AS drp FROM r, rn), x AS (SELECT *, (1::BIGINT << block::INT) & fmask <> 0 AS oos, (1::BIGINT << block::INT) & fmask = 0 AND drp & fmask = 0 AS ins FROM rb, f),
sc AS (SELECT fmask, config, {sharpe.format(c='ins')} AS is_perf, {sharpe.format(c='oos')} AS oos_perf FROM x GROUP BY fmask, config HAVING count(*) FILTER (ins) > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY fmask ORDER BY is_perf DESC, config) AS best, rank() OVER (PARTITION BY fmask ORDER BY oos_perf) + (count(*) OVER (PARTITION BY fmask, oos_perf) - 1) / 2 AS rnk, count(*) OVER (PARTITION BY fmask) AS c FROM sc),
lg AS (SELECT fmask, config, ln((rnk / (c + 1)) / (1 - rnk / (c + 1))) AS logit, is_perf AS is_best, oos_perf AS oos_best FROM rk WHERE best = 1)"""


def bins(spark, sf):
    own = returns(spark, sf).select("pos", "bin").distinct()
    at = F.timestamp_micros(F.col("bin") * 21600000000).cast("timestamp_ntz")
    return own.select("pos", at.alias("p"), (at + F.expr("INTERVAL 12 HOURS")).alias("e"))


BINS = ", sb AS (SELECT DISTINCT pos, make_timestamp(bin * 21600000000) AS p, make_timestamp(bin * 21600000000) + INTERVAL 12 HOUR AS e FROM r), sbb AS (SELECT sb.*, " + block_sql(6) + " AS block FROM sb, rn), dr AS (SELECT a.pos, bit_or(1::BIGINT << t.block::INT) AS m FROM sbb a JOIN sbb t ON (t.p - INTERVAL 6 HOUR < a.e AND t.e + INTERVAL 6 HOUR > a.p) OR (a.p >= t.e AND a.p <= t.e + INTERVAL 24 HOUR) GROUP BY a.pos)"
PURGED = pbo_sql("coalesce((SELECT m FROM dr WHERE dr.pos = r.pos), 0)", BINS)
SUMMARY = "SELECT round(avg(CASE WHEN logit < 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo, round(covar_pop(oos_best, is_best) / var_pop(is_best), 6) AS slope, count(*) AS n_combos FROM lg"
plain = lambda spark, sf: pbo.scores(returns(spark, sf).select("config", "pos", "r"), 6)
purged = lambda spark, sf: pbo.scores(returns(spark, sf).select("config", "pos", "r"), 6, bins(spark, sf), purge_horizon="6h", embargo="24h")
rounded = lambda df: df.select(r6("pbo"), r6("slope"), "n_combos")
QUERIES["pbo"] = (lambda spark, sf: rounded(pbo.summary(pbo.logits(plain(spark, sf)))), f"WITH {pbo_sql()} {SUMMARY}")
QUERIES["pbo_purged"] = (lambda spark, sf: rounded(pbo.summary(pbo.logits(purged(spark, sf)))), f"WITH {PURGED} {SUMMARY}")
QUERIES["pbo_logits"] = (
    lambda spark, sf: pbo.logits(plain(spark, sf)).select("fmask", "config", r6("logit"), r6("is_best"), r6("oos_best")),
    f"WITH {pbo_sql()} SELECT fmask::BIGINT AS fmask, config, round(logit, 6) + 0.0 AS logit, round(is_best, 6) + 0.0 AS is_best, round(oos_best, 6) + 0.0 AS oos_best FROM lg",
)
QUERIES["pbo_sharpe"] = (
    lambda spark, sf: plain(spark, sf).select("fmask", "config", r6("is_perf"), r6("oos_perf")),
    f"WITH {pbo_sql()} SELECT fmask::BIGINT AS fmask, config, round(is_perf, 6) + 0.0 AS is_perf, round(oos_perf, 6) + 0.0 AS oos_perf FROM sc",
)

# Sharpe statistics --------------------------------------------------------------------------------------------------

# Central moments from scratch, then the bias corrections.
MOMENTS = f"""{R}, c1 AS (SELECT config, r - avg(r) OVER (PARTITION BY config) AS z, avg(r) OVER (PARTITION BY config) AS m FROM r),
c2 AS (SELECT config, count(*) AS n, any_value(m) AS m, avg(z * z) AS m2, avg(z * z * z) AS m3, avg(z * z * z * z) AS m4 FROM c1 GROUP BY config),
mo AS (SELECT config, n, m / sqrt(m2) AS sharpe, m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2) AS skew, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) + 3 AS kurt FROM c2)"""
moments = lambda spark, sf: stats.sharpe_moments(returns(spark, sf), "r", "config")


def psr_sql(star: float) -> str:
    return f"{MOMENTS}, zz AS (SELECT *, (sharpe - ({star!r}::DOUBLE)) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS z FROM mo)"


QUERIES["sharpe_moments"] = (lambda spark, sf: moments(spark, sf).select("config", "n", r6("sharpe"), r6("skew"), r6("kurt")), f"WITH {MOMENTS} SELECT config, n, round(sharpe, 6) + 0.0 AS sharpe, round(skew, 6) + 0.0 AS skew, round(kurt, 6) + 0.0 AS kurt FROM mo")
QUERIES["psr"] = (lambda spark, sf: stats.probabilistic_sharpe(moments(spark, sf), 0.01).select("config", r6("psr")), f"WITH {psr_sql(0.01)} SELECT config, round({stats.phi_sql('z')}, 6) AS psr FROM zz")
QUERIES["expected_max_z"] = (
    lambda spark, sf: spark.createDataFrame([(n, stats.expected_max_z(n)) for n in (1, 2, 10, 100, 1000)], "n_trials bigint, z double").select("n_trials", r6("z")),
    # Known values of the approximation, six places.
    "SELECT n_trials::BIGINT AS n_trials, z::DOUBLE AS z FROM (VALUES " + ", ".join(f"({n}, {round(stats.expected_max_z(n), 6)})" for n in (1, 2, 10, 100, 1000)) + ") v(n_trials, z)",
)
STAR = (0.02**0.5) * stats.expected_max_z(20)
QUERIES["dsr"] = (lambda spark, sf: stats.deflated_sharpe(moments(spark, sf), 20, 0.02).select("config", r6("dsr")), f"WITH {psr_sql(STAR)} SELECT config, round({stats.phi_sql('z')}, 6) AS dsr FROM zz")
QUERIES["dsr_full"] = (
    lambda spark, sf: stats.deflated_sharpe(moments(spark, sf), 20, 0.02).select("config", r6("dsr"), r6("observed_sr"), r6("sr_star"), r6("expected_max_z"), "var_sharpe", "n_trials", "n_obs", r6("skew"), r6("kurt")),
    f"WITH {psr_sql(STAR)} SELECT config, round({stats.phi_sql('z')}, 6) AS dsr, round(sharpe, 6) + 0.0 AS observed_sr, {round(STAR, 6)}::DOUBLE AS sr_star, {round(stats.expected_max_z(20), 6)}::DOUBLE AS expected_max_z, 0.02::DOUBLE AS var_sharpe, 20::BIGINT AS n_trials, n AS n_obs, round(skew, 6) + 0.0 AS skew, round(kurt, 6) + 0.0 AS kurt FROM zz",
)
QUERIES["min_trl"] = (
    lambda spark, sf: stats.min_track_record(moments(spark, sf), -0.5, 0.05).select("config", "min_trl"),
    f"WITH {MOMENTS} SELECT config, CASE WHEN sharpe <= -0.5 THEN 'inf'::DOUBLE ELSE ceil(pow(1.6448536269514715 * sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / (sharpe + 0.5), 2)) + 1 END AS min_trl FROM mo",
)
QUERIES["min_btl"] = (
    lambda spark, sf: spark.createDataFrame([(n, stats.minimum_backtest_length(n)) for n in (1, 10, 45)], "n_trials bigint, years double").select("n_trials", r6("years")),
    "SELECT n_trials::BIGINT AS n_trials, round(z * z, 6) AS years FROM (VALUES " + ", ".join(f"({n}, {stats.expected_max_z(n)!r}::DOUBLE)" for n in (1, 10, 45)) + ") v(n_trials, z)",
)
QUERIES["effective_n_trials"] = (
    lambda spark, sf: stats.effective_trials(returns(spark, sf), "r", "pos", "config"),
    f"""WITH {R}, i AS (SELECT config, row_number() OVER (PARTITION BY config ORDER BY pos) AS i, r - avg(r) OVER (PARTITION BY config) AS z FROM r),
a AS (SELECT x.config, y.i - x.i AS k, sum(x.z * y.z) AS c FROM i x JOIN i y ON x.config = y.config AND y.i > x.i GROUP BY ALL), v AS (SELECT config, count(*) AS n, sum(z * z) AS ss FROM i GROUP BY config),
w AS (SELECT a.config, k, c / ss AS rho, min(CASE WHEN c / ss <= 0 THEN k END) OVER (PARTITION BY a.config) AS stop FROM a JOIN v ON v.config = a.config),
t AS (SELECT v.config, n, coalesce((SELECT sum(rho) FROM w WHERE w.config = v.config AND (stop IS NULL OR k < stop)), 0) AS s FROM v)
SELECT config, n, CAST(least(greatest(round_even(n / (1 + 2 * s), 0), 1), n) AS BIGINT) AS effective FROM t""",
)


def _trials(spark, sf):
    m = moments(spark, sf).select(F.col("sharpe").alias("value"), F.create_map(F.lit("sharpe"), F.when(F.col("config") != "click", F.col("sharpe").cast("string"))).alias("user_attrs"))
    return search.trial_variance(m).select("n_trials", r6("var_sharpe"))


QUERIES["trial_var_sharpe"] = (_trials, f"WITH {MOMENTS} SELECT count(*) AS n_trials, round(var_samp(sharpe), 6) + 0.0 AS var_sharpe FROM mo WHERE config <> 'click'")


def _positions(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return with_positions(o, ["o_orderdate", "o_orderkey"], parallel=True).select("o_orderkey", "pos")


QUERIES["positions"] = (_positions, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
