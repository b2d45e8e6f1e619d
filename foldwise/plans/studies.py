"""Feature pipelines, labels, error metrics and selection studies on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from foldwise.operators import features as X, folds
from foldwise.operators.scan import with_positions
from foldwise.plans.validation import S, events, masks, r6, stages_sql
from foldwise.runtime import table

QUERIES: dict = {}
BY, ORDER = ["user_id"], ["ts", "event_id"]
W = "PARTITION BY user_id ORDER BY ts, event_id"


def ev(spark, sf):
    return table(spark, sf, "events")


def od(spark, sf):
    return table(spark, sf, "orders")


QUERIES["clean_numeric"] = (
    lambda spark, sf: ev(spark, sf).select("event_id", X.to_number(F.concat(F.lit(" "), F.when(F.col("event_id") % 7 == 0, "Null").otherwise(F.col("event_id").cast("string")), F.lit(" "))).alias("x")).where("x IS NOT NULL"),
    "SELECT event_id, CAST(event_id AS DOUBLE) AS x FROM events WHERE event_id % 7 <> 0",
)
QUERIES["entity_subset"] = (
    lambda spark, sf: od(spark, sf).join(table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_custkey"),
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
)
QUERIES["eligible_entities"] = (
    lambda spark, sf: X.eligible(od(spark, sf), "o_custkey", "o_orderdate", 8, 1500),
    "SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts, date_diff('day', min(o_orderdate), max(o_orderdate)) AS days FROM orders GROUP BY o_custkey HAVING count(*) >= 8 AND date_diff('day', min(o_orderdate), max(o_orderdate)) >= 1500",
)
QUERIES["lag_features"] = (
    lambda spark, sf: ev(spark, sf).select("event_id", *[X.lag("value", k, BY, ORDER).alias(f"lag_{k}") for k in (1, 3)], X.lag("value", -1, BY, ORDER).alias("lead_1")),
    f"SELECT event_id, lag(value, 1) OVER w AS lag_1, lag(value, 3) OVER w AS lag_3, lead(value, 1) OVER w AS lead_1 FROM events WINDOW w AS ({W})",
)
QUERIES["forward_mean_label"] = (
    lambda spark, sf: ev(spark, sf).select("event_id", r6(X.forward_mean("value", 4, BY, ORDER)).alias("label")),
    f"SELECT event_id, round(CASE WHEN count(value) OVER w = 4 THEN avg(value) OVER w END, 6) AS label FROM events WINDOW w AS ({W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)",
)
QUERIES["rolling_features"] = (
    lambda spark, sf: ev(spark, sf).select("event_id", *[r6(X.rolling("value", 5, how, BY, ORDER)).alias(how) for how in ("mean", "std", "sum")]),
    f"SELECT event_id, round(CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END, 6) AS mean, round(CASE WHEN count(value) OVER w = 5 THEN stddev_samp(value) OVER w END, 6) AS std, round(CASE WHEN count(value) OVER w = 5 THEN sum(value) OVER w END, 6) AS sum FROM events WINDOW w AS ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)",
)
QUERIES["rolling_zscore"] = (
    lambda spark, sf: ev(spark, sf).select("event_id", r6(X.rolling_zscore("value", 10, BY, ORDER)).alias("z")),
    f"SELECT event_id, round(CASE WHEN count(value) OVER w = 10 AND stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END, 6) + 0.0 AS z FROM events WINDOW w AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
)
QUERIES["log_returns"] = (
    lambda spark, sf: od(spark, sf).select("o_orderkey", *[r6(X.log_return("o_totalprice", k, ["o_custkey"], ["o_orderdate", "o_orderkey"])).alias(f"r{k}") for k in (1, 2)]),
    "SELECT o_orderkey, round(ln(o_totalprice / lag(o_totalprice, 1) OVER w), 6) + 0.0 AS r1, round(ln(o_totalprice / lag(o_totalprice, 2) OVER w), 6) + 0.0 AS r2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
QUERIES["cumulative_clock"] = (
    lambda spark, sf: ev(spark, sf).select("event_id", r6(X.cumulative("value", BY, ORDER)).alias("total"), (F.row_number().over(Window.partitionBy(*BY).orderBy(*ORDER)) - 1).cast("bigint").alias("clock")),
    f"SELECT event_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS total, row_number() OVER w - 1 AS clock FROM events WINDOW w AS ({W})".replace("OVER (w ROWS", f"OVER ({W} ROWS"),
)


def micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


QUERIES["median_bar"] = (
    lambda spark, sf: ev(spark, sf).select("user_id", (micros() - F.lag(micros()).over(Window.partitionBy(*BY).orderBy(*ORDER))).alias("d")).where("d IS NOT NULL").groupBy("user_id").agg(F.percentile("d", F.lit(0.5)).alias("median_us")),
    f"SELECT user_id, CAST(quantile_cont(d, 0.5) AS DOUBLE) AS median_us FROM (SELECT user_id, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER ({W}) AS DOUBLE) AS d FROM events) WHERE d IS NOT NULL GROUP BY user_id",
)
QUERIES["daily_resample"] = (
    lambda spark, sf: X.resample(ev(spark, sf), "ts", "day", "value", "mean", ["event_type"]).select("event_type", "day", r6("value")),
    "SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, round(avg(value), 6) AS value FROM events GROUP BY ALL",
)
QUERIES["calendar_features"] = (
    lambda spark, sf: ev(spark, sf).select("event_id", *[c.cast("bigint").alias(k) for k, c in X.calendar("ts").items()]),
    "SELECT event_id, hour(ts) * 2 + minute(ts) // 30 AS hh, isodow(ts) - 1 AS dow, (CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END)::BIGINT AS weekend FROM events",
)


QUERIES["pivot_mean"] = (
    lambda spark, sf: (lambda d: d.select("user_id", *[r6(c) for c in d.columns[1:]]))(X.pivot_mean(ev(spark, sf), ["user_id"], "event_type", ["click", "view", "purchase"], "value")),
    "SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 6) + 0.0 AS {t}" for t in ("click", "view", "purchase")) + " FROM events GROUP BY user_id",
)
QUERIES["join_outcomes"] = (
    lambda spark, sf: table(spark, sf, "customer").join(od(spark, sf).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("largest"), F.count("*").alias("n")), "c_custkey").select("c_custkey", "largest", "n"),
    "SELECT c_custkey, largest, n FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS largest, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
)


def _double(spark, sf):
    n = table(spark, sf, "nation")
    stat = lambda t, k, v, a: table(spark, sf, t).groupBy(F.col(k).alias("n_nationkey")).agg(r6(F.avg(v)).alias(a))
    return n.select("n_nationkey").join(stat("customer", "c_nationkey", "c_acctbal", "buyers"), "n_nationkey", "left").join(stat("supplier", "s_nationkey", "s_acctbal", "sellers"), "n_nationkey", "left")


QUERIES["double_left_join"] = (
    _double,
    "SELECT n_nationkey, buyers, sellers FROM nation LEFT JOIN (SELECT c_nationkey, round(avg(c_acctbal), 6) + 0.0 AS buyers FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, round(avg(s_acctbal), 6) + 0.0 AS sellers FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey",
)
QUERIES["role_union"] = (
    lambda spark, sf: table(spark, sf, "customer")
    .select(F.col("c_nationkey").alias("nation"), F.lit("buyer").alias("role"), F.col("c_acctbal").alias("balance"))
    .unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("seller").alias("role"), F.col("s_acctbal").alias("balance")))
    .groupBy("nation", "role").agg(F.count("*").alias("n"), r6(F.sum("balance")).alias("balance")),
    "SELECT nation, role, count(*) AS n, round(sum(balance), 6) + 0.0 AS balance FROM (SELECT c_nationkey AS nation, 'buyer' AS role, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, 'seller', s_acctbal FROM supplier) GROUP BY ALL",
)
QUERIES["remaining_life"] = (
    lambda spark, sf: table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.max("l_linenumber").over(Window.partitionBy("l_orderkey")) - F.col("l_linenumber")).cast("bigint").alias("left")),
    'SELECT l_orderkey, l_linenumber, (max(l_linenumber) OVER (PARTITION BY l_orderkey) - l_linenumber)::BIGINT AS "left" FROM lineitem',
)


def holes():
    return F.when(F.col("event_id") % 4 != 0, F.col("value"))


def _ffill(spark, sf):
    e = ev(spark, sf).withColumn("v", F.when(F.col("user_id") % 10 != 0, holes()))
    median = e.agg(F.percentile("v", F.lit(0.5)).alias("median"))
    return e.withColumn("f", X.fill("v", BY, ORDER)).join(F.broadcast(median), F.lit(True)).select("event_id", r6(F.coalesce("f", "median")).alias("v"))  # one row


QUERIES["ffill_median"] = (
    _ffill,
    f"""WITH e AS (SELECT *, CASE WHEN user_id % 10 <> 0 AND event_id % 4 <> 0 THEN value END AS v FROM events), m AS (SELECT quantile_cont(v, 0.5) AS median FROM e)
SELECT event_id, round(coalesce(last_value(v IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), median), 6) + 0.0 AS v FROM e, m""",
)
QUERIES["interpolate"] = (
    lambda spark, sf: ev(spark, sf).withColumn("v", holes()).select("event_id", r6(X.interpolated("v", BY, ORDER)).alias("v")),
    f"""WITH e AS (SELECT *, CASE WHEN event_id % 4 <> 0 THEN value END AS v, row_number() OVER ({W}) AS i FROM events), n AS (SELECT *, CASE WHEN v IS NOT NULL THEN i END AS k FROM e),
a AS (SELECT *, max(k) OVER ({W} ROWS UNBOUNDED PRECEDING) AS i0, min(k) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM n)
SELECT a.event_id, round(CASE WHEN a.v IS NOT NULL THEN a.v WHEN i1 IS NULL THEN x.v ELSE x.v + (y.v - x.v) * (a.i - i0) / (i1 - i0) END, 6) + 0.0 AS v FROM a LEFT JOIN e x ON x.user_id = a.user_id AND x.i = a.i0 LEFT JOIN e y ON y.user_id = a.user_id AND y.i = a.i1""",
)
QUERIES["holdout_boundary"] = (
    lambda spark, sf: (lambda s: s.where(F.col("e") < F.lit("2024-01-25").cast("timestamp_ntz")).select("pos"))(events(spark, sf)),
    f"WITH {S} SELECT pos FROM s WHERE e < TIMESTAMP '2024-01-25'",
)
QUERIES["causal_target_mean"] = (
    lambda spark, sf: X.causal_target_mean(ev(spark, sf).withColumn("day", F.to_date("ts")), "user_id", "day", "value", F.lit(50.0)).select("event_id", F.round("encoded", 9).alias("encoded")),
    "WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events) SELECT event_id, round(coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 50.0), 9) AS encoded FROM e",
)


def _forecast(spark, sf):
    """Five purged folds with each fold's training mean by event type as the forecast."""
    s = folds.PurgedKFold(5, purge_horizon="1h").stages(events(spark, sf, "event_type", "value"))
    fit = s.where("is_final").groupBy("fold", "event_type").agg(F.avg("value").alias("f"))
    return s.where("is_test").join(fit, ["fold", "event_type"]).select("fold", "pos", F.col("value").alias("y"), "f")


FORECAST = f"{stages_sql(5, masks(5), 1)}, fit AS (SELECT fold, event_type, avg(y) AS f FROM st WHERE is_candidate AND NOT is_purged GROUP BY ALL), fc AS (SELECT st.fold, pos, y, f FROM st JOIN fit ON fit.fold = st.fold AND fit.event_type = st.event_type WHERE is_test)"
QUERIES["wape"] = (lambda spark, sf: _forecast(spark, sf).agg(r6(X.errors("y", "f")["wape"]).alias("wape")), f"WITH {FORECAST} SELECT round(sum(abs(y - f)) / sum(abs(y)), 6) AS wape FROM fc")
QUERIES["fold_metrics"] = (
    lambda spark, sf: _forecast(spark, sf).groupBy(F.col("fold").cast("bigint").alias("fold")).agg(*[r6(c).alias(k) for k, c in X.errors("y", "f").items()]),
    f"WITH {FORECAST} SELECT CAST(fold AS BIGINT) AS fold, round(avg(abs(y - f)), 6) AS mae, round(sum(abs(y - f)) / sum(abs(y)), 6) AS wape, round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(y)), 6) + 0.0 AS r2 FROM fc GROUP BY fold",
)
QUERIES["auc"] = (
    lambda spark, sf: X.auc(od(spark, sf).select("o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.round("o_totalprice", -3).alias("s")), "y", "s", "o_orderpriority").select("o_orderpriority", r6("auc")),
    "WITH o AS (SELECT o_orderpriority, (o_orderstatus = 'F')::INT AS y, round(o_totalprice, -3) AS s FROM orders), r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY s) + (count(*) OVER (PARTITION BY o_orderpriority, s) - 1) / 2 AS k FROM o) SELECT o_orderpriority, round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / sum(y) / (count(*) - sum(y)), 6) AS auc FROM r GROUP BY o_orderpriority",
)
QUERIES["log_loss"] = (
    lambda spark, sf: od(spark, sf).groupBy("o_orderpriority").agg(r6(X.log_loss((F.col("o_orderstatus") == "F").cast("double"), F.lit(0.48))).alias("loss")),
    "SELECT o_orderpriority, round(-avg(CASE WHEN o_orderstatus = 'F' THEN ln(0.48) ELSE ln(0.52) END), 6) AS loss FROM orders GROUP BY o_orderpriority",
)
QUERIES["accuracy"] = (
    lambda spark, sf: _forecast(spark, sf).groupBy(F.col("fold").cast("bigint").alias("fold")).agg(r6(F.avg(((F.col("y") > 50) == (F.col("f") > 50)).cast("double"))).alias("accuracy")),
    f"WITH {FORECAST} SELECT CAST(fold AS BIGINT) AS fold, round(avg(((y > 50) = (f > 50))::INT), 6) AS accuracy FROM fc GROUP BY fold",
)
QUERIES["ci95"] = (
    lambda spark, sf: X.interval95(od(spark, sf).groupBy(F.month("o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("v")), "v", 2.200985160082949).select(r6("mean"), r6("low"), r6("high")),
    "WITH m AS (SELECT month(o_orderdate) AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT round(avg(v), 6) AS mean, round(avg(v) - 2.200985160082949 * stddev_samp(v) / sqrt(count(v)), 6) AS low, round(avg(v) + 2.200985160082949 * stddev_samp(v) / sqrt(count(v)), 6) AS high FROM m",
)
QUERIES["quartiles"] = (
    lambda spark, sf: ev(spark, sf).groupBy("event_type").agg(*[r6(F.percentile("value", F.lit(q))).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]),
    "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) + 0.0 AS {n}" for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))) + " FROM events GROUP BY event_type",
)


def _regret(spark, sf):
    """Choose the rolling window with the least error on the first four fifths; its regret on the last fifth."""
    e = events(spark, sf, "value")
    n = e.count()
    errors = e.select("pos", *[F.abs(F.col("value") - X.rolling("value", k, "mean", ["g"], ["pos"])).alias(f"w{k}") for k in (2, 5, 10)]).dropna()
    long = errors.select((F.col("pos") >= int(n * 0.8)).alias("late"), F.stack(F.lit(3), *[x for k in (2, 5, 10) for x in (F.lit(k), F.col(f"w{k}"))]).alias("w", "err"))
    m = long.groupBy("w").agg(F.avg(F.when(~F.col("late"), F.col("err"))).alias("cv"), F.avg(F.when(F.col("late"), F.col("err"))).alias("deploy"))
    return m.agg(F.min_by("w", "cv").cast("bigint").alias("chosen"), r6(F.min_by("deploy", "cv") - F.min("deploy")).alias("regret"))


QUERIES["selection_regret"] = (
    _regret,
    f"WITH {S}, e AS (SELECT pos, n, "
    + ", ".join(f"CASE WHEN count(y) OVER (PARTITION BY g ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) = {k} THEN abs(y - avg(y) OVER (PARTITION BY g ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)) END AS w{k}" for k in (2, 5, 10))
    + " FROM s, n), d AS (SELECT * FROM e WHERE w2 IS NOT NULL AND w5 IS NOT NULL AND w10 IS NOT NULL), l AS ("
    + " UNION ALL ".join(f"SELECT {k} AS w, pos >= floor(n * 0.8) AS late, w{k} AS err FROM d" for k in (2, 5, 10))
    + "), m AS (SELECT w, avg(err) FILTER (NOT late) AS cv, avg(err) FILTER (late) AS deploy FROM l GROUP BY w) SELECT arg_min(w, cv)::BIGINT AS chosen, round(arg_min(deploy, cv) - min(deploy), 6) + 0.0 AS regret FROM m",
)
QUERIES["sign_strategy"] = (
    lambda spark, sf: _forecast(spark, sf).groupBy(F.col("fold").cast("bigint").alias("fold")).agg(r6(F.sum(F.signum(F.col("f") - 50) * (F.col("y") - 50))).alias("gain")),
    f"WITH {FORECAST} SELECT CAST(fold AS BIGINT) AS fold, round(sum(sign(f - 50) * (y - 50)), 6) + 0.0 AS gain FROM fc GROUP BY fold",
)
QUERIES["every_hth"] = (lambda spark, sf: events(spark, sf).where("pos % 12 = 0").select("pos", "p"), f"WITH {S} SELECT pos, p FROM s WHERE pos % 12 = 0")
QUERIES["first_per_entity"] = (
    lambda spark, sf: ev(spark, sf).groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event")),
    f"SELECT user_id, event_id AS first_event FROM (SELECT *, row_number() OVER ({W}) AS k FROM events) WHERE k = 1",
)
def _staggered(spark, sf):
    """All orders, a minute apart and their lines a second apart: times stay in range, and no task holds all rows."""
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    rank = with_positions(x.select("l_orderkey").distinct(), ["l_orderkey"], "rank")
    at = F.lit("2020-01-01").cast("timestamp_ntz") + F.col("rank") * F.expr("INTERVAL 1 MINUTE") + F.col("l_linenumber") * F.expr("INTERVAL 1 SECOND")
    return x.join(rank, "l_orderkey").select("l_orderkey", "l_linenumber", at.alias("at"))


QUERIES["staggered_times"] = (
    _staggered,
    "SELECT l_orderkey, l_linenumber, TIMESTAMP '2020-01-01' + to_minutes(dense_rank() OVER (ORDER BY l_orderkey) - 1) + to_seconds(l_linenumber) AS at FROM lineitem",
)
QUERIES["staggered_times_whole"] = (_staggered, None)
QUERIES["cluster_bootstrap"] = (lambda spark, sf: X.cluster_bootstrap(ev(spark, sf), "user_id", "value", 200), None)
