"""Chat formatting over reply trees, with DataFrame operations only.

Messages of a tree point to the message that they answer. Iterative self-joins (pointer doubling) give each message
its depth, its path score and its character offset below the root in ``log2(depth)`` rounds; leaves are the branches.
Branches are ranked by score within their tree, the first ``branches`` are kept, and running the same jump tables from
the longest jump to the shortest lists every ancestor of a chosen leaf exactly once. Each chosen path becomes one row.

A turn is ``<|im_start|>role LF text<|im_end|> LF``. Inside texts and roles a backslash is doubled and ``<|`` becomes
``<\\|``; a line feed in a role becomes a backslash and ``n``. So no control string survives inside a text, and the
mapping can be undone. Spans count code points of the formatted text.

Defined cases: null text or role: empty. A parent that does not exist: the message is a root. Replies that form a
cycle: ValueError, since they hang on no root. Equal (tree, node) keys: ValueError. An empty table: no rows. Equal
branch scores: the smaller leaf first. Columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from foldwise.runtime import materialise, table

START, END = "<|im_start|>", "<|im_end|>"
MARKS = len(START) + 1 + len(END) + 1


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def reply_paths(links: DataFrame, branches: int = 1) -> DataFrame:
    """links: tree, node, parent, score double, size long. Returns (tree, leaf, branch, path_score, node, depth, before):
    the nodes of the chosen branches, with the sum of ``size`` over the nodes above."""
    n_rows = links.count()
    if links.select("tree", "node").distinct().count() != n_rows:
        raise ValueError("two messages of a tree share a key")
    known = links.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    start = materialise(
        links.join(known, links.tree.eqNullSafe(known.t) & (links.parent == known.n), "left").select("tree", "node", F.col("n").alias("up"), F.lit(1).alias("depth"), "score", "size"), "jump"
    )
    # Round k: sums over the first 2**k messages upwards. Only messages that have not met their root go on.
    whole, jumps = start.where("up IS NULL"), []
    active = start.where("up IS NOT NULL")
    while active.limit(1).count():
        if 2 ** len(jumps) > 2 * n_rows:
            raise ValueError("replies form a cycle")
        jumps.append(active)
        a, b = active.alias("a"), whole.unionByName(active).alias("b")
        ahead = materialise(
            a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node"))).select(
                "a.tree", "a.node", F.col("b.up").alias("up"), *[(F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c) for c in ("depth", "score", "size")]
            ),
            "jump",
        )
        whole, active = whole.unionByName(ahead.where("up IS NULL")), ahead.where("up IS NOT NULL")
    answered = start.where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = whole.join(answered, whole.tree.eqNullSafe(answered.t) & (whole.node == answered.n), "left_anti")
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))).where(F.col("branch") <= branches)
    paths = ranked.select("tree", F.col("node").alias("leaf"), "branch", F.col("score").alias("path_score"), "node")
    for j in reversed(jumps):
        j = j.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        above = paths.join(j, paths.tree.eqNullSafe(j.t) & (paths.node == j.n)).select("tree", "leaf", "branch", "path_score", F.col("up").alias("node"))
        paths = materialise(paths.unionByName(above), "paths")
    place = whole.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth", F.col("size").alias("upto"))
    own = links.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "size")
    out = paths.join(place, paths.tree.eqNullSafe(place.t) & (paths.node == place.n)).join(own, paths.tree.eqNullSafe(F.col("t2")) & (paths.node == F.col("n2")))
    return out.select("tree", "leaf", "branch", "path_score", "node", "depth", (F.col("upto") - F.col("size")).alias("before"))


def format_chats(messages: DataFrame, branches: int = 1, trained_role: str = "assistant") -> DataFrame:
    """messages: tree, node, parent, role, text, score. One row a chosen branch: tree, leaf, branch, path_score, n_turns,
    formatted, and turns: for each turn the span of its escaped text in ``formatted`` and whether the loss covers it."""
    m = messages.select("tree", "node", "parent", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = materialise(m.withColumn("size", (F.length("role") + F.length("text") + MARKS).cast("bigint")), "messages")
    chosen = reply_paths(m.select("tree", "node", "parent", "score", "size"), branches)
    body = m.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turn = F.struct(
        "depth",
        F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n")).alias("segment"),
        (F.col("before") + len(START) + F.length("role") + 1).alias("start"),
        F.length("text").cast("bigint").alias("length"),
        (F.col("role") == escape_role(F.lit(trained_role))).alias("loss"),
    )
    joined = chosen.join(body, chosen.tree.eqNullSafe(body.t) & (chosen.node == body.n))
    rows = joined.groupBy("tree", "leaf", "branch", "path_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select(
        "tree", "leaf", "branch", "path_score", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"), t["loss"].alias("loss"))).alias("turns"),
    )


def read_back(formatted: Column, turns: Column) -> Column:
    """array<struct<role, text, loss>> out of formatted text alone (role, text) and its loss mask."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.size(turns))

    def turn(part: Column, span: Column) -> Column:
        head = F.instr(part, "\n")
        body = part.substr(head + 1, F.length(part) - head - len(END) - 1)
        return F.struct(
            unescape_role(part.substr(F.lit(1), head - 1)).alias("role"),
            unescape(body).alias("text"),
            F.when(span["loss"], unescape(part.substr(head + 1, span["length"].cast("int")))).alias("loss"),
        )

    return F.zip_with(parts, turns, turn)


EXTRA = f"{END}{START}assistant ok"


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as reply chains (each row answers the one before it by turn, then role and text), with conversation -1."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("tree"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", EXTRA), (-1, 1, "assistant", EXTRA)], "tree bigint, turn bigint, role string, text string")
    # A conversation becomes one row of the result, so it fits a task here too.
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.unionByName(extra).withColumn("node", F.row_number().over(order).cast("bigint"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = format_chats(conversation_messages(spark, sf_dir))
    read = chats.withColumn("read", read_back(F.col("formatted"), F.col("turns")))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("read", lambda t: t["loss"].isNotNull()), lambda t: t["loss"]), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("read").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{EXTRA}'), (-1, 1, 'assistant', '{EXTRA}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({MARKS} + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n')) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""
