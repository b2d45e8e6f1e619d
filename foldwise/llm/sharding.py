"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table: start at an offset and step by a
skip, both from a hash of its name. Shards take turns; at its turn a shard claims its first free slot. A shard of
weight w claims w slots a turn. Placement is ``table[hash(key) mod size]``, one lookup a row. The table has ``size``
entries whatever the data, so it may always be broadcast. Taking a shard away moves few keys of the others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

TABLE_SIZE = 4099
SHARDS = tuple(f"shard-{i:03d}" for i in range(32))


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:12], 16)


def preferences(name: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's order of preference."""
    return _number(name, "offset") % size, _number(name, "skip") % (size - 1) + 1


def lookup_table(shards: list[str] | tuple[str, ...], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """The filled table: for each slot the index of its shard. ``size`` must be a prime, not under the number of shards."""
    if size < 3 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError(f"table size {size} is not a prime over 2")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one, and no more than the slots")
    weights = weights or {}
    if any(weights.get(s, 1) < 1 for s in shards):
        raise ValueError("weights start at 1")
    prefs = [preferences(s, size) for s in shards]
    table, nxt, free = [-1] * size, [0] * len(shards), size
    while free:
        for i, name in enumerate(shards):
            offset, skip = prefs[i]
            for _ in range(min(weights.get(name, 1), free)):
                while table[slot := (offset + nxt[i] * skip) % size] >= 0:
                    nxt[i] += 1
                table[slot] = i
                nxt[i] += 1
                free -= 1
    return table


def slot_of(key: F.Column, size: int):
    """First 48 bits of the MD5 of the key as text, modulo the table's size. A null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % F.lit(size)).cast("bigint")


def place(df: DataFrame, key: str, shards=SHARDS, size: int = TABLE_SIZE, weights=None) -> DataFrame:
    """``df`` with ``slot`` and ``shard``. Rows of equal keys get the same shard; null keys one shard as well; an
    empty table stays empty; columns of ``df`` with these two names are replaced."""
    names = list(shards)
    table = df.sparkSession.createDataFrame([(i, names[s]) for i, s in enumerate(lookup_table(names, size, weights))], "slot bigint, shard string")
    rest = [c for c in df.columns if c not in ("slot", "shard")]
    return df.select(*[F.col(f"`{c}`") for c in rest], slot_of(F.col(f"`{key}`"), size).alias("slot")).join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in rest], "slot", "shard")


def write_shards(df: DataFrame, key: str, path: str, shards=SHARDS, size: int = TABLE_SIZE, files_per_shard: int = 8) -> None:
    """One folder a shard. A shard's rows are dealt over ``files_per_shard`` tasks, so none takes a whole shard."""
    placed = place(df, key, shards, size)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)


def oracle(shards=SHARDS, size: int = TABLE_SIZE) -> str:
    """The same fill and placement in DuckDB SQL: one recursion step a claim."""
    prefs = ", ".join(f"({i}, '{s}', {o}, {k})" for i, s in enumerate(shards) for o, k in [preferences(s, size)])
    n = len(shards)
    return f"""
WITH RECURSIVE prefs(i, shard, o, k) AS (VALUES {prefs}),
fill(step, slot, tab) AS (
  SELECT -1, -1, list_transform(range({size}), lambda x: -1)
  UNION ALL
  SELECT step + 1, pick, list_concat(list_concat(tab[1:pick], [(step + 1) % {n}]), tab[pick + 2:])
  FROM (SELECT f.step, f.tab, list_filter(list_transform(range({size}), lambda x: (p.o + x * p.k) % {size}), lambda s: f.tab[s + 1] = -1)[1] AS pick
        FROM fill f JOIN prefs p ON p.i = (f.step + 1) % {n} WHERE f.step < {size} - 1))
SELECT d.doc_id, d.slot, p.shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT % {size} AS slot FROM documents) d
JOIN fill f ON f.slot = d.slot JOIN prefs p ON p.i = f.step % {n}"""
