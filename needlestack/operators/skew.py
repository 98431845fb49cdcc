"""Equi-join on a key whose hot values are known, without a hot task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

HOT_SHARE = 512


def _null_safe(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which a NULL key meets a NULL key; the keys come first, as in a join on their names."""
    named = {c: f"__j{i}" for i, c in enumerate(keys)}
    match = F.lit(True)
    for c, other in named.items():
        match = match & F.col(c).eqNullSafe(F.col(other))
    joined = rows.join(table.withColumnsRenamed(named), match, how).drop(*named.values())
    return joined.select(*keys, *[c for c in joined.columns if c not in named])


def join_counted(big: DataFrame, table: DataFrame, keys: Sequence[str], is_hot: Column,
                 payload: Sequence[str]) -> DataFrame:
    """Inner join of many rows to a table with one row per key.

    `is_hot` marks the keys that hold at least 1/HOT_SHARE of their group's rows.
    There can be at most HOT_SHARE of those per group, which bounds the broadcast;
    all other keys are light and go through an ordinary shuffle join. NULL is a key as well.
    """
    keys, is_hot = list(keys), F.coalesce(is_hot, F.lit(False))
    hot = table.where(is_hot).select(*keys, *payload, F.lit(True).alias("__hot"))
    cold = table.where(~is_hot).select(*keys, *payload)
    marked = _null_safe(big, F.broadcast(hot), keys, "left")
    done = marked.where(F.col("__hot")).drop("__hot")
    rest = _null_safe(marked.where(F.col("__hot").isNull()).drop("__hot", *payload), cold, keys)
    return done.unionByName(rest)


SMALL_ROWS = 100_000
SALTS = 32


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str],
               limit: int = SMALL_ROWS) -> DataFrame:
    """Inner join to a per-group table, where a few groups may hold most rows of `big`.

    Up to `limit` groups (counted first) the table is broadcast and `big` never moves.
    Beyond it the table is copied once per salt and `big` spreads each group over salts.
    A NULL key is a group as well.
    """
    keys = list(keys)
    if small.limit(limit + 1).count() <= limit:
        return _null_safe(big, F.broadcast(small), keys)
    salted = big.withColumn("__s", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)))
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    copies = small.withColumn("__s", F.explode(salts))
    return _null_safe(salted, copies, [*keys, "__s"]).drop("__s")
