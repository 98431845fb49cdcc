"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a cap: its size times the number of epochs it may be
repeated. The mix shares its budget by weight; a source above its cap is clamped
there and the excess is shared again by weight until none is above. A source then
gives whole repetitions to all its documents and the fraction that is left to the
first documents of a seeded order.

Nulls, ties and the rest: a null text has size 0, a null source is a source of its own
that sorts last; rows equal in id, source and text get the same number of copies;
documents without words are taken 0 words; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.skew import join_small
from ..sources.scratch import materialize
from .text import row_key

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def positions(df: DataFrame, *order: Column, out: str = "position") -> DataFrame:
    """0-based place of every row in a global order, with no single-task window over the rows.

    The sort deals the rows to partitions in order, so a row's place is its place inside
    the partition plus the sizes of the partitions before.
    """
    placed = materialize(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "order")
    placed = placed.withColumn("__p", F.shiftright("__m", 33))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select(
        "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return placed.join(F.broadcast(parts), "__p").select(
        *df.columns, (F.col("__m").bitwiseAND((1 << 33) - 1) + F.col("__o")).alias(out))


def fill_level(sources: DataFrame, budget: float) -> float | None:
    """The level at which the capped shares weight * level add up to the budget.

    Each round shares what the clamped sources leave among the rest; the level only
    rises, so a clamped source stays clamped. Only three sums per round reach the driver.
    None: every source is at its cap.
    """
    level = 0.0
    while True:
        clamped = F.col("cap") <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(clamped, F.col("cap")).otherwise(0)).alias("cap"),
            F.sum(F.when(~clamped, F.col("weight")).otherwise(0)).alias("weight")).first()
        if not row["weight"]:
            return None
        raised = (budget - row["cap"]) / row["weight"]
        if raised <= level:
            return level
        level = raised


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        seed: str = SEED) -> DataFrame:
    """One row per document: id, k1, k2, size, source_size, target (its source's), copies.

    Sources in code point order (null last) get the weights in turn. `share` times all
    words is the budget. k1 and k2 identify the document for `take`.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("raw_source"),
                       F.col(text_col).cast("string").alias("text"))
    rows = rows.select(
        "id", F.col("raw_source").isNull().alias("no_source"),
        F.coalesce("raw_source", F.lit("")).alias("source"),
        word_count(F.col("text")).alias("size"),
        *row_key("id", "raw_source", "text"))
    rows = materialize(
        rows.groupBy("k1", "k2", "id", "no_source", "source", "size").agg(F.count(F.lit(1)).alias("rows")),
        "mix_sizes")

    sources = positions(
        rows.groupBy("no_source", "source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")),
        F.col("no_source"), F.col("source"))
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                        (F.pmod(F.col("position"), F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(sources.select(
        "*", turn.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap")), "mix_sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = fill_level(sources, share * total)
    target = F.col("cap").cast("double")
    if level is not None:
        target = F.least(target, F.round(F.col("weight") * F.lit(float(level)), 6))
    sources = sources.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.select("no_source", "source", "position", "source_size", "target", whole.alias("whole"))
    sources = sources.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))

    # Seeded order cut into even buckets, so that a source with most rows is many windows.
    placed = join_small(rows, sources, ["no_source", "source"]).select(
        "*", F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))).alias("h"))
    placed = placed.withColumn("bucket", F.substring("h", 1, 3)).withColumn("unit", F.col("size") * F.col("rows"))
    before = Window.partitionBy("position").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("position", "bucket").agg(F.sum("unit").alias("__n")).select(
        "position", "bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = (Window.partitionBy("position", "bucket").orderBy("h", "id", "k1", "k2")
              .rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.coalesce(F.sum("unit").over(inside), F.lit(0))
    ranked = placed.withColumn("__r", ahead).join(offsets, ["position", "bucket"])
    more = F.col("__r") + F.col("__o") + F.col("unit") / 2 < F.col("part")
    return ranked.select(
        "id", "k1", "k2", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(F.col("whole")).alias("copies"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row"))


def take(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> DataFrame:
    """The mixed table: every document as often as the plan of `mix` says."""
    key = F.struct(*row_key(F.col(id_col), F.col(source_col).cast("string"), F.col(text_col).cast("string")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k"))
    copies = plan.where("copies > 0 AND row = 1").select(F.struct("k1", "k2").alias("k"), "copies")
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.join(copies, "k").select("row", every.alias("nth")).select("row.*")
