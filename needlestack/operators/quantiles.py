"""Exact medians of many columns at once, with bounded memory per task.

The built-in exact percentile keeps one hash-map entry per distinct value, which
does not fit a column of billions of distinct doubles. A mergeable sketch first
brackets the middle ranks, the values outside the bracket are counted exactly,
and the rest is narrowed until its distinct values fit. Every step is one
aggregation with map-side combine: no shuffle of rows, nothing but counters on
the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Values one exact percentile may hold in memory; dozens of them share a task.
DISTINCT_LIMIT = 20_000
ACCURACY = 10_000


def _number(names):
    return {n: i for i, n in enumerate(names)}


def exact_medians(df: DataFrame, exprs: Mapping[str, Column],
                  distinct_limit: int = DISTINCT_LIMIT,
                  accuracy: int = ACCURACY) -> dict[str, float | None]:
    """Median of each expression over its non-NULL values (mean of the middle two)."""
    names = list(exprs)
    if not names:
        return {}
    pos = _number(names)
    stats = df.agg(
        *[F.count(exprs[n]).alias(f"n{pos[n]}") for n in names],
        *[F.approx_count_distinct(exprs[n]).alias(f"d{pos[n]}") for n in names],
    ).first()
    total = {n: stats[f"n{pos[n]}"] for n in names}
    small = [n for n in names if stats[f"d{pos[n]}"] <= distinct_limit]
    wide = [n for n in names if n not in set(small)]

    result: dict[str, float | None] = {}
    if small:
        row = df.agg(*[F.median(exprs[n]).alias(f"m{pos[n]}") for n in small]).first()
        result.update({n: row[f"m{pos[n]}"] for n in small})
    if wide:
        result.update(_bracketed(df, {n: exprs[n] for n in wide}, total, distinct_limit, accuracy))
    return result


def _bracketed(df, exprs, total, distinct_limit, accuracy):
    """Narrow [lo, hi] around ranks (n-1)//2 and n//2 until its distinct values fit."""
    inside = dict(exprs)                       # expression restricted to the bracket
    below = {n: 0 for n in exprs}              # exact count of values under the bracket
    held = dict(total)                         # exact count of values in the bracket
    widen = dict.fromkeys(exprs, 1.0)          # grows if a bracket ever misses
    todo, result = list(exprs), {}
    while todo:
        pos = _number(todo)
        aggs = []
        for n in todo:
            lo_rank, hi_rank = (total[n] - 1) // 2 - below[n], total[n] // 2 - below[n]
            slack = widen[n] * (2.0 / accuracy + 1.0 / held[n])
            p_lo = max(0.0, (lo_rank + 1) / held[n] - slack)
            p_hi = min(1.0, (hi_rank + 1) / held[n] + slack)
            aggs.append(F.percentile_approx(inside[n], [p_lo, p_hi], accuracy).alias(f"q{pos[n]}"))
        cuts = df.agg(*aggs).first()
        ends = {n: (cuts[f"q{pos[n]}"][0], cuts[f"q{pos[n]}"][1]) for n in todo}

        aggs = []
        for n in todo:
            x, (lo, hi) = exprs[n], ends[n]
            aggs += [F.count_if(x < lo).alias(f"b{pos[n]}"),
                     F.count_if((x >= lo) & (x <= hi)).alias(f"h{pos[n]}"),
                     F.approx_count_distinct(F.when((x >= lo) & (x <= hi), x)).alias(f"d{pos[n]}")]
        row = df.agg(*aggs).first()

        ready = []
        for n in todo:
            b, h, (lo, hi) = row[f"b{pos[n]}"], row[f"h{pos[n]}"], ends[n]
            covered = b <= (total[n] - 1) // 2 and total[n] // 2 < b + h
            if not covered:
                widen[n] *= 4.0
                continue
            shrunk = h < held[n]
            below[n], held[n] = b, h
            x = exprs[n]
            inside[n] = F.when((x >= lo) & (x <= hi), x)
            if row[f"d{pos[n]}"] <= distinct_limit or not shrunk:
                ready.append(n)
        if ready:
            aggs = []
            for n in ready:
                last = max(held[n] - 1, 1)
                ps = [((total[n] - 1) // 2 - below[n]) / last, (total[n] // 2 - below[n]) / last]
                aggs.append(F.percentile(inside[n], [min(1.0, p) for p in ps]).alias(f"m{pos[n]}"))
            row = df.agg(*aggs).first()
            for n in ready:
                lo, hi = row[f"m{pos[n]}"]
                result[n] = (lo + hi) / 2.0
        todo = [n for n in todo if n not in set(ready)]
    return result
