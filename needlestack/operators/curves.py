"""ROC, precision-recall and F1 curves, their areas and their means over folds.

Rows first collapse to one per distinct score, so a score shared by a third of all
rows costs one row. A score step then knows the point before it (totals minus its
own counts), so segments need no second window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import materialize
from .metrics import _agg
from .ordered import ROWS_PER_BUCKET, order_splits, running, with_bucket


def score_steps(df: DataFrame, label: str, p: str, by: Sequence[str] = (),
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per (by, distinct score): pos, neg, and tp, fp counted at score >= threshold."""
    by = list(by)
    rows = df.where(F.col(p).isNotNull() & F.col(label).isNotNull()).select(
        *by, F.col(p).cast("double").alias("threshold"), (F.col(label) == 1).alias("__y"))
    splits = order_splits(rows, "threshold", rows_per_bucket)
    steps = (
        with_bucket(rows, "threshold", splits)
        .groupBy(*by, "bucket", "threshold")
        .agg(F.count_if("__y").alias("pos"), F.count_if(~F.col("__y")).alias("neg"))
    )
    # Totals and running sums both read the steps, so rows are grouped once.
    return _run(materialize(steps, "steps"), by)


def steps_of_counts(counts: DataFrame, by: Sequence[str] = (),
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """`score_steps` of scores that are counted already: one row per (by, threshold) with pos and neg."""
    return _run(with_bucket(counts, "threshold", order_splits(counts, "threshold", rows_per_bucket)), list(by))


def _run(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    out = running(steps, by, "threshold", sums=["pos", "neg"], descending=True)
    return out.select(*by, "threshold", "pos", "neg", F.col("run_pos").alias("tp"),
                      F.col("run_neg").alias("fp"), F.col("all_pos").alias("n_pos"),
                      F.col("all_neg").alias("n_neg"))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def _precision_before() -> Column:
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    return F.when(tp + fp == 0, F.lit(1.0)).otherwise(_ratio(tp, tp + fp))


def _precision_here() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def roc_curve(df, label, p, by=(), **kw) -> DataFrame:
    s = score_steps(df, label, p, by, **kw)
    return s.select(*by, "threshold", "tp", "fp", _ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
                    _ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))


def pr_curve(df, label, p, by=(), **kw) -> DataFrame:
    """Precision and recall of `score >= threshold` at every distinct score."""
    s = score_steps(df, label, p, by, **kw)
    return s.select(*by, "threshold", "tp", "fp", _precision_here().alias("precision"),
                    _ratio(F.col("tp"), F.col("n_pos")).alias("recall"))


def roc_auc(df, label, p, by=(), **kw) -> DataFrame:
    """Tie-aware rank-sum area: each negative counts the positives above it, ties half."""
    return auc_of_steps(score_steps(df, label, p, by, **kw), by)


def auc_of_steps(s: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    won = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    pairs = F.max("n_pos").cast("double") * F.max("n_neg")
    return _agg(s, by, F.try_divide(F.sum(won), pairs).alias("roc_auc"))


def average_precision(df, label, p, by=(), mode: str = "step", **kw) -> DataFrame:
    """Area under precision-recall: `step` sums precision over recall gains, `trapezoid`
    joins the points linearly from (recall 0, precision 1)."""
    return precision_of_steps(score_steps(df, label, p, by, **kw), by, mode)


def precision_of_steps(s: DataFrame, by: Sequence[str] = (), mode: str = "step") -> DataFrame:
    if mode == "step":
        height = _precision_here()
    elif mode == "trapezoid":
        height = (_precision_here() + _precision_before()) / 2.0
    else:
        raise ValueError(f"unknown mode {mode!r}")
    area = F.try_divide(F.sum(F.col("pos") * height), F.max("n_pos"))
    return _agg(s, by, area.alias("average_precision"))


def mean_curve(oof: DataFrame, kind: str, label: str, p: str, fold: str = "fold",
               by: Sequence[str] = (), grid: int = 100, **kw) -> DataFrame:
    """Per-fold curves interpolated on an even grid and averaged over folds.

    Each score step is a segment of its fold's curve and emits only the grid points it
    covers, so a fold yields exactly `grid` rows. ROC is pinned to (0,0) and (1,1),
    precision-recall to (0,1) and (1,0).
    """
    by = list(by)
    s = score_steps(oof, label, p, [*by, fold], **kw)
    steps = grid - 1
    if kind == "roc":
        gain, at, total = F.col("neg"), F.col("fp"), F.col("n_neg")
        y0 = _ratio(F.col("tp") - F.col("pos"), F.col("n_pos"))
        y1 = _ratio(F.col("tp"), F.col("n_pos"))
        first, last = 0.0, 1.0
    elif kind == "pr":
        gain, at, total = F.col("pos"), F.col("tp"), F.col("n_pos")
        y0, y1 = _precision_before(), _precision_here()
        first, last = 1.0, 0.0
    else:
        raise ValueError(f"unknown kind {kind!r}")
    seg = s.where(gain > 0).select(
        *by, fold, (at - gain).alias("a"), at.alias("b"), total.alias("n"),
        y0.alias("y0"), y1.alias("y1"))
    lo = F.expr(f"({steps} * a + n - 1) div n")
    hi = F.expr(f"CASE WHEN b = n THEN {steps} ELSE ({steps} * b + n - 1) div n - 1 END")
    pts = seg.where(lo <= hi).withColumn("i", F.explode(F.sequence(lo, hi)))
    at_grid = (F.col("i") * F.col("n") / F.lit(float(steps)) - F.col("a")) / (F.col("b") - F.col("a"))
    y = F.col("y0") + (F.col("y1") - F.col("y0")) * at_grid
    mean = pts.groupBy(*by, "i").agg(F.avg(y).alias("y"))
    pinned = F.when(F.col("i") == 0, F.lit(first)).when(F.col("i") == steps, F.lit(last))
    return mean.select(*by, F.col("i").cast("int").alias("i"),
                       (F.col("i") / F.lit(float(steps))).alias("x"),
                       pinned.otherwise(F.col("y")).alias("y"))


def curve_area(curve: DataFrame, by: Sequence[str] = (), grid: int = 100) -> DataFrame:
    """Trapezoid area under an even-grid curve; inner points count fully, ends half."""
    end = F.col("i").isin(0, grid - 1)
    share = F.when(end, F.col("y") / 2.0).otherwise(F.col("y"))
    return _agg(curve, by, (F.sum(share) / F.lit(float(grid - 1))).alias("area"))


def fold_best_f1(oof: DataFrame, label: str, p: str, fold: str = "fold", by: Sequence[str] = (),
                 **kw) -> DataFrame:
    """Per fold, the smallest score t that maximises F1 of `score > t`."""
    s = score_steps(oof, label, p, [*by, fold], **kw)
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    f1 = F.coalesce(_ratio(2 * tp, tp + fp + F.col("n_pos")), F.lit(0.0))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("t")))
    return s.groupBy(*by, fold).agg(best.alias("b")).select(
        *by, fold, (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def best_f1_threshold(oof: DataFrame, label: str, p: str, fold: str = "fold", **kw) -> DataFrame:
    """Mean of the per-fold best thresholds and the pooled scores of `score > mean`."""
    best = fold_best_f1(oof, label, p, fold, **kw).agg(F.avg("threshold").alias("t"))
    t = best.first()["t"]
    hit, y = F.col(p) > F.lit(t), F.col(label) == 1
    cm = oof.where(F.col(p).isNotNull()).agg(
        F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"), F.count_if(y & hit).alias("tp"))
    from .metrics import prf
    return prf(cm).withColumn("threshold", F.lit(t))
