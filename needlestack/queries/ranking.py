"""Curves, thresholds, rank and vote ensembles, and neighbour queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import catalog, curves, neighbors, split, votes
from ..operators.approximate import approximate_nearest
from ..sources import materialize
from .frames import SCORED_SQL, scored, table
from .relational import _FOLDS, _SFOLDS, _scored_folds, r6

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return register


def steps_sql(by: str = "g") -> str:
    """Score steps of a CTE `rows(by, p, y)`."""
    return f"""
s0 AS (SELECT {by}, p AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM rows GROUP BY {by}, p),
st AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
              sum(pos) OVER (PARTITION BY {by}) AS n_pos, sum(neg) OVER (PARTITION BY {by}) AS n_neg
       FROM s0 WINDOW w AS (PARTITION BY {by} ORDER BY threshold DESC))"""


_ROWS = f"WITH {SCORED_SQL}, rows AS (SELECT 1 AS g, p_price AS p, rare AS y FROM scored), {steps_sql()}"
# Few distinct scores, so every threshold carries a large tie.
_TIED = f"WITH {SCORED_SQL}, rows AS (SELECT 1 AS g, p_discount AS p, rare AS y FROM scored), {steps_sql()}"


@query(f"""{_ROWS} SELECT round(threshold, 6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp,
round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr FROM st""")
def roc_curve(spark, sf):
    return curves.roc_curve(scored(spark, sf), "rare", "p_price").select(
        r6("threshold", "threshold"), "tp", "fp", r6("fpr", "fpr"), r6("tpr", "tpr"))


@query(f"""{_ROWS} SELECT round(threshold, 6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp,
round(tp / (tp + fp), 6) AS precision, round(tp / n_pos, 6) AS recall FROM st""")
def pr_curve(spark, sf):
    return curves.pr_curve(scored(spark, sf), "rare", "p_price").select(
        r6("threshold", "threshold"), "tp", "fp", r6("precision", "precision"), r6("recall", "recall"))


_AUC = "round(sum(neg * (tp - pos / 2)) / max(n_pos) / max(n_neg), 6) AS roc_auc"


@query(f"{_TIED} SELECT {_AUC} FROM st")
def roc_auc(spark, sf):
    return curves.roc_auc(scored(spark, sf), "rare", "p_discount").select(r6("roc_auc", "roc_auc"))


@query(f"""{_TIED} SELECT round(sum(pos * tp / (tp + fp)) / max(n_pos), 6) AS step,
round(sum(pos * (tp / (tp + fp) + CASE WHEN tp + fp = pos + neg THEN 1
      ELSE (tp - pos) / (tp + fp - pos - neg) END) / 2) / max(n_pos), 6) AS trapezoid FROM st""")
def average_precision(spark, sf):
    s = scored(spark, sf)
    step = curves.average_precision(s, "rare", "p_discount")
    trap = curves.average_precision(s, "rare", "p_discount", mode="trapezoid")
    return step.select(r6("average_precision", "step"), r6(trap.scalar(), "trapezoid"))


_FROWS = f"""WITH {SCORED_SQL}, {_SFOLDS},
rows AS (SELECT fold, p_price AS p, rare AS y FROM folds), {steps_sql("fold")}"""


@query(f"""{_FROWS}, a AS (SELECT fold, sum(neg * (tp - pos / 2)) / max(n_pos) / max(n_neg) AS v FROM st GROUP BY fold)
SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n FROM a""")
def fold_auc_summary(spark, sf):
    from ..operators.metrics import summarise_scores
    auc = curves.roc_auc(_scored_folds(spark, sf), "rare", "p_price", ["fold"])
    return summarise_scores(auc, "roc_auc").select(r6("mean", "mean"), r6("std", "std"), "n")


_BEST = """
f AS (SELECT fold, threshold, CASE WHEN tp - pos = 0 THEN 0.0::DOUBLE
        ELSE 2 * (tp - pos) / (tp - pos + fp - neg + n_pos) END AS f1 FROM st),
b AS (SELECT fold, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY fold
        ORDER BY f1 DESC, threshold) AS r FROM f) WHERE r = 1)"""


@query(f"{_FROWS}, {_BEST} SELECT fold, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM b")
def fold_best_f1(spark, sf):
    return curves.fold_best_f1(_scored_folds(spark, sf), "rare", "p_price").select(
        "fold", r6("threshold", "threshold"), r6("f1", "f1"))


@query(f"""{_FROWS}, {_BEST}, t AS (SELECT avg(threshold) AS t FROM b),
c AS (SELECT t, sum(CASE WHEN y = 0 AND p <= t THEN 1 ELSE 0 END)::BIGINT AS tn,
 sum(CASE WHEN y = 0 AND p > t THEN 1 ELSE 0 END)::BIGINT AS fp,
 sum(CASE WHEN y = 1 AND p <= t THEN 1 ELSE 0 END)::BIGINT AS fn,
 sum(CASE WHEN y = 1 AND p > t THEN 1 ELSE 0 END)::BIGINT AS tp FROM rows, t GROUP BY t)
SELECT round(t, 6) AS threshold, tn, fp, fn, tp, round(tp / (tp + fp), 6) AS precision,
 round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def best_f1_threshold(spark, sf):
    out = curves.best_f1_threshold(_scored_folds(spark, sf), "rare", "p_price")
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "threshold")})


def _mean_sql(by: str, kind: str) -> str:
    """Interpolate by joining an even grid to consecutive curve points."""
    if kind == "roc":
        pts = f"""SELECT {by}, fp AS a, tp / n_pos AS v, n_neg AS n, tp + fp AS o FROM st
                  UNION ALL SELECT DISTINCT {by}, 0, 0.0::DOUBLE, n_neg, 0 FROM st"""
        first, last = 0, 1
    else:
        pts = f"""SELECT {by}, tp AS a, tp / (tp + fp) AS v, n_pos AS n, tp + fp AS o FROM st
                  UNION ALL SELECT DISTINCT {by}, 0, 1.0::DOUBLE, n_pos, 0 FROM st"""
        first, last = 1, 0
    outer = ", ".join(c for c in by.split(", ") if c != "fold")
    lead = f"{outer}, " if outer else ""
    return f"""
pts AS ({pts}),
seg AS (SELECT *, lead(a) OVER w AS b, lead(v) OVER w AS u FROM pts
        WINDOW w AS (PARTITION BY {by} ORDER BY o)),
grid AS (SELECT {by}, i, v + (u - v) * (i * n / 99.0::DOUBLE - a) / (b - a) AS y
       FROM seg JOIN (SELECT unnest(range(1, 99)) AS i) g ON a * 99 <= i * n AND i * n < b * 99),
mid AS (SELECT {lead}i, avg(y) AS y FROM grid GROUP BY {lead}i),
curve AS (SELECT * FROM mid UNION ALL SELECT DISTINCT {lead}0, {first}.0::DOUBLE FROM mid
          UNION ALL SELECT DISTINCT {lead}99, {last}.0::DOUBLE FROM mid)"""


def _curve_query(kind):
    def run(spark, sf):
        c = curves.mean_curve(_scored_folds(spark, sf), kind, "rare", "p_price")
        return c.select("i", r6("x", "x"), r6("y", "y"))
    run.__name__ = f"mean_{kind}_curve"
    sql = f"{_FROWS}, {_mean_sql('fold', kind)} SELECT CAST(i AS INTEGER) AS i, round(i / 99, 6) AS x, round(y, 6) AS y FROM curve"
    return query(sql)(run)


mean_roc_curve = _curve_query("roc")
mean_pr_curve = _curve_query("pr")


@query(f"""WITH {SCORED_SQL},
long AS (SELECT row_id, rare, m AS model, s AS p FROM scored UNPIVOT (s FOR m IN (p_price, p_discount, p_tax))),
f AS (SELECT row_id, seed, (row_number() OVER (PARTITION BY seed, rare ORDER BY md5(concat(seed, ':', row_id)), row_id) - 1)
        % 4 AS fold FROM scored, (SELECT unnest([1, 9, 17]) AS seed)),
rows AS (SELECT model, seed, fold, p, rare AS y FROM long JOIN f USING (row_id)),
{steps_sql("model, seed, fold")}, {_mean_sql("model, seed, fold", "pr")}
SELECT model, seed, round(sum(CASE WHEN i IN (0, 99) THEN y / 2 ELSE y END) / 99, 6) AS area
FROM curve GROUP BY model, seed""")
def repeated_pr_areas(spark, sf):
    folds = split.stratified_folds(scored(spark, sf), "rare", "row_id", 4, [1, 9, 17])
    models = ["p_price", "p_discount", "p_tax"]
    # Written before it is made long: a row a seed, and scores of a model stay in a column of their own.
    oof = materialize(folds.select("seed", "fold", "rare", *models), "oof").unpivot(["seed", "fold", "rare"], models, "model", "p")
    by = ["model", "seed"]
    mean = curves.mean_curve(oof, "pr", "rare", "p", by=by)
    return curves.curve_area(mean, by).select("model", "seed", r6("area", "area"))


@query("""
WITH rows AS (SELECT event_type AS g, value / 500 AS p, CASE WHEN user_id % 10 = 3 THEN 1 ELSE 0 END AS y FROM events),
""" + steps_sql() + """
SELECT g AS event_type, round(sum(pos * tp / (tp + fp)) / max(n_pos), 6) AS average_precision FROM st GROUP BY g""")
def group_average_precision(spark, sf):
    e = table(spark, sf, "events").select(
        "event_type", (F.col("value") / 500).alias("p"),
        (F.pmod("user_id", F.lit(10)) == 3).cast("int").alias("y"))
    return curves.average_precision(e, "y", "p", ["event_type"]).select(
        "event_type", r6("average_precision", "average_precision"))


# ---------------------------------------------------------------- ensembles of scores

@query(f"""WITH {SCORED_SQL},
r AS (SELECT row_id, rank() OVER (ORDER BY p) + rank() OVER (ORDER BY p_price) + rank() OVER (ORDER BY p_tax) - 3 AS s
      FROM scored)
SELECT row_id, round(s / (SELECT max(s) FROM r), 6) AS rank_score FROM r""")
def rank_average(spark, sf):
    out = votes.rank_average(scored(spark, sf), "row_id", ["p", "p_price", "p_tax"])
    return out.withColumn("rank_score", r6("rank_score"))


@query(f"""WITH {SCORED_SQL}
SELECT row_id, round((2 * p + p_price + p_discount + p_tax) / 5, 6) AS p,
       CASE WHEN (2 * p + p_price + p_discount + p_tax) / 5 > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction
FROM scored""")
def soft_vote(spark, sf):
    out = votes.soft_vote(scored(spark, sf), ["p", "p_price", "p_discount", "p_tax"], [2, 1, 1, 1])
    return out.select("row_id", r6("p", "p"), "prediction")


_VOTERS = {"lr": "p", "knn": "p_price", "gb": "p_discount", "rf": "p_tax", "nn": "p_price", "svm": "p"}
_CUTS = {"lr": 0.5, "knn": 0.5, "gb": 0.6, "rf": 0.7, "nn": 0.8, "svm": 0.9}
_MASS = " + ".join(f"{w}::DOUBLE * CASE WHEN {_VOTERS[m]} > {_CUTS[m]} THEN 1 ELSE 0 END"
                   for m, w in votes.HARD_VOTE_WEIGHTS.items())


@query(f"""WITH {SCORED_SQL}, v AS (SELECT row_id, ({_MASS}) / 4.52 AS vote FROM scored)
SELECT row_id, round(vote, 6) AS vote, CASE WHEN vote >= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction FROM v""")
def hard_vote(spark, sf):
    s = scored(spark, sf).select("row_id", *[
        (F.col(_VOTERS[m]) > _CUTS[m]).cast("double").alias(m) for m in votes.HARD_VOTE_WEIGHTS])
    out = votes.hard_vote(s, list(votes.HARD_VOTE_WEIGHTS), list(votes.HARD_VOTE_WEIGHTS.values()),
                          votes.HARD_VOTE_TOTAL)
    return out.select("row_id", r6("vote", "vote"), "prediction")


# ---------------------------------------------------------------- neighbours

_PAIRS = """
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, b.label,
                 list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
          FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM pairs)"""


@query(f"""WITH {_PAIRS} SELECT query_id, neighbor_id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank
FROM near WHERE rank <= 6""")
def nearest_neighbors(spark, sf):
    e = table(spark, sf, "embeddings")
    return neighbors.nearest(e, e, 6, "embedding", "vec_id", exclude_self=True).select(
        "query_id", "neighbor_id", r6("distance", "distance"), "rank")


@query()
def approximate_neighbors(spark, sf):
    e = table(spark, sf, "embeddings")
    near = approximate_nearest(e, e, 6, "embedding", "vec_id", exclude_self=True, bucket_rows=256)
    return near.select("query_id", "neighbor_id", r6("distance", "distance"), "rank", "probes", r6("recall", "recall"))


@query(f"""WITH {_PAIRS} SELECT query_id,
round(sum(CASE WHEN label = 3 THEN 1 / d ELSE 0 END) / sum(1 / d), 6) AS p FROM near WHERE rank <= 6 GROUP BY 1""")
def knn_predict(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("y", (F.col("label") == 3).cast("double"))
    near = neighbors.nearest(e, e, 6, "embedding", "vec_id", exclude_self=True, payload=["y"])
    return neighbors.inverse_distance(near, "y").select("query_id", r6("p", "p"))


@query("""
WITH c AS (SELECT sum(CASE WHEN l_extendedprice * l_discount > 9000 THEN 1 ELSE 0 END)::BIGINT AS m, count(*) AS a FROM lineitem),
need AS (SELECT m, CAST(floor(0.05 * (a - m)) AS BIGINT) - m AS need FROM c),
mi AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
              l_quantity / 50 AS quantity, l_extendedprice / 110000 AS price FROM lineitem
       WHERE l_extendedprice * l_discount > 9000),
n AS (SELECT a.id, b.quantity AS bq, b.price AS bp, row_number() OVER (PARTITION BY a.id ORDER BY
        sqrt((a.quantity - b.quantity) * (a.quantity - b.quantity) + (a.price - b.price) * (a.price - b.price)), b.id) AS rank
      FROM mi a JOIN mi b ON a.id <> b.id),
turn AS (SELECT *, row_number() OVER (ORDER BY md5(concat('1:', id)), id) AS o FROM mi),
base AS (SELECT turn.*, unnest(range(1, CAST(floor((need - o) / m) + 2 AS BIGINT))) AS copy FROM turn, need WHERE o <= need),
h AS (SELECT *, md5(concat('1:', copy, ':', id)) AS h FROM base),
g AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % 5 + 1 AS rank, ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE AS gap FROM h)
SELECT g.id, CAST(copy AS INTEGER) AS copy, round(quantity + gap * (bq - quantity), 6) AS quantity,
       round(price + gap * (bp - price), 6) AS price
FROM g JOIN n ON g.id = n.id AND g.rank = n.rank""")
def oversample_minority(spark, sf):
    s = scored(spark, sf).select("row_id", "rare", F.col("p").alias("quantity"), F.col("p_price").alias("price"))
    out = neighbors.oversample(s, "rare", "row_id", ["quantity", "price"], 0.05)
    return out.select("id", "copy", r6("quantity", "quantity"), r6("price", "price"))
