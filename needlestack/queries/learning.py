"""Learners, ensembles, calibration, model selection and diagnostics as queries.

Where a fit has one exact answer (a penalised logistic curve, a single best split,
nearest neighbours) the SQL computes it independently. The others return rows only
and are held to invariants in the tests.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA
from pyspark.sql import functions as F

from ..inflight import in_flight
from ..learners import boosting, calibrated, trees
from ..learners.fourier import RbfSVC
from ..learners.knn import KNNClassifier
from ..learners.linear import PenalisedLogistic
from ..learners.mlp import DenseNetwork, network_from_trial, network_history
from ..learners.scores import score
from ..learners.stacking import Stacking, stacked_columns
from ..operators import metrics, prep, split, votes
from ..plans import blind, evaluate, search, shared, spaces
from ..sources import materialize, scratch_path
from .frames import FEATURES, FF_SQL, SCORED_SQL, TEXT_FEATURES, docs, ff, scored, table
from .relational import _SETS, _catalogs, _scored_folds, r6
from .ranking import steps_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return register


# ---------------------------------------------------------------- shared frames and learners

def _docs(spark, sf, folds: int = 4):
    """Labelled documents with weights and folds, written once."""
    df = prep.class_weights(docs(spark, sf), "y")
    return materialize(split.stratified_folds(df, "y", "doc_id", folds).drop("seed"), "docs")


def _lines(spark, sf):
    """Line items with NULLs, weights and a held-out part, written once."""
    df = prep.class_weights(ff(spark, sf), "rare")
    return materialize(split.stratified_split(df, "rare", "row_id", 0.25).drop("seed"), "lines")


def _on_docs(learner, scaler="standard"):
    return blind.standard_pipeline(TEXT_FEATURES, learner, scaler)


def _on_lines(learner):
    return blind.standard_pipeline(FEATURES, learner, "none")


def _logit(label="y", **kw):
    return PenalisedLogistic(**{"C": 1.29, "labelCol": label, "weightCol": "weight", **kw})


def _tree(params=None, label="y"):
    return trees.decision_tree({"max_depth": 3, "seed": 1, **(params or {})}, labelCol=label,
                               weightCol="weight")


def _forest(params=None, label="y"):
    return trees.random_forest({"n_estimators": 20, "max_depth": 5, "max_features": 3,
                                "min_samples_leaf": 3, "seed": 1, **(params or {})},
                               labelCol=label, weightCol="weight")


def _boost(params=None, label="y"):
    return trees.boosted_trees({"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1,
                                "subsample": 0.6, "seed": 1, **(params or {})},
                               labelCol=label, weightCol="weight")


def _svm(label="y", id_col="doc_id"):
    return RbfSVC(C=16.5, gamma=0.0914, labelCol=label, weightCol="weight", size=64, maxIter=20)


def _net(label="y", id_col="doc_id", epochs=30, **kw):
    return DenseNetwork(**{**dict(hidden=(18, 13), dropout=(0.04, 0.09), max_norm=(9.388, 2.72),
                                  lr=0.1, decay=0.001, batch=32, epochs=epochs,
                                  labelCol=label, weightCol="weight", idCol=id_col), **kw})


def _held_out(pipeline, df, id_col, label, fold=0):
    model = pipeline.fit(df.where(F.col("fold") != fold))
    return score(model, df, "p").select(id_col, label, (F.col("fold") == fold).alias("held_out"), "p")


# ---------------------------------------------------------------- fits with an exact answer

def newton_sql(group: str, penalty: str, steps: int = 14) -> str:
    """Newton's method for a weighted logistic curve over a CTE data(group, x, y, s)."""
    out = [f"n0 AS (SELECT {group}, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM data GROUP BY {group})"]
    for i in range(steps):
        out.append(f"""
g{i} AS (SELECT {group}, a, b, sum(s * (y - p)) AS ga, sum(s * (y - p) * x) - b * {penalty} AS gb,
  sum(s * p * (1 - p)) AS haa, sum(s * p * (1 - p) * x) AS hab, sum(s * p * (1 - p) * x * x) + {penalty} AS hbb
  FROM (SELECT data.{group}, x, y, s, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM data JOIN n{i} USING ({group}))
  GROUP BY {group}, a, b),
n{i + 1} AS (SELECT {group}, a + (ga * hbb - gb * hab) / (haa * hbb - hab * hab) AS a,
  b + (gb * haa - ga * hab) / (haa * hbb - hab * hab) AS b FROM g{i})""")
    return ", ".join(out) + f", fitted AS (SELECT * FROM n{steps})"


@query(f"""WITH {SCORED_SQL}, c AS (SELECT count(*) AS n, sum(rare) AS m FROM scored),
data AS (SELECT 1 AS g, p_price AS x, rare AS y,
         CASE WHEN rare = 1 THEN n / (2.0::DOUBLE * m) ELSE n / (2.0::DOUBLE * (n - m)) END AS s FROM scored, c),
{newton_sql("g", "(1 / 1.29)")} SELECT round(b, 3) AS slope, round(a, 3) AS intercept FROM fitted""")
def logistic_fit(spark, sf):
    df = prep.class_weights(scored(spark, sf).select("row_id", "rare", "p_price"), "rare")
    data = prep.assemble(df, ["p_price"])
    m = _logit("rare", tol=1e-10).fit(data)
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))],
                                 "slope double, intercept double").select(
        F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(f"""WITH {SCORED_SQL}, folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY rare
   ORDER BY md5(concat('1:', row_id)), row_id) - 1) % 4 AS INTEGER) AS fold FROM scored),
c AS (SELECT fold, sum(rare) AS n1, count(*) - sum(rare) AS n0 FROM folds GROUP BY fold),
data AS (SELECT fold, p_price AS x, 1.0::DOUBLE AS s,
         CASE WHEN rare = 1 THEN (n1 + 1) / (n1 + 2.0::DOUBLE) ELSE 1 / (n0 + 2.0::DOUBLE) END AS y
         FROM folds JOIN c USING (fold)),
{newton_sql("fold", "0")} SELECT fold, round(b, 2) AS slope, round(a, 2) AS intercept FROM fitted""")
def sigmoid_calibration(spark, sf):
    df = _scored_folds(spark, sf)
    rows = in_flight(lambda f: (f, *calibrated.sigmoid_fit(df.where(F.col("fold") == f), "rare", "p_price")),
                     range(4))
    return spark.createDataFrame(rows, "fold int, slope double, intercept double").select(
        "fold", F.round("slope", 2).alias("slope"), F.round("intercept", 2).alias("intercept"))


_STUMP = f"""WITH {SCORED_SQL},
c AS (SELECT count(*) AS n, sum(rare) AS m FROM scored),
long AS (SELECT rare AS y, f AS feature, x, CASE WHEN rare = 1 THEN n / (2.0::DOUBLE * m)
                ELSE n / (2.0::DOUBLE * (n - m)) END AS w
         FROM scored UNPIVOT (x FOR f IN (p, p_discount, p_tax)), c),
v AS (SELECT feature, x, count(*) AS rows, sum(w) AS n, sum(y * w) AS m FROM long GROUP BY feature, x),
k AS (SELECT feature, (x + lead(x) OVER w) / 2 AS t, sum(n) OVER w AS nl, sum(m) OVER w AS ml,
             sum(rows) OVER w AS rl, sum(rows) OVER (PARTITION BY feature) AS r,
             sum(n) OVER (PARTITION BY feature) AS n, sum(m) OVER (PARTITION BY feature) AS m
      FROM v WINDOW w AS (PARTITION BY feature ORDER BY x)),
q AS (SELECT *, nl / n * 2 * (ml / nl) * (1 - ml / nl)
             + (n - nl) / n * 2 * ((m - ml) / (n - nl)) * (1 - (m - ml) / (n - nl)) AS impurity
      FROM k WHERE t IS NOT NULL),
best AS (SELECT * FROM q ORDER BY impurity, feature LIMIT 1)"""


@query(f"""{_STUMP}
SELECT 0 AS node, feature, round(t, 6) AS threshold, r::BIGINT AS n, round(m / n, 6) AS positive_share FROM best
UNION ALL SELECT 1, NULL, NULL, rl::BIGINT, round(ml / nl, 6) FROM best
UNION ALL SELECT 2, NULL, NULL, (r - rl)::BIGINT, round((m - ml) / (n - nl), 6) FROM best""")
def best_split_tree(spark, sf):
    names = ["p", "p_discount", "p_tax"]
    data = prep.assemble(prep.class_weights(scored(spark, sf), "rare"), names)
    tree = trees.decision_tree({"max_depth": 1, "max_bins": 64, "seed": 1}, labelCol="rare",
                               weightCol="weight").fit(data)
    nodes = trees.tree_nodes(tree)
    share = F.col("class_weights")[1] / (F.col("class_weights")[0] + F.col("class_weights")[1])
    return nodes.select("node", F.get(F.array(*[F.lit(n) for n in names]), F.col("feature_index")).alias("feature"),
                        r6("threshold", "threshold"), "n", r6(share, "positive_share"))


@query("""
WITH c AS (SELECT c_custkey AS id, c_acctbal AS a, c_nationkey::DOUBLE AS b,
            CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y FROM customer),
f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5(concat('1:', id)), id) - 1) % 4 AS fold FROM c),
s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f WHERE fold <> 0),
z AS (SELECT id, y, fold, (a - ma) / sa AS a, (b - mb) / sb AS b FROM f, s),
d AS (SELECT q.id, t.y, sqrt((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b)) AS d, t.id AS tid
      FROM z q JOIN z t ON q.fold = 0 AND t.fold <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, tid) AS r FROM d)
SELECT id, round(CASE WHEN min(d) = 0 THEN avg(CASE WHEN d = 0 THEN y END)
                 ELSE sum(y / nullif(d, 0)) / sum(1 / nullif(d, 0)) END, 6) AS p
FROM n WHERE r <= 6 GROUP BY id""")
def knn_classifier(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"),
        F.col("c_nationkey").cast("double").alias("b"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"))
    df = materialize(split.stratified_folds(c, "y", "id", 4), "customers")
    knn = KNNClassifier(6, labelCol="y", idCol="id")
    pipe = Pipeline(stages=[*prep.scaler_stages(["a", "b"]), knn])
    model = pipe.fit(df.where(F.col("fold") != 0))
    return score(model, df.where(F.col("fold") == 0), "p").select("id", r6("p", "p"))


# ---------------------------------------------------------------- learners

@query()
def logistic_scores(spark, sf):
    return _held_out(_on_docs(_logit()), _docs(spark, sf), "doc_id", "y")


@query()
def logistic_pca_scores(spark, sf):
    df = _lines(spark, sf)
    pipe = blind.standard_pipeline(FEATURES, _logit("rare", featuresCol="pca"), n_components=3)
    model = pipe.fit(df.where(F.col("split") == "train"))
    return score(model, df, "p").select("row_id", "rare", "split", "p")


@query()
def tree_scores(spark, sf):
    return _held_out(_on_docs(_tree({"max_features": 3, "max_depth": 4})), _docs(spark, sf), "doc_id", "y")


@query()
def forest_scores(spark, sf):
    df = _lines(spark, sf)
    model = _on_lines(_forest(label="rare")).fit(df.where(F.col("split") == "train"))
    return score(model, df, "p").select("row_id", "rare", "split", "p")


@query()
def boosted_scores(spark, sf):
    df = _lines(spark, sf)
    model = _on_lines(_boost(label="rare")).fit(df.where(F.col("split") == "train"))
    return score(model, df, "p").select("row_id", "rare", "split", "p")


@query()
def kernel_svm_scores(spark, sf):
    return _held_out(_on_docs(_svm()), _docs(spark, sf), "doc_id", "y")


@query()
def network_scores(spark, sf):
    return _held_out(_on_docs(_net()), _docs(spark, sf), "doc_id", "y")


@query()
def network_three_layer_scores(spark, sf):
    params = {"width_1": 18, "width_2": 13, "width_3": 9, "dropout_1": 0.05, "dropout_2": 0.05,
              "dropout_3": 0.0, "max_norm_1": 4, "max_norm_2": 4, "max_norm_3": 4, "batch": 32,
              "lr": 0.1}
    net = network_from_trial(params, epochs=30, labelCol="y", weightCol="weight",
                             idCol="doc_id")
    return _held_out(_on_docs(net), _docs(spark, sf), "doc_id", "y")


@query()
def network_early_stop(spark, sf):
    """Train and held-out loss per epoch, stopped by patience on the held-out loss."""
    df = _docs(spark, sf).withColumn("valid", F.col("fold") == 0)
    net = _net(epochs=30, validCol="valid", patience=5)
    model = _on_docs(net).fit(df).stages[-1]
    return network_history(spark, model).withColumn("best_n", F.lit(model.best_n))


@query()
def tree_rule_table(spark, sf):
    df = _docs(spark, sf)
    model = _on_docs(_tree(), "none").fit(df)
    return trees.tree_rules(model.stages[-1], TEXT_FEATURES)


# ---------------------------------------------------------------- early stopping and histories

def _ready_lines(spark, sf, label="rare"):
    """Imputed and assembled line items; boosted learners read `features`."""
    df = _lines(spark, sf)
    imputer = prep.MedianImputer(cols=FEATURES).fit(df.where(F.col("split") == "train"))
    ready = imputer.transform(df).withColumn("valid", F.col("split") == "test")
    return prep.assemble(ready, FEATURES)


@query()
def early_stopped_boosting(spark, sf):
    data = _ready_lines(spark, sf)
    est = boosting.EarlyStoppedGBT(_boost({"n_estimators": 8}, "rare"), patience=3, metric="logloss")
    model = est.fit(data)
    return model.history.withColumn("best_n", F.lit(model.best_n))


@query()
def early_stop_user_metric(spark, sf):
    data = _ready_lines(spark, sf)
    est = boosting.EarlyStoppedGBT(_boost({"n_estimators": 6}, "rare"), patience=3,
                                   metric=metrics.f1_loss)
    model = est.fit(data)
    return model.history.withColumn("best_n", F.lit(model.best_n))


@query()
def refit_scores(spark, sf):
    df = _docs(spark, sf)
    data = prep.assemble(df, TEXT_FEATURES)
    model = boosting.refit(_boost(), data, best_n=8)
    return score(model, data, "p").select("doc_id", "y", "p", F.lit(model.getNumTrees).alias("rounds"))


@query()
def boosting_cv_history(spark, sf):
    data = prep.assemble(_docs(spark, sf, 3), TEXT_FEATURES)
    history, best = boosting.boosting_cv(_boost({"n_estimators": 6}), data, "fold", 3, 3, "map")
    return history.withColumn("best_n", F.lit(best.first()["best_iteration"]))


@query()
def training_history(spark, sf):
    data = _ready_lines(spark, sf)
    train, test = data.where(~F.col("valid")), data.where("valid")
    model = _boost({"n_estimators": 6}, "rare").fit(train)
    return boosting.training_history(model, {"train": train, "test": test}, "rare")


@query()
def staged_deviance(spark, sf):
    data = _ready_lines(spark, sf)
    train, test = data.where(~F.col("valid")), data.where("valid")
    model = _boost({"n_estimators": 6}, "rare").fit(train)
    return boosting.staged_deviance(model, {"train": train, "test": test}, "rare")


@query()
def gain_importance(spark, sf):
    data = _ready_lines(spark, sf)
    return trees.importances(_forest(label="rare").fit(data), FEATURES).orderBy(
        F.desc("importance"), "feature")


@query()
def split_importance(spark, sf):
    data = _ready_lines(spark, sf)
    return trees.importances(_boost({"n_estimators": 4}, "rare").fit(data), FEATURES, "splits")


@query()
def importance_sweep(spark, sf):
    df = _docs(spark, sf)
    train, test = df.where(F.col("fold") != 0), df.where(F.col("fold") == 0)
    model = _on_docs(_forest(), "none").fit(train)
    imp = trees.importances(model.stages[-1], TEXT_FEATURES)
    make = lambda cols: blind.standard_pipeline(cols, _tree({"max_depth": 4}), "none")
    return evaluate.importance_sweep(make, train, test, imp, "y")


@query()
def pca_variance(spark, sf):
    from pyspark.ml.functions import array_to_vector
    e = table(spark, sf, "embeddings").select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = PCA(k=64, inputCol="features", outputCol="pca").fit(e)
    return prep.explained_variance(model, spark)


# ---------------------------------------------------------------- ensembles

@query()
def stacked_scores(spark, sf):
    df = _docs(spark, sf)
    bases = [_on_docs(_logit()), _on_docs(_forest(), "none"), _on_docs(_tree(), "none")]
    meta = blind.standard_pipeline(stacked_columns(TEXT_FEATURES, bases), _logit())
    model = Stacking(bases, meta, "y", "doc_id").fit(df.where(F.col("fold") != 0))
    return score(model, df, "p").select("doc_id", "y", (F.col("fold") == 0).alias("held_out"), "p")


@query()
def calibrated_scores(spark, sf):
    df = _docs(spark, sf)
    est = calibrated.SigmoidCalibrated(_on_docs(_tree(), "none"), "y", "doc_id", k=3)
    model = est.fit(df.where(F.col("fold") != 0).drop("fold"))
    return score(model, df, "p").select("doc_id", "y", (F.col("fold") == 0).alias("held_out"), "p")


@query()
def model_votes(spark, sf):
    """Six fitted models in one row, combined three ways."""
    df = _docs(spark, sf)
    train = df.where(F.col("fold") != 0)
    models = {"lr": _on_docs(_logit()), "knn": _on_docs(KNNClassifier(6, labelCol="y", idCol="doc_id")),
              "gb": _on_docs(_boost(), "none"), "rf": _on_docs(_forest(), "none"),
              "nn": _on_docs(_net(epochs=15)), "svm": _on_docs(_svm())}
    out = df.where(F.col("fold") == 0)
    fitted = in_flight(lambda name: models[name].fit(train), list(models))
    for name, model in zip(models, fitted):
        out = score(model, out, name)
    out = materialize(out.select("doc_id", "y", *models), "votes")
    soft = votes.soft_vote(out, list(models), [2, 1, 1, 1, 1, 1], p="soft", pred="soft_class")
    cut = {m: 0.0 if m == "svm" else 0.5 for m in models}
    hard = soft.withColumns({m: (F.col(m) > cut[m]).cast("double") for m in models})
    hard = votes.hard_vote(hard, list(models), [votes.HARD_VOTE_WEIGHTS[m] for m in models],
                           votes.HARD_VOTE_TOTAL, pred="hard_class")
    ranks = votes.rank_average(out, "doc_id", list(models))
    return hard.join(ranks, "doc_id").select("doc_id", "y", "soft", "vote", "hard_class", "rank_score")


# ---------------------------------------------------------------- model selection

@query()
def oof_scores(spark, sf):
    return evaluate.oof_predict(_on_docs(_logit()), _docs(spark, sf), "fold", 4, "y", ["doc_id"])


@query()
def cv_scores(spark, sf):
    df = _docs(spark, sf)
    est = _on_docs(_tree(), "none")
    oof = evaluate.oof_predict(est, df, "fold", 4, "y")
    parts = None
    for m in ("f1", "f1_weighted", "roc_auc", "ap", "accuracy"):
        per = evaluate.metric_value(oof, m, "y", by=["fold"]).select(F.lit(m).alias("metric"), "fold", "value")
        parts = per if parts is None else parts.unionByName(per)
    return metrics.summarise_scores(parts, "value", ["metric"])


@query()
def grid_search_trials(spark, sf):
    df = _docs(spark, sf, 3)
    make = lambda p: _on_docs(_tree(p), "none")
    objective = search.cv_objective(make, df, "fold", 3, "y", "f1")
    return search.grid_search(spark, objective, {"max_depth": [1, 2, 3], "min_samples_leaf": [2, 8]})


@query()
def nested_random_search(spark, sf):
    df = _docs(spark, sf, 2)
    make = lambda p: _on_docs(_tree(p), "none")
    space = {"max_depth": spaces.integers(1, 4), "min_weight_fraction_leaf": spaces.Uniform(0, 0.1)}
    return search.nested_random_search(make, df, "y", "doc_id", space, 2, k=2, inner_k=2)


@query()
def adaptive_search_trials(spark, sf):
    df = _docs(spark, sf, 2)
    make = lambda p: _on_docs(_logit(C=p["C"], maxIter=30))
    objective = search.cv_objective(make, df, "fold", 2, "y", "ap", "mean")
    return search.adaptive_search(spark, objective, {"C": spaces.LogUniform(-5, 4)}, 8, batch=2,
                                  startup=4)


@query()
def tuned_refit(spark, sf):
    """Search, take the best trial, refit on all rows, score."""
    df = _docs(spark, sf, 2)
    make = lambda p: _on_docs(_tree({"max_depth": int(p["max_depth"])}), "none")
    objective = search.cv_objective(make, df, "fold", 2, "y", "f1")
    trials = search.grid_search(spark, objective, {"max_depth": [1, 3]})
    return score(blind.tune_refit(make, trials, df), df, "p").select("doc_id", "y", "p")


@query()
def learning_curve(spark, sf):
    df = _docs(spark, sf).drop("fold")
    return evaluate.learning_curve(_on_docs(_logit(maxIter=30)), df, "y", "doc_id", reps=2)


@query()
def compare_models(spark, sf):
    df = _docs(spark, sf, 2)
    parts = None
    for name, est in (("tree", _on_docs(_tree(), "none")), ("logistic", _on_docs(_logit()))):
        oof = evaluate.oof_predict(est, df, "fold", 2, "y").withColumn("model", F.lit(name))
        parts = oof if parts is None else parts.unionByName(oof)
    return evaluate.compare_models(parts, "y")


# ---------------------------------------------------------------- end to end

@query()
def saved_model_scores(spark, sf):
    df = _docs(spark, sf)
    path = scratch_path(spark, "pipeline")
    _on_docs(_net(epochs=5)).fit(df).write().save(path)
    return score(PipelineModel.load(path), df, "p").select("doc_id", "y", "p")


@query()
def blind_scoring(spark, sf):
    """Fit on half of the labelled documents, score all documents, match ids with the other labels."""
    df = materialize(docs(spark, sf, "left").select("doc_id", "y", *TEXT_FEATURES), "blind_documents")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    lab = table(spark, sf, "labels").where(~seen)
    train = df.where(F.col("y").isNotNull() & seen)
    train = materialize(prep.class_weights(train, "y"), "train")
    target = df.drop("y")
    text = F.col("doc_id").cast("string").alias("id")
    new = lab.where(F.col("quality") == 0).select(text)
    cand = lab.where(F.col("toxic") == 1).select(text)
    nic = lab.where(F.col("toxic") == 1).select(
        text, F.when(F.col("quality") == 0, "VAR").otherwise("CST").alias("line"))
    return blind.blind_scoring(_on_docs(_logit()), train, target, new, cand, nic, "doc_id", 0.5)


@query()
def blind_scoring_lines(spark, sf):
    """The same plan at volume: line items scored, orders as catalogues."""
    df = _lines(spark, sf)
    train = df.where(F.col("split") == "train")
    target = df.withColumn("order_id", F.split_part("row_id", F.lit("-"), F.lit(1)))
    new, cand, nic = _catalogs(spark, sf)
    return blind.blind_scoring(blind.standard_pipeline(FEATURES, _logit("rare")), train, target, new,
                               cand, nic, "order_id", 0.5)


@query(f"""WITH {FF_SQL}, {_SETS},
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY rare ORDER BY md5(concat('1:', row_id)), row_id)
         <= round(count(*) OVER (PARTITION BY rare) * 0.25) THEN 1 ELSE 0 END AS test FROM ff),
w AS (SELECT count(*) AS n, sum(rare) AS m FROM ff),
md AS (SELECT median(price) AS med FROM sp WHERE test = 0),
im AS (SELECT row_id, rare, test, coalesce(price, med) AS price FROM sp, md),
mo AS (SELECT avg(price) AS mu, stddev_pop(price) AS sd FROM im WHERE test = 0),
z AS (SELECT row_id, rare, test, (price - mu) / sd AS x FROM im, mo),
data AS (SELECT 1 AS g, x, rare AS y, CASE WHEN rare = 1 THEN n / (2.0::DOUBLE * m)
         ELSE n / (2.0::DOUBLE * (n - m)) END AS s FROM z, w WHERE test = 0),
{newton_sql("g", "(1 / 1.29)")},
sc AS (SELECT split_part(row_id, '-', 1) AS id, a + b * x AS margin FROM z, fitted),
f AS (SELECT DISTINCT id FROM sc WHERE margin > 0), mi AS (SELECT DISTINCT id FROM sc WHERE margin < 0),
c AS (SELECT (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM mi) AS nm,
        (SELECT count(*) FROM f JOIN truth USING (id)) AS tp, (SELECT count(*) FROM mi JOIN truth USING (id)) AS fn,
        (SELECT count(*) FROM f JOIN news USING (id)) AS new_found)
SELECT new_found, nm - fn AS tn, nf - tp AS fp, fn, tp, round(tp / nullif(nf, 0), 6) AS precision,
       round(tp / nullif(tp + fn, 0), 6) AS recall,
       round(2 * tp / nullif(2 * tp + (nf - tp) + fn, 0), 6) AS f1 FROM c""")
def blind_scoring_one_feature(spark, sf):
    """Impute, scale, fit, score, threshold and match, with a fit that has one exact answer."""
    df = _lines(spark, sf)
    target = df.withColumn("order_id", F.split_part("row_id", F.lit("-"), F.lit(1)))
    pipe = blind.standard_pipeline(["price"], _logit("rare", tol=1e-10))
    out = blind.blind_scoring(pipe, df.where(F.col("split") == "train"), target,
                              *_catalogs(spark, sf), "order_id", 0.5)
    return out.drop("probe_found").withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(f"""WITH {SCORED_SQL},
rows AS (SELECT m AS g, rare AS y, s AS p FROM scored UNPIVOT (s FOR m IN (p_price, p_discount, p_tax))), {steps_sql()},
a AS (SELECT g, sum(neg * (tp - pos / 2)) / max(n_pos) / max(n_neg) AS roc_auc,
             sum(pos * tp / (tp + fp)) / max(n_pos) AS average_precision FROM st GROUP BY g),
c AS (SELECT g, count(*) AS n, sum(CASE WHEN p > 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp,
        sum(CASE WHEN p > 0.5 AND y = 0 THEN 1 ELSE 0 END) AS fp,
        sum(CASE WHEN p <= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS fn FROM rows GROUP BY g)
SELECT g AS model, round((n - fp - fn) / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision,
  round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
  round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM c JOIN a USING (g)""")
def model_metric_table(spark, sf):
    long = scored(spark, sf).unpivot(["row_id", "rare"], ["p_price", "p_discount", "p_tax"], "model", "p")
    out = evaluate.compare_models(long, "rare")
    return out.select("model", *[r6(c, c) for c in out.columns if c != "model"])


@query("""SELECT event_id AS trial_id, round(value, 6) AS loss FROM events ORDER BY value, event_id LIMIT 1""")
def best_trial(spark, sf):
    trials = table(spark, sf, "events").select(F.col("event_id").alias("trial_id"), F.col("value").alias("loss"))
    return search.best_trial(trials).select("trial_id", r6("loss", "loss"))


@query(f"""WITH {SCORED_SQL}, m AS (SELECT var_samp(p_price) AS a, var_samp(p_discount) AS c,
  covar_samp(p_price, p_discount) AS b FROM scored),
e AS (SELECT (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1,
             (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM m)
SELECT 1 AS component, round(l1 / (l1 + l2), 6) AS ratio, round(l1 / (l1 + l2), 6) AS cumulative FROM e
UNION ALL SELECT 2, round(l2 / (l1 + l2), 6), 1.0::DOUBLE FROM e""")
def pca_two_columns(spark, sf):
    data = prep.assemble(scored(spark, sf), ["p_price", "p_discount"])
    model = prep.pca(2).fit(data)
    return prep.explained_variance(model, spark).select(
        "component", r6("ratio", "ratio"), r6("cumulative", "cumulative"))


@query(f"""WITH {FF_SQL},
fo AS (SELECT *, (row_number() OVER (PARTITION BY rare ORDER BY md5(concat('1:', row_id)), row_id) - 1) % 4 AS fold FROM ff),
pairs AS (SELECT t.f, fo.* FROM fo, (SELECT unnest([0, 1, 2, 3]) AS f) t),
w AS (SELECT count(*) AS n, sum(rare) AS m FROM ff),
md AS (SELECT f, median(price) AS med FROM pairs WHERE fold <> f GROUP BY f),
im AS (SELECT f, fold, rare, coalesce(price, med) AS price FROM pairs JOIN md USING (f)),
mo AS (SELECT f, avg(price) AS mu, stddev_pop(price) AS sd FROM im WHERE fold <> f GROUP BY f),
z AS (SELECT f, fold, rare, (price - mu) / sd AS x FROM im JOIN mo USING (f)),
data AS (SELECT f, x, rare AS y, CASE WHEN rare = 1 THEN n / (2.0::DOUBLE * m)
         ELSE n / (2.0::DOUBLE * (n - m)) END AS s FROM z, w WHERE fold <> f),
{newton_sql("f", "(1 / 1.29)")},
o AS (SELECT rare AS y, a + b * x > 0 AS z FROM z JOIN fitted USING (f) WHERE fold = f),
c AS (SELECT sum(CASE WHEN y = 0 AND NOT z THEN 1 ELSE 0 END)::BIGINT AS tn,
 sum(CASE WHEN y = 0 AND z THEN 1 ELSE 0 END)::BIGINT AS fp,
 sum(CASE WHEN y = 1 AND NOT z THEN 1 ELSE 0 END)::BIGINT AS fn,
 sum(CASE WHEN y = 1 AND z THEN 1 ELSE 0 END)::BIGINT AS tp FROM o)
SELECT tn, fp, fn, tp, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def cv_pooled_one_feature(spark, sf):
    """Out-of-fold predictions of a whole pipeline, refitted per fold, pooled into one F1."""
    df = prep.class_weights(ff(spark, sf), "rare")
    df = materialize(split.stratified_folds(df, "rare", "row_id", 4).drop("seed"), "cv")
    pipe = blind.standard_pipeline(["price"], _logit("rare", tol=1e-10))
    oof = evaluate.oof_predict(pipe, df, "fold", 4, "rare")
    z = oof.withColumn("z", (F.col("p") > 0.5).cast("int"))
    return metrics.prf(metrics.confusion(z, "rare", "z")).select("tn", "fp", "fn", "tp", r6("f1", "f1"))


@query(f"""WITH {FF_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY rare ORDER BY md5(concat('1:', row_id)), row_id) AS r,
             count(*) OVER (PARTITION BY rare) AS n FROM ff),
h AS (SELECT *, r <= round(n * 0.5) AS second FROM o),
md AS (SELECT median(price) AS med FROM h WHERE NOT second),
im AS (SELECT row_id, rare, second, coalesce(price, med) AS price FROM h, md),
mo AS (SELECT avg(price) AS mu, stddev_pop(price) AS sd FROM im WHERE NOT second),
z AS (SELECT row_id, rare, second, (price - mu) / sd AS x FROM im, mo),
data AS (SELECT 1 AS g, x, rare AS y, 1.0::DOUBLE AS s FROM z WHERE NOT second),
{newton_sql("g", "(1 / 1.29)", 18)}
SELECT count(*) AS n, sum(rare)::BIGINT AS positives, round(avg(1 / (1 + exp(-(a + b * x)))), 4) AS mean_base
FROM z, fitted WHERE second""")
def stacking_base_frame(spark, sf):
    """The second half as the meta learner sees it: scores of a base fitted on the first half."""
    base = blind.standard_pipeline(["price"], PenalisedLogistic(C=1.29, labelCol="rare", tol=1e-10))
    _, stacked = Stacking([base], None, "rare", "row_id").fit_bases(ff(spark, sf))
    return stacked.agg(F.count(F.lit(1)).alias("n"), F.sum("rare").alias("positives"),
                       F.round(F.avg("base_0"), 4).alias("mean_base"))


_TUNED = f"""WITH {SCORED_SQL}, {_SETS},
fo AS (SELECT *, CAST((row_number() OVER (PARTITION BY rare ORDER BY md5(concat('1:', row_id)), row_id) - 1) % 4 AS INTEGER)
       AS fold FROM scored),
ws AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 20.0::DOUBLE), (2, 60.0::DOUBLE)) AS v(trial, w)),
long AS (SELECT trial, f, rare AS y, CASE WHEN rare = 1 THEN w ELSE 1.0::DOUBLE END AS s, feature, x
         FROM (SELECT * FROM fo UNPIVOT (x FOR feature IN (p, p_discount, p_tax))), ws,
              (SELECT unnest([0, 1, 2, 3, 4]) AS f) WHERE fold <> f),
v AS (SELECT trial, f, feature, x, sum(s) AS n, sum(y * s) AS m FROM long GROUP BY ALL),
k AS (SELECT trial, f, feature, (x + lead(x) OVER w) / 2 AS t, sum(n) OVER w AS nl, sum(m) OVER w AS ml,
             sum(n) OVER (PARTITION BY trial, f, feature) AS n, sum(m) OVER (PARTITION BY trial, f, feature) AS m
      FROM v WINDOW w AS (PARTITION BY trial, f, feature ORDER BY x)),
q AS (SELECT *, nl / n * (ml / nl) * (1 - ml / nl) + (n - nl) / n * ((m - ml) / (n - nl)) * (1 - (m - ml) / (n - nl))
             AS impurity FROM k WHERE t IS NOT NULL),
best AS (SELECT trial, f, feature, t, ml / nl > 0.5 AS low, (m - ml) / (n - nl) > 0.5 AS high FROM q
         QUALIFY row_number() OVER (PARTITION BY trial, f ORDER BY impurity, feature) = 1),
hit AS (SELECT trial, f, row_id, fold, rare AS y, CASE WHEN CASE feature WHEN 'p' THEN p WHEN 'p_discount' THEN p_discount
        ELSE p_tax END <= t THEN low ELSE high END AS z FROM fo, best),
tr AS (SELECT trial, sum(CASE WHEN y = 1 AND z THEN 1 ELSE 0 END)::BIGINT AS tp,
              sum(CASE WHEN (y = 1) <> z THEN 1 ELSE 0 END)::BIGINT AS wrong FROM hit WHERE f = fold GROUP BY trial),
won AS (SELECT trial, w, 1 - coalesce(2 * tp / nullif(2.0::DOUBLE * tp + wrong, 0), 0) AS loss FROM tr JOIN ws USING (trial)
        ORDER BY loss, trial LIMIT 1)"""


@query(f"""{_TUNED},
f AS (SELECT DISTINCT split_part(row_id, '-', 1) AS id FROM hit JOIN won USING (trial) WHERE f = 4 AND z),
mi AS (SELECT DISTINCT split_part(row_id, '-', 1) AS id FROM hit JOIN won USING (trial) WHERE f = 4 AND NOT z),
c AS (SELECT (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM mi) AS nm,
        (SELECT count(*) FROM f JOIN truth USING (id)) AS tp, (SELECT count(*) FROM mi JOIN truth USING (id)) AS fn,
        (SELECT count(*) FROM f JOIN news USING (id)) AS new_found)
SELECT w AS weight, 1::BIGINT AS best_n, round(loss, 6) AS loss, new_found, nm - fn AS tn, nf - tp AS fp, fn, tp,
       round(tp / nullif(nf, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
       round(2 * tp / nullif(2 * tp + (nf - tp) + fn, 0), 6) AS f1 FROM c, won""")
def tuned_blind_scoring(spark, sf):
    """Search, stop every fold early, refit the best set, score, match: one split a tree has one exact answer."""
    df = scored(spark, sf).drop("p_price", "y")
    df = materialize(split.stratified_folds(df, "rare", "row_id", 4).drop("seed"), "tuned")
    target = df.withColumn("order_id", F.split_part("row_id", F.lit("-"), F.lit(1)))
    sets = [{"max_depth": 1, "max_bins": 64, "scale_pos_weight": w} for w in (1.0, 20.0, 60.0)]
    trials, out = blind.tuned_blind_scoring(
        df, target, *_catalogs(spark, sf), ["p", "p_discount", "p_tax"], "rare", "order_id", sets, rounds=1, patience=1,
        scale=False)
    best = search.best_trial(trials).select(
        F.col("params")["scale_pos_weight"].alias("weight"), F.col("attachments")["best_n"].cast("long").alias("best_n"),
        r6("loss", "loss"))
    matched = out.drop("probe_found").withColumns({c: r6(c) for c in ("precision", "recall", "f1")})
    return best.join(matched)       # one row each


@query()
def shared_search_trials(spark, sf):
    """Trials on statistics of the folds that all of them share."""
    frames = shared.FoldFrames(_docs(spark, sf, 3), TEXT_FEATURES, "fold", 3, "y")
    sets = [{"max_depth": d, "class_weight": w} for d in (1, 2, 3) for w in (1.0, 6.0)]
    make = lambda p: trees.decision_tree({**p, "seed": 1}, labelCol="y", weightCol="weight")
    return shared.shared_search(make, frames, sets)
