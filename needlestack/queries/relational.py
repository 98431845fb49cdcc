"""Sources, scalar transforms, splits, metrics and set operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import binarize, finite, id_key, ln_positive, round_class, two_class
from ..operators import audit, catalog, history, metrics, prep, quantiles, split
from ..schema import STAT_COLUMNS, feature_columns
from ..sources import (
    finite_min, load_labelled, load_target, managed_table, materialize, read_id_list,
    read_stat_table, scratch_path, union_classes, without_marker, write_ids,
)
from .frames import FEATURES, FF_SQL, SCORED_SQL, ff, scored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return register


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


# ---------------------------------------------------------------- sources

def _log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items rendered as statistics-log text: 30 fields, +inf in some of them."""
    li = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    star = F.concat(F.lit("lmc_sc19_psf_lc_"),
                    F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents),
                    F.lit(".dat"))
    inf = F.lit("+inf")
    special = {
        "star_ID": star,
        "Magnitude": F.col("l_extendedprice").cast("string"),
        "clipped_sigma": F.when(F.pmod("l_partkey", F.lit(9)) == 0, inf)
                          .otherwise(F.col("l_quantity").cast("string")),
        "CSSD": F.when(F.pmod("l_suppkey", F.lit(13)) == 0, inf)
                 .otherwise((F.col("l_quantity") - 20).cast("string")),
        "IQR": F.col("l_discount").cast("string"),
    }
    filler = F.col("l_tax").cast("string")
    fields = [special.get(c, filler) for c in STAT_COLUMNS]
    rare = F.col("l_extendedprice") * F.col("l_discount") > 9000
    return li.select(F.concat_ws("  ", *fields).alias("value"), rare.alias("rare"))


_LOG_SQL = """
  SELECT 'lmc_sc19_psf_lc_' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
             CAST(round(l_extendedprice * 100) AS BIGINT)) || '.dat' AS star_ID,
         l_extendedprice AS Magnitude,
         CASE WHEN l_partkey % 9 <> 0 THEN l_quantity END AS clipped_sigma,
         CASE WHEN l_suppkey % 13 <> 0 THEN l_quantity - 20 END AS CSSD,
         l_discount AS IQR, l_tax AS kurt,
         CASE WHEN l_extendedprice * l_discount > 9000 THEN 1 ELSE 0 END AS rare
  FROM lineitem"""


@query(f"WITH t AS ({_LOG_SQL}) SELECT star_ID, Magnitude, clipped_sigma, CSSD, IQR, kurt FROM t")
def stat_log_scan(spark, sf):
    path = scratch_path(spark, "log")
    _log_lines(spark, sf).select("value").write.text(path)
    return read_stat_table(spark, path).select(
        "star_ID", "Magnitude", "clipped_sigma", "CSSD", "IQR", "kurt")


def _class_files(spark, sf):
    lines = _log_lines(spark, sf)
    paths = []
    for name, keep in (("constant", ~F.col("rare")), ("variable", F.col("rare"))):
        path = scratch_path(spark, name)
        lines.where(keep).select("value").write.text(path)
        paths.append(path)
    return paths


@query(f"""
WITH t AS ({_LOG_SQL}), d AS (SELECT min(CSSD) AS delta FROM t)
SELECT star_ID, rare AS variable, round(ln(CSSD - delta + 0.1), 6) AS CSSD,
       clipped_sigma, IQR FROM t, d""")
def labelled_load_shift_log(spark, sf):
    df = load_labelled(spark, _class_files(spark, sf), drop=["Magnitude", "Npts"])
    # Text is split once: the fit and the transform read what came of it.
    df = materialize(df.select("star_ID", "variable", "CSSD", "clipped_sigma", "IQR"), "labelled")
    model = prep.ShiftLog(cols=["CSSD", "Npts"]).fit(df)
    return model.transform(df).select("star_ID", "variable", r6("CSSD", "CSSD"),
                                      "clipped_sigma", "IQR")


@query(f"""
WITH t AS ({_LOG_SQL}), d AS (SELECT min(CSSD) AS delta FROM t WHERE rare = 1)
SELECT star_ID, CSSD AS original,
       CASE WHEN CSSD - delta + 0.1 > 0 THEN round(ln(CSSD - delta + 0.1), 6) END AS transformed
FROM t, d""")
def target_load(spark, sf):
    lines = _log_lines(spark, sf)
    train_path, target_path = scratch_path(spark, "train"), scratch_path(spark, "target")
    lines.where("rare").select("value").write.text(train_path)
    lines.select("value").write.text(target_path)
    model = prep.ShiftLog(cols=["CSSD"]).fit(read_stat_table(spark, train_path))
    target = load_target(spark, target_path).withColumn("original", F.col("CSSD"))
    return model.transform(target).select("star_ID", "original", r6("CSSD", "transformed"))


@query("""
SELECT o_orderstatus AS source, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS variable,
       count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def class_union_label(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    kinds = ["F", "O", "P"]
    parts = [o.where(F.col("o_orderstatus") == k).drop("o_orderstatus") for k in kinds]
    return union_classes(parts, sources=kinds).groupBy("source", "variable").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT CAST(l_quantity AS DOUBLE) AS quantity, l_discount AS discount, l_tax AS tax,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target FROM lineitem""")
def managed_table_scan(spark, sf):
    df = managed_table(spark, f"{sf}/lineitem.parquet")
    named = df.select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
                      F.col("l_tax").alias("tax"),
                      (F.col("l_returnflag") == "R").cast("int").alias("target"))
    return prep.select_features(named, prep.feature_list(named, "target"), "target")


def _catalog_lines(spark, sf):
    """Three catalogue texts made of order keys."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    new = o.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.concat_ws(" ", "o_orderstatus", key, F.lit("extra")).alias("value"))
    cand = o.where(F.col("o_orderpriority") != "5-LOW").select(
        F.concat(F.lit("{'"), key, F.lit("', ")).alias("value"))
    nic = o.where(F.col("o_orderstatus") != "F").select(
        F.concat_ws(" ", F.lit("obj"), key,
                    F.when(F.col("o_orderstatus") == "P", "CST").otherwise("VAR")).alias("value"))
    return new, cand, nic


def _catalogs(spark, sf):
    out = []
    for name, lines, mode in zip(("new", "cand", "nic"), _catalog_lines(spark, sf),
                                 ("token2", "quoted", "token2")):
        path = scratch_path(spark, name)
        lines.write.text(path)
        out.append(read_id_list(spark, path, mode))
    return out


@query("""
SELECT 'new' AS kind, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'candidates', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT 'not_in_cat', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O'""")
def catalog_scans(spark, sf):
    new, cand, nic = _catalogs(spark, sf)
    tag = lambda k, d: d.select(F.lit(k).alias("kind"), "id")
    return tag("new", new).union(tag("candidates", cand)).union(
        tag("not_in_cat", without_marker(nic, "line")))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_totalprice > 250000""")
def id_list_round_trip(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_totalprice") > 250000)
    path = scratch_path(spark, "ids")
    write_ids(o.select(F.concat(F.lit("a_b_c_d_"), F.col("o_orderkey"), F.lit(".dat")).alias("star_ID")),
              path)
    return read_id_list(spark, path, "result").select("id")


# ---------------------------------------------------------------- projections and scalars

@query("""
SELECT c_custkey, c_acctbal, round(ln(c_acctbal - m + 0.1), 6) AS shifted
FROM customer, (SELECT min(c_acctbal) AS m FROM customer)""")
def shift_log(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_acctbal").alias("shifted"))
    model = prep.ShiftLog(cols=["shifted"]).fit(c)
    return model.transform(c).withColumn("shifted", r6("shifted"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS Ex,
       round(ln(c_nationkey + 1), 6) AS RoMS FROM customer""")
def log_columns(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("Ex"), (F.col("c_nationkey") + 1).alias("RoMS"))
    return prep.LogColumns().transform(c).select("c_custkey", r6("Ex", "Ex"), r6("RoMS", "RoMS"))


@query(f"WITH {FF_SQL} SELECT row_id, round(sqrt(price), 6) AS price, round(sqrt(tax), 6) AS tax FROM ff")
def column_function(spark, sf):
    step = prep.ColumnFunction(F.sqrt, ["price", "tax", "absent"])
    return step.transform(ff(spark, sf)).select("row_id", r6("price", "price"), r6("tax", "tax"))


@query(f"WITH {FF_SQL} SELECT row_id, price FROM ff WHERE price IS NOT NULL AND discount IS NOT NULL")
def finite_filter(spark, sf):
    nan = F.lit(float("nan"))
    df = ff(spark, sf).select("row_id", F.coalesce("price", nan).alias("price"), "discount")
    return df.where(finite("price") & finite("discount")).select("row_id", "price")


@query(f"""
WITH {SCORED_SQL}
SELECT row_id, CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS above,
       CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS at_or_above,
       CAST(round(p) AS DOUBLE) AS rounded, round(1 - p, 6) AS p0, round(p, 6) AS p1 FROM scored""")
def binarize_scores(spark, sf):
    return scored(spark, sf).select(
        "row_id", binarize("p").alias("above"), binarize("p", inclusive=True).alias("at_or_above"),
        round_class("p").alias("rounded"), r6(two_class("p")[0], "p0"), r6(two_class("p")[1], "p1"))


@query(f"""
WITH {SCORED_SQL}
SELECT 'drop' AS ties, p > 0.5 AS found, count(*) AS n FROM scored WHERE p <> 0.5 GROUP BY 2
UNION ALL SELECT 'positive', p >= 0.5, count(*) FROM scored GROUP BY 2
UNION ALL SELECT 'negative', p > 0.5, count(*) FROM scored GROUP BY 2""")
def threshold_split(spark, sf):
    s = scored(spark, sf)
    parts = [catalog.threshold_split(s, "p", 0.5, t).groupBy("found").agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(t).alias("ties"), "found", "n") for t in ("drop", "positive", "negative")]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key FROM orders")
def id_key_extract(spark, sf):
    name = F.concat(F.lit("lmc_sc19_i_v_"), F.col("o_orderkey"), F.lit(".fits.dat"))
    return table(spark, sf, "orders").select("o_orderkey", id_key(name).alias("key"))


@query(f"""
WITH {FF_SQL}
SELECT row_id, round((price - lo) / (hi - lo), 6) AS price
FROM ff, (SELECT min(price) AS lo, max(price) AS hi FROM ff)""")
def minmax_normalise(spark, sf):
    return audit.minmax(ff(spark, sf).select("row_id", "price"), "price").select(
        "row_id", r6("price", "price"))


# ---------------------------------------------------------------- audit and statistics

@query(f"""
WITH {FF_SQL}
SELECT source, f AS feature, n AS n_missing FROM (
  SELECT source, count(*) - count(quantity) AS quantity, count(*) - count(price) AS price,
         count(*) - count(discount) AS discount, count(*) - count(tax) AS tax FROM ff GROUP BY 1)
UNPIVOT (n FOR f IN (quantity, price, discount, tax))""")
def missing_audit(spark, sf):
    return audit.missing_audit(ff(spark, sf), FEATURES, "source")


@query(f"WITH {FF_SQL} SELECT min(price) AS price_min, min(quantity) - 20 AS quantity_min FROM ff")
def finite_minimum(spark, sf):
    f = ff(spark, sf).select(F.coalesce("price", F.lit(float("-inf"))).alias("price"),
                             (F.col("quantity") - 20).alias("quantity"))
    return spark.createDataFrame([(finite_min(f, "price"), finite_min(f, "quantity"))],
                                 "price_min double, quantity_min double")


@query(f"""
WITH {FF_SQL}
SELECT median(quantity) AS quantity, median(price) AS price, median(discount) AS discount,
       median(tax) AS tax FROM ff""")
def column_medians(spark, sf):
    df = ff(spark, sf)
    med = quantiles.exact_medians(df, {c: F.col(c) for c in FEATURES})
    return spark.createDataFrame([tuple(med[c] for c in FEATURES)],
                                 ", ".join(f"{c} double" for c in FEATURES))


@query(f"""
WITH {FF_SQL}
SELECT row_id, coalesce(quantity, (SELECT median(quantity) FROM ff)) AS quantity,
       coalesce(price, (SELECT median(price) FROM ff)) AS price,
       coalesce(discount, (SELECT median(discount) FROM ff)) AS discount FROM ff""")
def median_impute(spark, sf):
    df = ff(spark, sf)
    return prep.MedianImputer(cols=FEATURES).fit(df).transform(df).select(
        "row_id", "quantity", "price", "discount")


@query(f"""
WITH {FF_SQL}, s AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp,
                            avg(tax) AS mt, stddev_pop(tax) AS st FROM ff)
SELECT row_id, round((price - mp) / sp, 6) AS price, round((tax - mt) / st, 6) AS tax FROM ff, s""")
def standard_scale(spark, sf):
    df = ff(spark, sf).select("row_id", "price", "tax")
    out = prep.PopulationScaler(cols=["price", "tax"]).fit(df).transform(df)
    return out.select("row_id", r6("price", "price"), r6("tax", "tax"))


@query("""
SELECT p_partkey, round((p_size - lo) / (hi - lo), 6) AS size_scaled,
       round((p_retailprice - plo) / (phi - plo), 6) AS price_scaled
FROM part, (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi,
                   min(p_retailprice) AS plo, max(p_retailprice) AS phi FROM part)""")
def minmax_scaler(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double"), "p_retailprice")
    model = Pipeline(stages=prep.scaler_stages(["p_size", "p_retailprice"], "minmax")).fit(p)
    v = vector_to_array("features")
    return model.transform(p).select("p_partkey", r6(v[0], "size_scaled"), r6(v[1], "price_scaled"))


_FOLDS = """
folds AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5(concat('1:', row_id)), row_id) - 1)
                    % 4 AS fold FROM ff)"""


@query(f"""
WITH {FF_SQL}, {_FOLDS},
pairs AS (SELECT t.f, folds.* FROM folds JOIN (SELECT unnest([0, 1, 2, 3]) AS f) t ON folds.fold <> t.f),
med AS (SELECT f, median(price) AS mp, median(quantity) AS mq FROM pairs GROUP BY f),
st AS (SELECT pairs.f, mp, mq, avg(coalesce(price, mp)) AS ap, stddev_pop(coalesce(price, mp)) AS sp,
              avg(coalesce(quantity, mq)) AS aq, stddev_pop(coalesce(quantity, mq)) AS sq
       FROM pairs JOIN med USING (f) GROUP BY pairs.f, mp, mq)
SELECT row_id, fold::INTEGER AS fold, round((coalesce(price, mp) - ap) / sp, 6) AS price,
       round((coalesce(quantity, mq) - aq) / sq, 6) AS quantity
FROM folds JOIN st ON st.f = folds.fold""")
def fold_safe_scale(spark, sf):
    df = materialize(split.stratified_folds(ff(spark, sf), "y", "row_id", 4), "folds")
    safe = prep.FoldSafe.fit(df, ["price", "quantity"], "fold", 4)
    return safe.held_out(df).select("row_id", "fold", r6("price", "price"), r6("quantity", "quantity"))


@query(f"""
WITH {FF_SQL}
SELECT 'quantity' AS f1, 'price' AS f2, NULL::DOUBLE AS corr WHERE false
UNION ALL SELECT 'price', 'quantity', round(corr(price, quantity), 6) FROM ff
UNION ALL SELECT 'discount', 'quantity', round(corr(discount, quantity), 6) FROM ff
UNION ALL SELECT 'tax', 'quantity', round(corr(tax, quantity), 6) FROM ff
UNION ALL SELECT 'discount', 'price', round(corr(discount, price), 6) FROM ff
UNION ALL SELECT 'tax', 'price', round(corr(tax, price), 6) FROM ff
UNION ALL SELECT 'tax', 'discount', round(corr(tax, discount), 6) FROM ff""")
def correlation_lower(spark, sf):
    return audit.correlation_pairs(ff(spark, sf), FEATURES).withColumn("corr", r6("corr"))


_HIST = " UNION ALL ".join(f"""
SELECT '{c}' AS feature, CAST(least(floor(({c} - lo) * 100 / (hi - lo)), 99) AS INTEGER) AS bin,
       count(*) AS n FROM ff, (SELECT min({c}) AS lo, max({c}) AS hi FROM ff)
WHERE {c} IS NOT NULL GROUP BY 2""" for c in FEATURES)


@query(f"WITH {FF_SQL} {_HIST}")
def feature_histogram(spark, sf):
    return audit.histogram(ff(spark, sf), FEATURES, 100)


def _calibration_sql(bins):
    return f"""
n AS (SELECT *, (p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w) AS q
      FROM rows WINDOW w AS (PARTITION BY fold))
SELECT fold, CAST(least(floor(q * {bins}), {bins - 1}) AS INTEGER) AS bin,
       round(avg(q), 6) AS mean_score, round(avg(y), 6) AS fraction_positive, count(*) AS n
FROM n GROUP BY 1, 2"""


@query(f"""
WITH {SCORED_SQL}, rows AS (SELECT 0 AS fold, p_price AS p, rare AS y FROM scored),
{_calibration_sql(5)}""")
def calibration_bins(spark, sf):
    return audit.reliability(scored(spark, sf), "rare", "p_price", 5).select(
        F.lit(0).alias("fold"), "bin", r6("mean_score", "mean_score"),
        r6("fraction_positive", "fraction_positive"), "n")


_SFOLDS = """
folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY rare ORDER BY md5(concat('1:', row_id)), row_id)
                    - 1) % 4 AS INTEGER) AS fold FROM scored)"""


def _scored_folds(spark, sf):
    return materialize(split.stratified_folds(scored(spark, sf), "rare", "row_id", 4), "scored_folds")


@query(f"""
WITH {SCORED_SQL}, {_SFOLDS}, rows AS (SELECT fold, p_price AS p, rare AS y FROM folds),
{_calibration_sql(4)}""")
def calibration_by_fold(spark, sf):
    return audit.reliability(_scored_folds(spark, sf), "rare", "p_price", 4, ["fold"]).select(
        "fold", "bin", r6("mean_score", "mean_score"),
        r6("fraction_positive", "fraction_positive"), "n")


@query("""
SELECT doc_id, quality, round(CASE WHEN quality = 1 THEN n / (2.0 * p) ELSE n / (2.0 * (n - p)) END, 6) AS weight
FROM labels, (SELECT count(*) AS n, sum(quality) AS p FROM labels)""")
def balanced_weights(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return prep.class_weights(lab, "quality").withColumn("weight", r6("weight"))


# ---------------------------------------------------------------- splits

@query("""
SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus
   ORDER BY md5(concat('1:', o_orderkey)), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders""")
def stratified_kfold(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_folds(o, "o_orderstatus", "o_orderkey", 5).select("o_orderkey", "fold")


@query("""
SELECT rep, o_orderkey, CASE WHEN row_number() OVER w <= round(count(*) OVER (PARTITION BY rep, o_orderstatus) * 0.25)
       THEN 'test' ELSE 'train' END AS split
FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS rep)
WINDOW w AS (PARTITION BY rep, o_orderstatus ORDER BY md5(concat(rep, ':', o_orderkey)), o_orderkey)""")
def stratified_shuffle_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_split(o, "o_orderstatus", "o_orderkey", 0.25, seed=1, n_reps=5).select(
        F.col("seed").alias("rep"), "o_orderkey", "split")


@query("""
WITH a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY md5(concat('1:', doc_id)), doc_id)
        <= round(count(*) OVER (PARTITION BY toxic) * 0.33) THEN 'test' ELSE 'train' END AS s FROM labels),
b AS (SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY md5(concat('2:', doc_id)), doc_id)
        <= round(count(*) OVER (PARTITION BY toxic) * 0.5) THEN 'train2' ELSE 'train1' END AS s2
      FROM a WHERE s = 'train')
SELECT a.doc_id, coalesce(s2, s) AS split FROM a LEFT JOIN b ON a.doc_id = b.doc_id""")
def nested_split(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    outer = split.stratified_split(lab, "toxic", "doc_id", 0.33, seed=1)
    return split.nested_split(outer, "toxic", "doc_id", 0.5, seed=2).select("doc_id", "split")


@query("""
SELECT seed, doc_id, CAST((row_number() OVER (PARTITION BY seed, quality
   ORDER BY md5(concat(seed, ':', doc_id)), doc_id) - 1) % 4 AS INTEGER) AS fold
FROM labels, (SELECT unnest(range(1, 97, 8))::INTEGER AS seed)""")
def repeated_kfold(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return split.stratified_folds(lab, "quality", "doc_id", 4, range(1, 97, 8)).select(
        "seed", "doc_id", "fold")


@query("""
SELECT o_orderkey, CASE WHEN r <= round(n * 0.1) THEN 0.1::DOUBLE WHEN r <= round(n * 0.325) THEN 0.325
   WHEN r <= round(n * 0.55) THEN 0.55 WHEN r <= round(n * 0.775) THEN 0.775 ELSE 1.0 END AS min_fraction
FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus
        ORDER BY md5(concat('1:', o_orderkey)), o_orderkey) AS r,
      count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""")
def train_subsets(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.train_subsets(o, "o_orderstatus", "o_orderkey").select("o_orderkey", "min_fraction")


# ---------------------------------------------------------------- metrics

_CM = """sum(CASE WHEN y = 0 AND NOT z THEN 1 ELSE 0 END)::BIGINT AS tn,
sum(CASE WHEN y = 0 AND z THEN 1 ELSE 0 END)::BIGINT AS fp,
sum(CASE WHEN y = 1 AND NOT z THEN 1 ELSE 0 END)::BIGINT AS fn,
sum(CASE WHEN y = 1 AND z THEN 1 ELSE 0 END)::BIGINT AS tp"""
_PRF = """round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"""
_ROWS = "rows AS (SELECT rare AS y, p_price > 0.5 AS z, p_price AS p FROM scored)"


def _predicted(spark, sf):
    return scored(spark, sf).withColumn("pred", binarize("p_price"))


@query(f"WITH {SCORED_SQL}, {_ROWS}, c AS (SELECT {_CM} FROM rows) SELECT *, {_PRF} FROM c")
def confusion_prf(spark, sf):
    out = metrics.prf(metrics.confusion(_predicted(spark, sf), "rare", "pred"))
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(f"""
WITH {SCORED_SQL}, {_SFOLDS}, rows AS (SELECT fold, rare AS y, p_price > 0.5 AS z FROM folds),
f AS (SELECT fold, {_CM} FROM rows GROUP BY fold),
c AS (SELECT sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp)::BIGINT AS tp FROM f)
SELECT *, {_PRF} FROM c""")
def pooled_f1(spark, sf):
    df = split.stratified_folds(_predicted(spark, sf), "rare", "row_id", 4)
    out = metrics.prf(metrics.pooled(metrics.confusion(df, "rare", "pred", ["fold"])))
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(f"""
WITH {SCORED_SQL}, {_ROWS}
SELECT round(avg(CASE WHEN (y = 1) = z THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy,
       round(1 - avg(CASE WHEN (y = 1) = z THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS error FROM rows""")
def accuracy(spark, sf):
    return metrics.accuracy(_predicted(spark, sf), "rare", "pred").select(
        r6("accuracy", "accuracy"), r6("error", "error"))


@query(f"""
WITH {SCORED_SQL}, {_ROWS}, c AS (SELECT {_CM} FROM rows)
SELECT round((2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp))
             / (tn + fp + fn + tp), 6) AS weighted_f1 FROM c""")
def weighted_f1(spark, sf):
    return metrics.weighted_f1(_predicted(spark, sf), "rare", "pred").select(
        r6("weighted_f1", "weighted_f1"))


@query(f"""
WITH {SCORED_SQL}, {_ROWS}, c AS (SELECT {_CM} FROM rows)
SELECT round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS fbeta FROM c""")
def fbeta(spark, sf):
    return metrics.fbeta(_predicted(spark, sf), "rare", "pred", 2.0).select(r6("fbeta", "fbeta"))


@query(f"""
WITH {SCORED_SQL}, q AS (SELECT rare AS y, greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, p_discount)) AS p FROM scored)
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM q""")
def log_loss(spark, sf):
    return metrics.log_loss(scored(spark, sf), "rare", "p_discount").select(r6("log_loss", "log_loss"))


@query(f"""
WITH {SCORED_SQL}, {_ROWS}, c AS (SELECT {_CM} FROM rows)
SELECT round(1 - 2 * tp / (2 * tp + fp + fn), 6) AS one_minus_f1 FROM c""")
def user_metric(spark, sf):
    return metrics.custom_metric(scored(spark, sf), metrics.f1_loss, "rare", "p_price").select(
        r6("value", "one_minus_f1"))


@query(f"""
WITH {SCORED_SQL}, {_SFOLDS}, rows AS (SELECT fold, rare AS y, p_price > 0.5 AS z FROM folds),
f AS (SELECT fold, {_CM} FROM rows GROUP BY fold),
g AS (SELECT 2 * tp / (2 * tp + fp + fn) AS f1 FROM f)
SELECT round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std, count(*) AS n FROM g""")
def fold_score_summary(spark, sf):
    df = split.stratified_folds(_predicted(spark, sf), "rare", "row_id", 4)
    per = metrics.prf(metrics.confusion(df, "rare", "pred", ["fold"]))
    return metrics.summarise_scores(per, "f1").select(r6("mean", "mean"), r6("std", "std"), "n")


# ---------------------------------------------------------------- sets

_SETS = """
news AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
cand AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority <> '5-LOW'),
nic AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus = 'P' AS cst FROM orders
        WHERE o_orderstatus <> 'F'),
truth AS (SELECT id FROM news
          UNION (SELECT id FROM cand EXCEPT SELECT id FROM nic)
          UNION SELECT id FROM nic WHERE NOT cst)"""


@query(f"WITH {_SETS} SELECT id FROM truth")
def truth_ids(spark, sf):
    return catalog.truth_ids(*_catalogs(spark, sf))


@query(f"""
WITH {_SETS}, f AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id FROM lineitem WHERE l_quantity / 50 > 0.9),
m AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id FROM lineitem WHERE l_quantity / 50 < 0.9),
c AS (SELECT (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM m) AS nm,
        (SELECT count(*) FROM f JOIN truth USING (id)) AS tp, (SELECT count(*) FROM m JOIN truth USING (id)) AS fn,
        (SELECT count(*) FROM f JOIN news USING (id)) AS new_found,
        (SELECT count(*) > 0 FROM f WHERE id = '100') AS probe_found)
SELECT new_found, probe_found, nm - fn AS tn, nf - tp AS fp, fn, tp,
       round(tp / nullif(nf, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
       round(2 * tp / nullif(2 * tp + (nf - tp) + fn, 0), 6) AS f1 FROM c""")
def catalog_match(spark, sf):
    s = table(spark, sf, "lineitem").select(
        F.concat(F.lit("a_b_c_d_"), F.col("l_orderkey"), F.lit(".dat")).alias("star_ID"),
        (F.col("l_quantity") / 50).alias("p"))
    new, cand, nic = _catalogs(spark, sf)
    out = catalog.catalog_match(s, new, cand, nic, "star_ID", "p", 0.9, probe="100", key_field=5)
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


# ---------------------------------------------------------------- patience

@query("""
WITH h AS (SELECT event_type, event_id AS r, value AS v FROM events),
b AS (SELECT event_type, r, v, min(v) OVER w AS best,
             arg_min(r, v) OVER w AS best_r FROM h
      WINDOW w AS (PARTITION BY event_type ORDER BY r ROWS UNBOUNDED PRECEDING)),
s AS (SELECT event_type, min(r) FILTER (WHERE r - best_r >= 3000) AS stop, max(r) AS last_r FROM b GROUP BY 1)
SELECT b.event_type, best_r AS best_iteration, round(best, 6) AS best_value, r AS last_iteration,
       stop IS NOT NULL AS stopped
FROM b JOIN s ON b.event_type = s.event_type AND b.r = coalesce(s.stop, s.last_r)""")
def patience_rule(spark, sf):
    h = table(spark, sf, "events").select("event_type", "event_id", "value")
    return history.patience_rule(h, 3000, ["event_type"], "event_id", "value").withColumn(
        "best_value", r6("best_value"))


@query("""
SELECT user_id % 100 AS iteration, round(avg(value), 6) AS value, round(stddev_pop(value), 6) AS std
FROM events GROUP BY 1""")
def mean_history(spark, sf):
    h = table(spark, sf, "events").select(F.pmod("user_id", F.lit(100)).alias("iteration"), "value")
    return history.mean_history(h).select("iteration", r6("value", "value"), r6("std", "std"))
