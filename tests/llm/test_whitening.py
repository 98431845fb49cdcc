"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
from pyspark.sql import functions as F, types as T

from needlestack.llm.queries import op13_embedding_whitening
from needlestack.llm.whitening import FitList, jacobi_davidson, minres, whiten

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                     T.StructField("label", T.IntegerType())])


def expected(rows, k=4):
    used = [(i, v) for i, v, *_ in rows if v is not None and None not in v and np.isfinite(v).all()]
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in used], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s).astype(np.float64) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    w = (x * n - s).astype(np.float64) / n @ q / np.sqrt(e)
    deviation = ((x * n - s) ** 2).sum(axis=1)
    return [i for i, _ in used], n, deviation.tolist(), w, e / (np.square(c).sum() / n)


def held(got, rows):
    ids, n, deviation, w, explained = expected(rows)
    out = {}
    for r in got:
        out.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == 4 * len(ids) and {r.n for r in got} == {n}
    signs = {}
    for at, i in enumerate(ids):
        for j in range(4):
            r = out[i, j + 1].pop()
            sign = signs.setdefault(j, np.sign(w[at, j]) * np.sign(r.whitened))
            assert r.deviation == deviation[at]
            assert abs(r.whitened - sign * w[at, j]) < 1e-8
            assert abs(r.explained / explained[j] - 1) < 1e-10
            assert r.identity_error < 1e-9
    assert not any(out.values())


def test_query_equals_numpy(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = op13_embedding_whitening(spark, sf)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
                          ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    held(got.collect(), rows)


def hard_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.standard_normal(8) * np.arange(1, 9)], i % 3) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(120)]                  # one vector of a third of all rows
    rows += [(5, rows[5][1], None), (None, rows[6][1], 1)]
    bad = [(2000, None, 1), (2001, [None] * 8, 1), (2002, [float("nan")] + [0.0] * 7, 1), (2003, [float("inf")] * 8, 1)]
    return rows, bad


def test_repeats_and_unusable_vectors(spark, tmp_path):
    rows, bad = hard_rows()
    spark.createDataFrame(rows + bad, ROWS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    held(op13_embedding_whitening(spark, str(tmp_path)).collect(), rows)


def test_empty_single_ragged_and_flat(spark, tmp_path):
    assert whiten(spark.createDataFrame([], ROWS)).count() == 0
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], ROWS)).collect()
    assert [(r.n, r.deviation, r.whitened) for r in one] == [(1, 0, [])] * 2
    ragged = [(i, [float(i), 0.0, 1.0], 0) for i in range(5)] + [(9, [1.0], 0), (10, [], 0), (11, [3e38] * 3, 0)]
    out = whiten(spark.createDataFrame(ragged, ROWS)).collect()
    assert sorted(r.row.vec_id for r in out) == list(range(5))
    assert {len(r.whitened) for r in out} == {1} and abs(out[0].explained[0] - 1) < 1e-12
    assert abs(np.mean([r.whitened[0] ** 2 for r in out]) - 1) < 1e-12


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(0, [0.0], 0), (1, [1e11], 0), (2, [2.0], 0)]
    got = {r.row.vec_id: r.deviation for r in whiten(spark.createDataFrame(rows, ROWS)).collect()}
    x = [int(256 * float(np.float32(v[0]))) for _, v, _ in rows]
    want = {i: (3 * v - sum(x)) ** 2 for i, v in enumerate(x)}
    assert got == {i: d if d < 1 << 63 else None for i, d in want.items()} and None in got.values()


def test_clashing_names(spark):
    rows, _ = hard_rows()
    wide = spark.createDataFrame(rows, ROWS)
    for name in ("row", "x", "n", "slot", "part", "d", "count", "vector", "whitened", "a.b"):
        wide = wide.withColumn(name, F.lit(1))
    wide = wide.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    out = whiten(wide)
    assert out.count() == len(rows)
    assert set(out.schema["row"].dataType.names) == set(wide.columns) - {"embedding"}


def test_many_tasks_add_up_in_groups(spark):
    rows, _ = hard_rows()
    packed = [(np.floor(256 * np.array(v)).astype("<i8").tobytes(),) for _, v, _ in rows]
    many = FitList(spark.createDataFrame(packed, "x binary").repartition(100), 8)
    few = FitList(spark.createDataFrame(packed, "x binary").coalesce(3), 8)
    assert many.parts == 100 and many.n == few.n and (many.sums == few.sums).all()
    u = np.eye(8)[:, :3]
    assert np.abs(many.product(u) - few.product(u)).max() < 1e-12 * np.abs(few.product(u)).max()


def test_eigenvectors_of_close_equal_and_no_values():
    rng = np.random.default_rng(0)
    for d in (1, 2, 5, 64, 300):
        a = rng.standard_normal((d + 3, d)) * np.linspace(1, 2, d)
        a = a.T @ a / d
        values, vectors = jacobi_davidson(lambda u: a @ u, d, 4)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:len(values)]).max() < 1e-13 * values[0]
        assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-13 * values[0]
    for diagonal in ([5, 5, 5, 5, 1, 0], [0] * 6, [1, 0, 0, 0, 0, 0], [3, 3 - 1e-9, 3 - 2e-9, 1, 1, 1]):
        a = np.diag(np.array(diagonal, dtype=float))
        values, vectors = jacobi_davidson(lambda u: a @ u, 6, 4)
        assert np.abs(values - sorted(diagonal)[::-1][:4]).max() < 1e-14
        assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    shifts, right = np.array([0.3, -1.0, 2.0]), rng.standard_normal((20, 3))
    right[:, 1] = 0
    x = minres(lambda v: a @ v - v * shifts, right, 40)
    assert np.abs(a @ x - x * shifts - right).max() < 1e-8
