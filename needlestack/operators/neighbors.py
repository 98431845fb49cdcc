"""Exact k nearest neighbours between two distributed tables, and what is built on it.

Train rows are cut into cells around pivot vectors (the partition scheme of Lu et
al., "Efficient Processing of k Nearest Neighbor Joins using MapReduce", 2012). The
triangle inequality gives each query an upper bound on its k-th distance, and the
query is sent only to cells that can hold something nearer. Cells are cut into chunks
of bounded size on both sides, so neither a dense region nor many copies of one vector
lands in one task, and what a task holds doesn't grow with the tables. Tasks return at
most k rows per query and chunk; a grouped limit merges them. Nothing is pruned that
could be a neighbour, so the result is exact. Vectors of floats travel as floats;
distances are in doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.scratch import materialize

BLOCK_ROWS = 20_000
QUERY_ROWS = 20_000
#: Queries that meet the same rows go to so many chunks where they are few, but not below so many rows a chunk.
SPREAD, LEAST_QUERIES = 16, 1000
MAX_CELLS = 1024
#: Pairs of rows, or of rows and pivots, that a task holds at a time.
PAIRS_AT_ONCE = 1_000_000


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _vector(df: DataFrame, vec: str) -> Column:
    """The vector column as `vec`, in floats where it is stored so and in doubles otherwise."""
    kind = df.select(vec).schema[0].dataType
    floats = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col(vec).cast("array<float>" if floats else "array<double>").alias("vec")


def _chunk_rows(queries: int, query_rows: int) -> int:
    """Queries a chunk, where `queries` of them meet the same rows."""
    return min(query_rows, max(LEAST_QUERIES, -(-queries // SPREAD)))


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def _cell_udf(pivots: np.ndarray):
    @F.pandas_udf("cell int, away double")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            at, away = np.empty(len(v), dtype="int32"), np.empty(len(v))
            for part, x in _slices(v, len(pivots)):
                d = _pivot_distances(x, pivots)
                at[part] = d.argmin(axis=1)
                away[part] = d[np.arange(len(d)), at[part]]
            yield pd.DataFrame({"cell": at, "away": away})
    return cell


def _slices(v: pd.Series, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Parts of a batch, of so many rows that `width` numbers for each of them stay bounded."""
    step = max(1, PAIRS_AT_ONCE // max(width, 1))
    for s in range(0, len(v), step):
        yield slice(s, s + step), _matrix(v.iloc[s:s + step])


def _targets_udf(pivots, low, high, kth, counts, k):
    """Cells that may hold one of the k nearest of each query."""

    def visited(x: np.ndarray) -> list:
        d = _pivot_distances(x, pivots)
        bound = (d + kth).min(axis=1)
        far = d + high
        order = np.argsort(far, axis=1)
        enough = np.cumsum(counts[order], axis=1) >= k
        reach = np.where(enough.any(axis=1), enough.argmax(axis=1), len(pivots) - 1)
        row = np.arange(len(x))
        total = np.where(enough.any(axis=1), far[row, order[row, reach]], np.inf)
        bound = np.minimum(bound, total)
        least = np.maximum(d - high, low - d)
        least = np.maximum(least, (d - d.min(axis=1, keepdims=True)) / 2.0)
        keep = (least <= (bound * (1 + 1e-9) + 1e-9)[:, None]) & (counts > 0)
        return [np.flatnonzero(r).astype("int32") for r in keep]

    @F.pandas_udf("array<int>")
    def targets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series([c for _, x in _slices(v, len(pivots)) for c in visited(x)], dtype=object)
    return targets


def _once(df: pd.DataFrame, x: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows of equal id and vector as one, with their matrix."""
    if not df["id"].duplicated().any():
        return df, x
    once = ~pd.DataFrame({"id": df["id"].to_numpy(), "vec": [v.tobytes() for v in x]}).duplicated().to_numpy()
    return df[once], x[once]


def _block_nearest(q: pd.DataFrame, t: pd.DataFrame, k: int, exclude_self: bool,
                   payload: Sequence[str], meets: Callable | None = None) -> pd.DataFrame:
    """The k nearest train rows of each query of one chunk, ties by id.

    With `meets`, which takes both matrices and gives for some of the queries the rows they may meet, only among those;
    rows, and queries, of equal id and vector are then one."""
    names = ["query_id", "neighbor_id", "distance", *payload]
    if q.empty or t.empty:
        return pd.DataFrame({n: [] for n in names})
    qx, tx = _matrix(q["vec"]), _matrix(t["vec"])
    if meets:
        (q, qx), (t, tx) = _once(q, qx), _once(t, tx)
    want = min(k + int(exclude_self), len(t))
    ids = pd.factorize(pd.concat([q["id"], t["id"]]))[0] if meets and exclude_self else None
    t2 = (tx ** 2).sum(axis=1)
    step = max(1, PAIRS_AT_ONCE // len(t))
    met = meets(qx, tx) if meets else None
    parts = []
    for s in range(0, len(q), step):
        x = qx[s:s + step]
        x2 = (x ** 2).sum(axis=1)
        rough = x2[:, None] + t2[None, :] - 2.0 * (x @ tx.T)
        held = met(slice(s, s + step)) if met else None
        if ids is not None:                     # a repeated id has several rows to leave out
            own = ids[s:min(s + step, len(q))][:, None]
            held &= (own != ids[None, len(q):]) | (own < 0)
        if held is not None:
            rough[~held] = np.inf
        kth = np.partition(rough, want - 1, axis=1)[:, want - 1]
        slack = 1e-9 * (x2 + t2.max() + 1.0)
        near = rough <= (kth + slack)[:, None]
        qi, ti = np.nonzero(near if held is None else near & held)
        dist = np.empty(len(qi))
        for a in range(0, len(qi), 200_000):
            diff = x[qi[a:a + 200_000]] - tx[ti[a:a + 200_000]]
            dist[a:a + 200_000] = np.sqrt((diff ** 2).sum(axis=1))
        near = pd.DataFrame({
            "query_id": q["id"].to_numpy()[s + qi], "neighbor_id": t["id"].to_numpy()[ti],
            "distance": dist, **{c: t[c].to_numpy()[ti] for c in payload}})
        if exclude_self:
            near = near[near["query_id"] != near["neighbor_id"]]
        near = near.sort_values(["query_id", "distance", "neighbor_id"], kind="stable")
        parts.append(near.groupby("query_id", sort=False).head(k))
    return pd.concat(parts)[names]


def _partition(t: DataFrame, q: DataFrame, need: int, cells: int):
    """Train rows with their cell, queries with the cells they must visit, rows per cell.

    Both are written once, since several jobs read them. The driver sees a bounded
    number of pivots and a few numbers per cell.
    """
    # Distinct first, or many copies of one vector could take every pivot.
    first = t.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(cells).collect()
    pivots = np.unique(np.array([r["vec"] for r in first], dtype=np.float64), axis=0)
    t = t.withColumn("c", _cell_udf(pivots)("vec")).select("*", "c.cell", "c.away").drop("c")
    t = materialize(t, "knn_train")
    by_distance = Window.partitionBy("cell").orderBy("away")
    shape = t.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"),
                                  F.max("away").alias("high")).collect()
    # The limit per cell is applied before the shuffle, so a crowded cell stays cheap.
    closest = (
        t.select("cell", "away").withColumn("r", F.row_number().over(by_distance))
        .where(F.col("r") <= need).groupBy("cell")
        .agg(F.max("away").alias("kth"), F.count(F.lit(1)).alias("m"))
    ).collect()
    p = len(pivots)
    low, high, kth = np.zeros(p), np.zeros(p), np.full(p, np.inf)
    counts = np.zeros(p, dtype=np.int64)
    for r in shape:
        counts[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    for r in closest:
        if r["m"] >= need:
            kth[r["cell"]] = r["kth"]
    q = q.withColumn("cells", _targets_udf(pivots, low, high, kth, counts, need)("vec"))
    return t.drop("away"), materialize(q, "knn_query"), counts


def nearest(query: DataFrame, train: DataFrame, k: int, vec: str, id_col: str,
            exclude_self: bool = False, payload: Sequence[str] = (),
            block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
            max_cells: int = MAX_CELLS) -> DataFrame:
    """(query_id, neighbor_id, distance, rank, payload) for the k nearest train rows.

    `payload` columns of the train row come along. Ties break by neighbour id.
    """
    payload = list(payload)
    t = train.select(F.col(id_col).alias("id"), _vector(train, vec), *payload)
    q = query.select(F.col(id_col).alias("id"), _vector(query, vec))
    need = k + int(exclude_self)

    n = t.count()
    cells = max(1, min(max_cells, -(-n // block_rows)))
    if cells == 1:
        counts = [n]
        t, q = t.withColumn("cell", F.lit(0)), q.withColumn("cell", F.lit(0))
        loads = {0: q.count()}
    else:
        t, q, counts = _partition(t, q, need, cells)
        q = q.withColumn("cell", F.explode("cells")).drop("cells")
        loads = {r["cell"]: r["m"] for r in q.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).collect()}
    out = _result(query.schema[id_col].dataType, train.schema[id_col].dataType, train, payload)
    return _meet(t, q, counts, loads, k, exclude_self, payload, out, block_rows, query_rows)


def _result(query_id: T.DataType, train_id: T.DataType, train: DataFrame, payload: Sequence[str]) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", query_id), T.StructField("neighbor_id", train_id),
        T.StructField("distance", T.DoubleType()),
        *[T.StructField(c, train.schema[c].dataType) for c in payload]])


def _meet(t: DataFrame, q: DataFrame, counts, loads: dict[int, int], k: int, exclude_self: bool,
          payload: Sequence[str], schema: T.StructType, block_rows: int, query_rows: int) -> DataFrame:
    """Rows and queries of each cell compared in chunks, and the k nearest of all chunks."""
    plan = t.sparkSession.createDataFrame(
        [(c, int(max(1, -(-counts[c] // block_rows))), int(max(1, -(-m // _chunk_rows(m, query_rows)))))
         for c, m in loads.items()], "cell int, t_chunks int, q_chunks int")
    near = _compare(t, q, F.broadcast(plan), k, exclude_self, payload, schema)
    best = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _compare(t: DataFrame, q: DataFrame, plan: DataFrame, k: int, exclude_self: bool, payload: Sequence[str],
             schema: T.StructType, meets: Callable | None = None) -> DataFrame:
    """The k nearest rows of each query in each chunk; `plan` says into how many chunks a cell's two sides are cut."""
    def spread(df, own, own_n, other, other_n):
        return (df.join(plan, "cell")
                .withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
                .drop("t_chunks", "q_chunks"))

    tq = spread(t, "tc", "t_chunks", "qc", "q_chunks")
    qq = spread(q, "qc", "q_chunks", "tc", "t_chunks")
    keys = ["cell", "tc", "qc"]
    return qq.groupBy(*keys).cogroup(tq.groupBy(*keys)).applyInPandas(
        lambda a, b: _block_nearest(a, b, k, exclude_self, payload, meets), schema)


def inverse_distance(neighbors: DataFrame, label: str, out: str = "p") -> DataFrame:
    """(query_id, out): labels weighted by 1/distance; neighbours at distance 0 decide alone."""
    at_zero = F.col("distance") == 0
    y = F.col(label).cast("double")
    w = F.try_divide(F.lit(1.0), F.col("distance"))
    exact = F.avg(F.when(at_zero, y))
    soft = F.try_divide(F.sum(F.when(~at_zero, w * y)), F.sum(F.when(~at_zero, w)))
    return neighbors.groupBy("query_id").agg(F.coalesce(exact, soft).alias(out))


def oversample(df: DataFrame, label: str, id_col: str, cols: Sequence[str], ratio: float,
               k: int = 5, seed: int = 1) -> DataFrame:
    """New minority rows between a minority row and one of its k minority neighbours.

    Enough rows are made to bring minority/majority to `ratio`. Base row, neighbour and
    position all follow from md5 of (seed, copy, id), so a rerun gives the same rows.
    Returns (id, copy, cols...) for the new rows only.
    """
    from .ordered import hashed_ordinal
    counts = df.agg(F.count_if(F.col(label) == 1).alias("m"),
                    F.count_if(F.col(label) == 0).alias("n")).first()
    m, need = counts["m"], int(ratio * counts["n"]) - counts["m"]
    if m < 2 and need > 0:
        raise ValueError("new rows lie between two minority rows; there are fewer than two")
    k = max(1, min(k, m - 1))
    minority = df.where(F.col(label) == 1).select(F.col(id_col).alias("id"), *cols)
    theirs = [f"their_{c}" for c in cols]
    vec = minority.select("id", F.array(*cols).alias("vec"),
                          *[F.col(c).alias(t) for c, t in zip(cols, theirs)])
    near = nearest(vec, vec, k, "vec", "id", exclude_self=True, payload=theirs)
    turn = hashed_ordinal(minority.withColumn("seed", F.lit(seed)), ["seed"], "id", "seed")
    copies = F.expr(f"CAST(floor(({max(need, 0)} - ordinal) / {max(m, 1)}) + 1 AS INT)")
    base = turn.where(F.col("ordinal") <= max(need, 0)).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), copies)))
    h = F.md5(F.concat_ws(":", F.lit(seed), "copy", "id"))
    number = lambda start: F.conv(F.substring(h, start, 8), 16, 10).cast("long")
    base = base.withColumns({"rank": (F.pmod(number(1), F.lit(k)) + 1).cast("int"),
                             "gap": number(9) / F.lit(float(2 ** 32))})
    pick = near.select(F.col("query_id").alias("id"), "rank", *theirs)
    made = base.join(pick, ["id", "rank"])
    return made.select("id", "copy", *[
        (F.col(c) + F.col("gap") * (F.col(t) - F.col(c))).alias(c) for c, t in zip(cols, theirs)])
