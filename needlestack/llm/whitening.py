"""Embedding whitening by a block Jacobi-Davidson method on distributed products.

Entries become whole numbers, x = floor(scale * c). The leading eigenvectors of the
covariance of the distinct x vectors are found without ever forming the covariance: all
that leaves the executors are its products with a few vectors, each one pass over the
table of distinct vectors, centred before multiplying. The search space starts with
seeded vectors; each round takes the best Ritz vectors in it, locks those whose residual
is down to double precision, and extends it by the solutions of the projected correction
equations of the others, (1 - Q Q') (V - e) (1 - Q Q') t = -r, by a few steps of MINRES.
The corrections of a round run side by side, so a step of all of them is one pass. The
driver holds vectors of the embedding's dimension only, never rows or a fingerprint of them.

The partial sums of a task are one row; with more than `SLOTS` tasks, Spark adds them up
in that many groups first.

Nulls and the rest: a row without a vector, or with a null, NaN or infinite entry, is
dropped, and so is one with another number of entries than most rows have (of equal
counts the larger number; an empty vector has no entries to whiten and is dropped as
well) and one whose scaled entries are 2^48 or more. Repeated vectors are fitted once
and every row is returned. Components of no variance (up to rounding) can't be whitened
and are left out, so a table of one distinct vector returns nothing, as an empty one
does. A component's sign is that of its largest entry. `deviation` is exact, or null
where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import materialize

SCALE = 256
COMPONENTS = 4
SLOTS = 64
INNER_STEPS = 3
SPACE = 48
ROUNDS = 200
LONGEST = 1 << 48
EPS = float(np.finfo(np.float64).eps)


def quantised(rows: DataFrame, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(row, x): x holds floor(scale * entry) as 64-bit integers; rows that can't be used are gone."""
    others = [c for c in rows.columns if c != vector_col]
    plain = rows.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row") if others else F.struct(F.lit(0)).alias("row"),
                        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    schema = T.StructType([plain.schema["row"], T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for vector in batch.column(1):
                c = vector.values.to_numpy(zero_copy_only=False) if vector.is_valid and vector.values.null_count == 0 else None
                scaled = np.floor(scale * c) if c is not None and len(c) else None
                usable = scaled is not None and (np.abs(scaled) < LONGEST).all()        # false for NaN and infinity
                made.append(scaled.astype("<i8").tobytes() if usable else None)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=schema.names)
            yield out.filter(out.column(1).is_valid())
    return plain.mapInArrow(run, schema)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch, as one array of whole numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(len(column), d)


def _centring(n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Subtracts the mean in two parts, a whole number and a fraction, so that nothing is lost."""
    high = np.array([int(s) // max(1, n) for s in sums], dtype=np.int64)
    low = np.array([int(s) % max(1, n) / max(1, n) for s in sums], dtype=np.float64)
    return lambda x: (x - high) - low


class FitList:
    """The distinct vectors as a table, and sums over it."""

    def __init__(self, distinct: DataFrame, dimension: int):
        self.table, self.d = distinct, dimension
        self.parts = distinct.rdd.getNumPartitions()
        # Whole numbers below LONGEST can't overflow within a batch.
        whole = self._summed(lambda x: np.append(x.sum(axis=0), len(x)).astype(object), "decimal(38,0)", int)
        whole = np.zeros(dimension + 1, dtype=object) if whole is None else whole
        self.n, self.sums = int(whole[-1]), whole[:-1]
        self.centred = _centring(self.n, self.sums)

    def _summed(self, of_batch: Callable[[np.ndarray], np.ndarray], kind: str = "double", make=float) -> np.ndarray:
        """The sum over all batches of an array made from each one. Tasks add up in extended precision."""
        d, slots = self.d, SLOTS
        fields = f"slot int, part array<{kind}>"
        arrow = pa.list_(pa.decimal128(38, 0) if make is int else pa.float64())

        def rows(total: np.ndarray, slot: int) -> pa.RecordBatch:
            values = [make(v) for v in total.ravel()]
            return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([values], arrow)], names=["slot", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            total = None
            for batch in batches:
                if len(batch):
                    own = of_batch(_matrix(batch.column(0), d))
                    own = own if make is int else own.astype(np.longdouble)
                    total = own if total is None else total + own
            if total is not None:
                yield rows(total, TaskContext.get().partitionId() % slots)

        def join(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, slot = None, 0
            for batch in group:
                slot = batch.column(0)[0].as_py()
                for part in batch.column(1).to_pylist():
                    own = np.array(part, dtype=object if make is int else np.longdouble)
                    total = own if total is None else total + own
            yield rows(total, slot)

        parts = self.table.mapInArrow(add, fields)
        if self.parts > slots:
            parts = parts.groupBy("slot").applyInArrow(join, fields)
        total = None
        for row in sorted(parts.collect(), key=lambda r: r["slot"]):
            own = np.array([make(v) for v in row["part"]], dtype=object if make is int else np.longdouble)
            total = own if total is None else total + own
        return total if make is int or total is None else total.astype(np.float64)

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance times some vectors (d x k): one pass."""
        centred = self.centred

        def of_batch(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ vectors)
        return self._summed(of_batch).reshape(self.d, -1) / self.n

    def trace(self) -> float:
        """The covariance's trace."""
        centred = self.centred
        return float(self._summed(lambda x: np.array([np.square(centred(x)).sum()]))[0]) / self.n

    def second_moments(self, components: np.ndarray, eigenvalues: np.ndarray) -> np.ndarray:
        """The covariance of the whitened values."""
        centred, scaled, k = self.centred, components / np.sqrt(eigenvalues), len(eigenvalues)

        def of_batch(x: np.ndarray) -> np.ndarray:
            w = centred(x) @ scaled
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        sums = self._summed(of_batch) / self.n
        return sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Minimal residual solutions of one symmetric system a column, all columns in step.

    `product` maps all columns at once; a column whose Krylov space is used up stays as it is."""
    x = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    v_old, v = np.zeros_like(right), right / np.where(live, beta, 1)
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    eta, floor = beta.copy(), EPS * beta
    c_old = c = np.ones_like(beta)
    s_old = s = np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        p = product(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        delta, gamma2, gamma3 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        gamma = np.hypot(delta, beta_new)
        ok = live & (gamma > 0)
        gamma = np.where(ok, gamma, 1)
        c_new, s_new = delta / gamma, beta_new / gamma
        w_new = (v - gamma3 * w_old - gamma2 * w) / gamma
        x = x + np.where(ok, c_new * eta, 0) * w_new
        eta = np.where(ok, -s_new * eta, eta)
        live = ok & (beta_new > 0) & (np.abs(eta) > floor)
        v_old, v = v, np.where(live, p / np.where(beta_new > 0, beta_new, 1), 0)
        w_old, w, c_old, c, s_old, s, beta = w, w_new, c, c_new, s, s_new, beta_new
    return x


def _added(space: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Unit vectors that extend an orthonormal space by the given ones; what lies in it already is left out."""
    new: list[np.ndarray] = []
    for v in vectors.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            for basis in (space, np.array(new).T if new else space[:, :0]):
                v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            new.append(v)
    return np.array(new).T if new else space[:, :0]


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, want: int, tolerance: float = 64 * EPS,
                    space: int = SPACE, inner: int = INNER_STEPS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors): the `want` largest of a symmetric positive matrix of size d, given by its products.

    A pair is locked once its residual is at most `tolerance` times the largest eigenvalue and all larger ones are
    locked. The space is cut back to its best vectors when it holds `space` of them."""
    want = min(want, d)
    block = min(d, want + 2)
    rng = np.random.default_rng(20)
    fresh = _added(np.empty((d, 0)), rng.standard_normal((d, block)))
    basis, image = np.empty((d, 0)), np.empty((d, 0))
    locked, values = np.empty((d, 0)), np.empty(0)
    for _ in range(rounds):
        if fresh.shape[1]:
            basis, image = np.hstack([basis, fresh]), np.hstack([image, product(fresh)])
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn, image @ turn
        scale = max(values[0] if len(values) else theta[0], 0.0)
        off = moved - ritz * theta
        off -= locked @ (locked.T @ off)
        size = np.linalg.norm(off, axis=0)
        # With no direction left outside the space the pairs are exact, whatever rounding leaves of the residuals.
        full = basis.shape[1] + locked.shape[1] >= d
        done = 0
        while done < len(theta) and len(values) + done < want and (full or size[done] <= tolerance * scale):
            done += 1
        locked, values = np.hstack([locked, ritz[:, :done]]), np.concatenate([values, theta[:done]])
        missing = want - len(values)
        if not missing:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        basis, image = ritz[:, done:], moved[:, done:]
        theta, off = theta[done:], off[:, done:]
        if basis.shape[1] + block > space:
            basis, image = basis[:, :2 * block], image[:, :2 * block]
        k = min(missing + 2, len(theta))
        held = np.hstack([locked, basis[:, :k]])

        def outside(v: np.ndarray) -> np.ndarray:
            return v - held @ (held.T @ v)

        shifts = theta[:k]
        corrected = minres(lambda v: outside(product(v) - v * shifts), -outside(off[:, :k]), inner)
        # Both the solutions and the residuals they start from extend the space.
        fresh = _added(np.hstack([locked, basis]), np.hstack([outside(corrected), off[:, :k]]))
        if not fresh.shape[1]:
            fresh = _added(np.hstack([locked, basis]), rng.standard_normal((d, 1)))
    raise RuntimeError(f"{len(values)} of {want} components reached double precision in {rounds} rounds")


def whiten(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(row, n, deviation, whitened, explained, identity_error): one row for each usable row.

    `row` holds the other columns, `whitened` and `explained` an entry for each component."""
    usable = materialize(quantised(rows, vector_col, scale), "whitening_rows")
    sizes = usable.groupBy((F.octet_length("x") / 8).cast("int").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    usable = usable.where(F.octet_length("x") == 8 * d)
    # Repeated vectors meet map-side first, so a vector of a third of all rows is a row a task.
    fit = FitList(materialize(usable.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whitening_distinct"), d)
    values, vectors, trace, error = np.empty(0), np.empty((d, 0)), 0.0, 0.0
    if fit.n > 1:
        trace = fit.trace()
        values, vectors = jacobi_davidson(fit.product, d, components)
        good = values > 1e3 * EPS * trace
        values, vectors = values[good], vectors[:, good]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        if len(values):
            error = float(np.abs(fit.second_moments(vectors, values) - np.eye(len(values))).max())
    n, sums, centred, k = fit.n, fit.sums, fit.centred, len(values)
    explained, scaled = [float(v) / trace for v in values], vectors / np.sqrt(values)
    schema = T.StructType([usable.schema["row"], *T.StructType.fromDDL(
        "n long, deviation long, whitened array<double>, explained array<double>, identity_error double")])

    def deviations(x: np.ndarray) -> list[int | None]:
        most = np.abs(x).max(initial=0) if len(x) else 0
        largest = n * int(most) + max((abs(int(s)) for s in sums), default=0)
        if largest * largest * max(1, d) < 1 << 63:
            return np.square(n * x - np.array([int(s) for s in sums], dtype=np.int64)).sum(axis=1).tolist()
        exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), d)
            size = len(x)
            ends = pa.array(np.arange(size + 1, dtype=np.int32) * k)
            listed = lambda values: pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(size, n)), pa.array(deviations(x), pa.int64()),
                 listed(centred(x) @ scaled), listed(np.tile(explained, (size, 1)).astype(np.float64)),
                 pa.array(np.full(size, error))], names=schema.names)
    return usable.mapInArrow(run, schema)
