"""Embedding whitening by block Jacobi-Davidson (operator 11).

Vectors become whole numbers (floor(64 c)), packed once into blocks of rows in the shared folder. The
covariance is never formed: a product of it with a few vectors is one pass over the blocks, each task
multiplying its centred rows, ``X'(X q) / n``; partial products are summed in a tree, in the order of
the partitions, so a repeated pass gives the same numbers.

Jacobi-Davidson on the driver holds a basis of at most ``wanted + 5 BLOCK`` vectors. A round takes the
Ritz pairs of the basis, locks those whose residual is at rounding level, and for the ``BLOCK`` leading
ones that are not solves the projected correction equations (I-QQ')(V-eI)(I-QQ') t = -r, Q the locked
and the current Ritz vectors, by ``INNER`` steps of MINRES (the least residual over a Lanczos basis);
one pass serves the whole block. Locked pairs stay in the basis but get no corrections. It ends when
all wanted residuals are below 8 d eps e_1 and the next Ritz value, with its residual, is below them.

The dimension d is taken to fit the driver (d x 72 numbers); rows are not.

Rows: vectors that are null or empty or hold null or non-finite entries are dropped; vectors of
different lengths, or whose entries or exact sums leave 64 bits, are refused; repeated rows and ids
count and return one by one, null ids too; equal eigenvalues have any orthonormal vectors; components
without variance (rank below ``wanted``, all vectors equal, one vector) are left out; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
BLOCK = 8  # corrections in one pass
INNER = 4  # MINRES steps a correction
ROUNDS = 500
ROWS = 4096  # rows of a block
#: Partial sums that the driver gathers; more partitions are first summed by so many.
FAN = 256
EPS = np.finfo(float).eps


def matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors of a list column, and floor(64 c) of their entries, one row each."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries come as NaN
    first = np.cumsum(sizes) - sizes
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = np.flatnonzero((sizes > 0) & (bad[first + sizes] == bad[first]))
    if not len(good):
        return good, np.zeros((0, 0), dtype=np.int64)
    lengths = np.unique(sizes[good])
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths[:5].tolist()}")
    y = np.floor(SCALE * values[first[good][:, None] + np.arange(lengths[0])])
    if np.abs(y).max() >= 2.0**62:
        raise ValueError("an entry leaves the range of 64-bit numbers")
    return good, y.astype(np.int64)


def blocks_of(vectors: DataFrame, column: str) -> DataFrame:
    """dim, kind, body: the usable vectors as blocks of rows, in the smallest signed type."""

    def run(batches):
        for batch in batches:
            _, y = matrix(batch.column(0))
            for a in range(0, len(y), ROWS):
                part = y[a : a + ROWS]
                kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max)
                yield pa.RecordBatch.from_arrays([pa.array([y.shape[1]], pa.int32()), pa.array([kind]), pa.array([part.astype(f"<{kind}").tobytes()], pa.binary())], names=["dim", "kind", "body"])

    return written(vectors.select(column).mapInArrow(run, "dim int, kind string, body binary"))


class Blocks:
    """Sums over the packed rows, one Spark job each."""

    def __init__(self, table: DataFrame):
        self.table, self.parts = table, table.rdd.getNumPartitions()

    def total(self, kernel, dtype="f8") -> list[np.ndarray]:
        """Sum over all blocks of the arrays that ``kernel(rows as int64)`` returns."""

        def added(rows):
            out = None
            for body in rows:
                out = body if out is None else [a + b for a, b in zip(out, body)]
            return out

        def run(batches):
            part = added(kernel(np.frombuffer(body, f"<{kind}").reshape(-1, dim).astype(np.int64)) for batch in batches for dim, kind, body in zip(*[c.to_pylist() for c in batch.columns]))
            if part is not None:
                yield row(TaskContext.get().partitionId(), part)

        def row(part, arrays):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([[np.ascontiguousarray(a, dtype=f"<{dtype}").tobytes() for a in arrays]], pa.list_(pa.binary()))], names=["part", "sums"])

        def joined(table):
            rows = sorted(zip(table.column("part").to_pylist(), table.column("sums").to_pylist()))
            part = added([np.frombuffer(b, f"<{dtype}") for b in sums] for _, sums in rows)
            return pa.Table.from_batches([row(rows[0][0], part)])

        sums = self.table.mapInArrow(run, "part long, sums array<binary>")
        if self.parts > FAN:
            sums = sums.groupBy((F.col("part") / FAN).cast("long").alias("group")).applyInArrow(joined, "part long, sums array<binary>")
        rows = sorted((r["part"], r["sums"]) for r in sums.collect())  # at most FAN, or partitions / FAN, rows of d x BLOCK numbers
        return added([np.frombuffer(b, f"<{dtype}") for b in sums] for _, sums in rows)


class Fit:
    """n, whole-number sums and eigenpairs of the covariance; enough to whiten any row."""

    def __init__(self, n: int, sums: np.ndarray, values=None, axes=None):
        self.n, self.sums, self.values, self.axes = n, sums, values, axes

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (self.n * y - self.sums) / self.n

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y) @ (self.axes / np.sqrt(self.values))

    def deviations(self, y: np.ndarray) -> list[int] | np.ndarray:
        """Sum over dimensions of (n x - S)^2, exact; refused beyond 64 bits."""
        d = self.n * y - self.sums
        if not d.size or y.shape[1] * float(np.abs(d).max()) ** 2 < 2.0**62:
            return (d * d).sum(axis=1)
        exact = [sum(int(v) ** 2 for v in r) for r in d]
        if max(exact) >= 2**63:
            raise ValueError("a deviation leaves the range of 64-bit numbers")
        return exact


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns of ``new`` outside ``basis``; columns that bring nothing new are left out."""
    out = np.zeros((len(new), 0))
    for col in new.T:
        length = np.linalg.norm(col)
        for _ in range(3):
            col = col - basis @ (basis.T @ col)
            col = col - out @ (out.T @ col)
        left = np.linalg.norm(col)
        if left > 1e-10 * max(length, 1e-300):
            out = np.column_stack([out, col / left])
    return out


def minres(product, fixed: np.ndarray, shift: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Columns t orthogonal to ``fixed`` with least |P(V - shift)P t - right| over Krylov spaces of ``steps`` products."""

    def outside(x):
        x = x - fixed @ (fixed.T @ x)
        return x - fixed @ (fixed.T @ x)

    right = outside(right)
    start = np.linalg.norm(right, axis=0)
    live = start > 0
    vectors = [np.where(live, right / np.where(live, start, 1), 0.0)]
    b = right.shape[1]
    tri = np.zeros((b, steps + 1, steps))  # the Lanczos matrix of each column
    for s in range(steps):
        x = outside(product(vectors[s]) - vectors[s] * shift)
        for _ in range(2):
            for t, v in enumerate(vectors):  # full orthogonalisation; only the three diagonals are not rounding
                h = (v * x).sum(axis=0)
                tri[:, t, s] += h
                x = x - v * h
        length = np.linalg.norm(x, axis=0)
        tri[:, s + 1, s] = length
        more = length > 1e-12 * np.abs(tri[:, : s + 1, s]).max(axis=1)
        vectors.append(np.where(more, x / np.where(more, length, 1), 0.0))
    out = np.zeros_like(right)
    for j in np.flatnonzero(live):
        y = np.linalg.lstsq(tri[j], np.append(start[j], np.zeros(steps)), rcond=1e-12)[0]
        out[:, j] = sum(v[:, j] * c for v, c in zip(vectors, y))
    return out


def jacobi_davidson(product, d: int, wanted: int, block: int = BLOCK, inner: int = INNER, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit vectors of the symmetric operator ``product``."""
    wanted = min(wanted, d)
    room = min(d, wanted + 5 * block)
    rng = np.random.default_rng(11)
    basis = orthonormal(rng.standard_normal((d, min(d, wanted))), np.zeros((d, 0)))
    image = product(basis)
    best, idle = np.inf, 0
    for _ in range(rounds):
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, images = basis @ turn, image @ turn
        rest = images - ritz * values
        size = np.linalg.norm(rest, axis=0)
        tol = 8 * d * EPS * max(abs(values[0]), np.finfo(float).tiny)
        locked = size <= tol
        open_ = np.flatnonzero(~locked[:wanted])
        if not len(open_):
            if len(values) == d:
                break
            if len(values) > wanted and values[wanted] + size[wanted] <= values[wanted - 1] + tol:
                break
            open_ = np.arange(wanted, len(values))
        worst = size[open_].max(initial=0)
        best, idle = (worst, 0) if worst < 0.9 * best else (best, idle + 1)
        if len(values) == d:
            # the whole space: what is left is rounding, so take fresh images of the Ritz vectors
            if idle > 3:
                raise ArithmeticError(f"residuals stay at {worst:.3g}, above {tol:.3g}")
            basis = orthonormal(ritz, np.zeros((d, 0)))
            image = product(basis)
            continue
        if len(values) + block > room and len(values) > wanted + block:
            ritz, images = ritz[:, : wanted + block], images[:, : wanted + block]
            values, locked = values[: wanted + block], locked[: wanted + block]
            open_ = open_[open_ < len(values)]
        use = open_[:block]
        fixed = np.column_stack([ritz[:, np.flatnonzero(locked)], ritz[:, use]]) if len(use) else ritz[:, locked]
        new = minres(product, fixed, values[use], -rest[:, use], inner) if len(use) else np.zeros((d, 0))
        basis = ritz
        new = orthonormal(np.column_stack([new, rng.standard_normal((d, block))]), basis)[:, : min(block, d - basis.shape[1])]
        basis = np.column_stack([basis, new])
        image = np.column_stack([images, product(new)])
    else:
        raise ArithmeticError(f"{rounds} rounds, residuals above {tol:.3g}")
    return values[:wanted], ritz[:, :wanted]


def fitted(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> tuple[Fit | None, float, float]:
    """The fit over all usable vectors, the trace of the covariance and the identity error."""
    blocks = Blocks(blocks_of(vectors, column))
    shape = blocks.table.agg(F.min("dim"), F.max("dim")).collect()[0]
    if shape[0] is None:
        return None, 0.0, 0.0
    if shape[0] != shape[1]:
        raise ValueError(f"vectors of different lengths: {shape[0]} and {shape[1]}")
    d = shape[0]
    # sums in doubles show first that those in 64 bits can't overflow
    size, rough = blocks.total(lambda y: [np.array([len(y)], float), np.abs(y.astype(float)).sum(axis=0)])
    top = max(float(rough.max()), 1.0)
    if top * size[0] >= 2.0**62:
        raise ValueError("sums leave the range of 64-bit numbers")
    n, sums = blocks.total(lambda y: [np.array([len(y)]), y.sum(axis=0)], "i8")
    fit = Fit(int(n[0]), sums)

    def product(q):
        if not q.shape[1]:
            return q
        flat = blocks.total(lambda y: [(lambda c: c.T @ (c @ q))(fit.centred(y)).ravel()])[0]
        return flat.reshape(q.shape) / fit.n

    values, axes = jacobi_davidson(product, d, components)
    # a last Rayleigh-Ritz step on fresh images, and the residuals of what it gives
    image = product(axes)
    own, turn = np.linalg.eigh((axes.T @ image + image.T @ axes) / 2)
    values, axes, image = own[::-1], axes @ turn[:, ::-1], image @ turn[:, ::-1]
    left = np.linalg.norm(image - axes * values, axis=0).max(initial=0)
    if left > 32 * d * EPS * max(values[0], 0):
        raise ArithmeticError(f"residuals of {left:.3g} at a largest eigenvalue of {values[0]:.3g}")
    some = values > 8 * d * EPS * max(values[0], 0)
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    fit = Fit(fit.n, fit.sums, values[some], (axes * signs)[:, some])
    if not some.any():
        return fit, 0.0, 0.0

    def spread(y):
        w, c = fit.whitened(y), fit.centred(y)
        return [np.array([(c * c).sum()]), w.sum(axis=0), (w.T @ w).ravel()]

    square, mean, gram = blocks.total(spread)
    mean = mean / fit.n
    k = len(mean)
    error = float(np.abs(gram.reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max())
    return fit, float(square[0]) / fit.n, error


def whiten(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row a usable vector and component."""
    fit, trace, error = fitted(vectors, column, components)
    rows = vectors.select(F.col(ident).alias("vec_id"), F.col(column).alias("v"))
    schema = rows.select("vec_id").schema.add("component", "integer").add("deviation", "long").add("whitened", "double")
    if fit is None or not len(fit.values):
        empty = vectors.sparkSession.createDataFrame([], schema)
        return empty.select("vec_id", "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))

    def run(batches):
        k = len(fit.values)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                good, y = matrix(part.column(1))
                if not len(good):
                    continue
                ids = part.column(0).take(pa.array(np.repeat(good, k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(good))), pa.array(np.repeat(np.array(fit.deviations(y), dtype=np.int64), k)), pa.array(fit.whitened(y).ravel())], names=schema.names)

    share = F.array(*[F.lit(float(v / trace)) for v in fit.values])
    out = rows.mapInArrow(run, schema)
    return out.select("vec_id", "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))
