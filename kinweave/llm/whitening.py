"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers first, so sums, means and deviations are exact.  The distinct vectors are the fit list;
its centred rows are a matrix A that lies in blocks over the tasks.  A step takes one pass over the blocks:
with the latest right vector v it forms w = Av less what earlier steps give, its products with all left vectors
and A'w.  Left vectors are as long as the fit list, so they are not kept: each is A times a short vector, which
a task multiplies again.  Both sides are orthogonalised against all earlier vectors in each step, and the driver
holds short vectors and the small bidiagonal matrix only, whose singular values and right vectors give the
deviations and components.

A Krylov space never shows the second of two equal singular values.  So unless the steps have used up all dimensions,
what has converged is set aside and the bidiagonalisation starts again beside it, until nothing larger turns up.

Edge cases: a null vector, one with a null, NaN or infinite entry, and an empty one are dropped; so are vectors whose
length is not the commonest (of equally common ones the longest); repeated rows each get their result but count
once in the fit list; with fewer than 16 dimensions or directions that vary there are fewer components, and none at all
where all vectors are equal; an empty table gives no rows; a null id is kept; other columns are ignored, whatever they
are called.  An entry of 2^53 steps or more is an error, and so is a deviation that a 64-bit number can't hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.loop import checkpoint

#: Entries times ``SCALE``, rounded down, plus ``SHIFT``: both fixed values.
SCALE = 64
SHIFT = 1_000_000

#: Scaled entries of this size or more are an error: a double no longer holds all whole numbers.
LARGEST = float(1 << 53)

#: Components that are returned.
COMPONENTS = 16

#: Bytes of vectors in one block, and of the blocks that one task reads.
BLOCK_BYTES = 1 << 20
TASK_BYTES = 64 << 20

#: Against the size of the matrix: what counts as nothing, and when a singular vector has converged.
NOTHING = 1e-11
CONVERGED = 1e-15

#: Residual of a component, against the largest one, above which the result is refused.
RESIDUAL = 1e-9


@dataclass
class Fit:
    """What whitening needs: counts, sums and components, all of them small."""

    n: int
    sums: np.ndarray
    trace: float
    components: np.ndarray
    eigenvalues: np.ndarray
    identity_error: float


def whole_entries(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id_col, x)``: vectors of whole entries, without those that the rules drop."""
    scaled = lambda c: c.cast("double") * SCALE
    beyond = F.raise_error(F.lit("an embedding's entry is too large to be counted in whole steps")).cast("long")
    entry = lambda c: F.when(F.abs(scaled(c)) >= LARGEST, beyond).otherwise(F.floor(scaled(c)).cast("long") + SHIFT)
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    good = df.select(F.col(id_col).alias(id_col), F.col(vector).alias("__v")).where(F.size("__v") > 0).where(F.forall("__v", finite))
    lengths = good.groupBy(F.size("__v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    good = good.where(F.size("__v") == (common.d if common else 0))
    return good.select(id_col, F.transform("__v", entry).alias("x"))


def fit_blocks(rows: DataFrame) -> DataFrame:
    """``(block, d)``: the distinct vectors of ``rows`` (less ``SHIFT``), many in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("x")) - SHIFT
            step = max(1, BLOCK_BYTES // (8 * matrix.shape[1]))
            parts = [matrix[i : i + step].tobytes() for i in range(0, len(matrix), step)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), pa.array([matrix.shape[1]] * len(parts), pa.int32())], ["block", "d"])

    blocks = checkpoint(rows.select("x").distinct().mapInArrow(run, "block binary, d int"))
    held = blocks.agg(F.sum(F.octet_length("block").cast("long"))).first()[0] or 0
    tasks = max(2 * blocks.sparkSession.sparkContext.defaultParallelism, -(-held // TASK_BYTES))
    return checkpoint(blocks.repartition(tasks)) if blocks.rdd.getNumPartitions() > tasks else blocks


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long, as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(blocks: DataFrame, function, kind: str = "double") -> list:
    """The sum over all blocks of the vector that ``function`` makes of each block's matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block, d in zip(batch.column("block").to_pylist(), batch.column("d").to_pylist(), strict=True):
                made = function(np.frombuffer(block, np.int64).reshape(-1, d))
                total = made if total is None else total + made
        if total is not None:
            values = [str(v) for v in total] if kind == "string" else np.asarray(total, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(values)], ["at", "value"])

    parts = blocks.select("block", "d").mapInArrow(run, f"at int, value {kind}")
    value = F.col("value").cast("decimal(38,0)") if kind == "string" else F.col("value")
    found = parts.groupBy("at").agg(F.sum(value).alias("value")).collect()  # a row for each place of the vector
    return [r.value for r in sorted(found, key=lambda r: r["at"])]


def _exact(matrix: np.ndarray) -> np.ndarray:
    """Rows, sums and sums of squares as Python numbers."""
    wide = matrix.astype(object) if np.abs(matrix).max() > 1 << 20 else matrix
    return np.concatenate([[len(matrix)], wide.sum(axis=0), (wide * wide).sum(axis=0)]).astype(object)


def fit(rows: DataFrame, components: int = COMPONENTS, max_steps: int | None = None) -> Fit | None:
    """Components of the distinct vectors of :func:`whole_entries` rows; None if there are no vectors.

    ``max_steps`` bounds the steps of one bidiagonalisation, which otherwise go on until the wanted singular vectors
    have converged or all dimensions are used up; to run into it is an error.
    """
    blocks = fit_blocks(rows)
    added = [int(v) for v in _added(blocks, _exact, "string")]
    if not added:
        return None
    n, d = added[0], (len(added) - 1) // 2
    sums = np.array(added[1 : d + 1], dtype=object)
    trace = sum(Decimal(n * q - s * s) for q, s in zip(added[d + 1 :], sums, strict=True)) / n / n
    size = float(trace * n) ** 0.5
    kept = _Bidiagonal(blocks, n, sums, size, d)
    values, vectors = _largest(kept, components, max_steps or d)
    real = values > 10 * NOTHING * size
    values, vectors = values[real], vectors[:, real]
    eigenvalues = values**2 / n
    identity_error = kept.check(vectors, eigenvalues) if len(values) else 0.0
    return Fit(n, sums + n * SHIFT, float(trace), vectors, eigenvalues, identity_error)


class _Bidiagonal:
    """The centred matrix in blocks, and the short vectors of the bidiagonalisations so far."""

    def __init__(self, blocks: DataFrame, n: int, sums: np.ndarray, size: float, d: int):
        self.blocks, self.n, self.size, self.d = blocks, n, size, d
        self.sums = sums.astype(np.int64) if max(abs(s) for s in sums) < 1 << 62 else sums.astype(np.float64)
        self.draw = np.random.default_rng(0)
        self.v = np.zeros((d, 0))  # right vectors
        self.y = np.zeros((d, 0))  # a left vector is A times one of these
        self.back = np.zeros((d, 0))  # A' times each left vector

    def centred(self):
        n, sums = self.n, self.sums
        return lambda matrix: (n * matrix - sums) / n

    def outside(self, r: np.ndarray) -> np.ndarray:
        """``r`` without its part among the right vectors."""
        for _ in range(2):
            r = r - self.v @ (self.v.T @ r)
        return r

    def fresh(self) -> np.ndarray:
        r = self.outside(self.draw.standard_normal(self.d))
        return r / np.linalg.norm(r)

    def left(self, z: np.ndarray) -> float:
        """Add the left vector that Az gives beside the earlier ones; its length before scaling, 0 if there is nothing."""
        centred, y, k = self.centred(), self.y, self.y.shape[1]

        def products(matrix: np.ndarray) -> np.ndarray:
            rows = centred(matrix)
            w = rows @ z
            earlier = (rows @ y).T @ w if k else np.zeros(0)
            return np.concatenate([rows.T @ w, earlier, [w @ w]])

        got = np.array(_added(self.blocks, products))
        along, inside, square = got[: self.d], got[self.d : -1], got[-1]
        length = max(0.0, square - inside @ inside) ** 0.5
        if length <= NOTHING * self.size:
            return 0.0
        self.y = np.column_stack([self.y, (z - self.y @ inside) / length])
        self.back = np.column_stack([self.back, (along - self.back @ inside) / length])
        return length

    def run(self, wanted: int, floor: float, max_steps: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Singular values and right vectors beside the earlier ones, and whether all dimensions are used up.

        It ends when its ``wanted`` largest have converged: those above ``floor``, and the largest one in any case.
        """
        first, left = self.v.shape[1], self.y.shape[1]
        entries, v, beta, rows = {}, self.fresh(), 0.0, 0
        for step in range(max_steps):
            self.v = np.column_stack([self.v, v])
            # what A v has along the left vector before
            alpha = self.left(v - beta * self.y[:, -1] if beta else v)
            if beta:
                entries[rows - 1, step] = beta
            if alpha:
                entries[rows, step] = alpha
                rows += 1
            done = self.v.shape[1] == self.d
            r = self.outside(self.back[:, -1] - alpha * v) if alpha and not done else np.zeros(self.d)
            beta = float(np.linalg.norm(r))
            beta = beta if beta > NOTHING * self.size else 0.0
            small = np.zeros((max(rows, 1), step + 1))
            for at, value in entries.items():
                small[at] = value
            p, s, q = np.linalg.svd(small, full_matrices=False)
            top = [i for i in range(min(wanted, len(s))) if i == 0 or s[i] > floor]
            settled = len(s) >= wanted or wanted == 1
            if done or (settled and beta and all(beta * abs(p[-1, i]) <= CONVERGED * self.size for i in top)):
                return s[top], self.v[:, first:] @ q[top].T, done
            v = r / beta if beta else self.fresh()
        raise RuntimeError(f"no convergence in {max_steps} steps")

    def lock(self, values: np.ndarray, vectors: np.ndarray) -> None:
        """Keep only these right vectors and their left ones."""
        real = values > NOTHING * self.size
        self.v = vectors
        self.y = vectors[:, real] / values[real]
        self.back = vectors[:, real] * values[real]

    def check(self, vectors: np.ndarray, eigenvalues: np.ndarray) -> float:
        """The largest entry of the whitened fit list's covariance less the identity; refuses components that are none."""
        centred, c = self.centred(), len(eigenvalues)

        def products(matrix: np.ndarray) -> np.ndarray:
            rows = centred(matrix)
            w = rows @ (vectors / np.sqrt(eigenvalues))
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel(), (rows.T @ w).ravel()])

        got = np.array(_added(self.blocks, products)) / self.n
        mean, square, along = got[:c], got[c : c + c * c].reshape(c, c), got[c + c * c :].reshape(-1, c)
        if (off := np.abs(along - vectors * np.sqrt(eigenvalues)).max()) > RESIDUAL * float(eigenvalues[0]) ** 0.5:
            raise RuntimeError(f"a component is off by {off}")
        return float(np.abs(square - np.outer(mean, mean) - np.eye(c)).max())


def _largest(kept: _Bidiagonal, wanted: int, max_steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values and their right vectors."""
    values, vectors, done = kept.run(min(wanted, kept.d), 0.0, max_steps)
    while not done and kept.d > len(values):
        kept.lock(values, vectors)
        floor = values[min(wanted, len(values)) - 1] * (1 + 1e-12)
        more, beside, done = kept.run(1, floor, max_steps)
        if len(values) >= wanted and more[0] <= floor:
            break
        order = np.argsort(-np.concatenate([values, more]), kind="stable")
        values, vectors = np.concatenate([values, more])[order], np.column_stack([vectors, beside])[:, order]
    return values[:wanted], vectors[:, :wanted]


def whiten(rows: DataFrame, model: Fit | None, id_col: str = "vec_id") -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)`` for :func:`whole_entries` rows."""
    more = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = StructType(rows.select(id_col).schema.fields + StructType.fromDDL(more).fields)
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, c = model.n, model.sums - model.n * SHIFT, len(model.eigenvalues)
    directions = model.components / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace
    error = model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                matrix = _matrix(part.column("x")) - SHIFT
                m, d = matrix.shape
                reach = int(np.abs(matrix).max()) * n + int(max(abs(s) for s in sums))
                wide = matrix.astype(object) if d * reach * reach >= 1 << 63 else matrix
                off = n * wide - (sums if wide.dtype == object else sums.astype(np.int64))
                deviation = (off * off).sum(axis=1)
                white = (off.astype(np.float64) / n) @ directions
                numbers = pa.array(np.repeat(np.arange(m), c))
                columns = [
                    part.column(id_col).take(numbers),
                    pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * c, n, np.int64)),
                    pa.array([int(v) for v in deviation], pa.int64()).take(numbers),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * c, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select(id_col, "x").mapInArrow(run, schema)
