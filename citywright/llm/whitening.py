"""Whitening of embeddings on their leading principal components, found by Jacobi-Davidson with distributed centred products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Entries become floor(SCALE * c) + SHIFT; entries too large for that saturate at 2^62.
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 62
COMPONENTS = 8
#: Vectors are kept in blocks of about this many bytes.
BLOCK_BYTES = 4 << 20
#: Partial products of all tasks go to the driver up to this many bytes; more are summed in tasks first.
MOST_BYTES = 64 << 20
#: Residual of a component that counts as exact, in units of the last place of the largest eigenvalue.
EXACT = 32
#: Inner steps, the drop of the inner residual that ends them, outer steps, and the widest subspace before a restart.
INNER, INNER_DROP, OUTER, WIDEST = 8, 0.05, 300, 96

Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The columns of ``new`` made orthonormal to those of ``against`` and to each other; columns that hold nothing new go."""
    kept = np.zeros((len(new), 0))
    for v in new.T:
        v = v / (np.linalg.norm(v) or 1.0)
        # twice is enough: what the first pass leaves by rounding, the second takes
        for _ in range(2):
            for basis in (*against, kept):
                v = v - basis @ (basis.T @ v)
            norm = np.linalg.norm(v)
            if norm < 1e-10:
                break
            v = v / norm
        else:
            kept = np.column_stack((kept, v))
    return kept


def corrections(product: Product, ritz: np.ndarray, theta: np.ndarray, residual: np.ndarray, locked: np.ndarray) -> np.ndarray:
    """An approximate solution t of (I - PP')(V - theta)(I - PP') t = -residual for each Ritz pair, P being the locked vectors and its own.

    MINRES for all pairs side by side, so a step costs one product with a block: Lanczos vectors are kept, and t is the combination of
    them with the least residual.
    """

    def projected(w: np.ndarray) -> np.ndarray:
        w = w - locked @ (locked.T @ w)
        return w - ritz * (ritz * w).sum(axis=0)

    size, many = ritz.shape
    start = projected(-residual)
    norm = np.linalg.norm(start, axis=0)
    chain = [start / np.where(norm > 0, norm, 1.0)]
    alpha, beta = np.zeros((INNER, many)), np.zeros((INNER, many))
    weights = [np.zeros(0)] * many
    for step in range(min(INNER, size)):
        image = projected(product(chain[step]) - chain[step] * theta)
        alpha[step] = (chain[step] * image).sum(axis=0)
        for _ in range(2):
            for v in chain:
                image = image - v * (v * image).sum(axis=0)
        beta[step] = np.linalg.norm(image, axis=0)
        left = np.zeros(many)
        for k in range(many):
            rows = np.zeros((step + 2, step + 1))
            for j in range(step + 1):
                rows[j, j], rows[j + 1, j] = alpha[j, k], beta[j, k]
                if j:
                    rows[j - 1, j] = beta[j - 1, k]
            goal = np.zeros(step + 2)
            goal[0] = norm[k]
            weights[k] = np.linalg.lstsq(rows, goal, rcond=None)[0]
            left[k] = np.linalg.norm(goal - rows @ weights[k])
        live = beta[step] > 1e-13 * np.abs(theta).max()
        if (left <= INNER_DROP * norm).all() or not live.any():
            break
        chain.append(np.where(live, image / np.where(live, beta[step], 1.0), 0.0))
    return np.stack([np.stack([v[:, k] for v in chain[: len(weights[k])]], axis=1) @ weights[k] for k in range(many)], axis=1)


def jacobi_davidson(product: Product, size: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns, residuals) of the ``wanted`` greatest eigenpairs of a symmetric operator.

    ``product`` gives its product with a block of columns; the operator itself is never formed. Ritz pairs are taken from a subspace
    that grows by corrections; the greatest are locked, in order, once their residual is within ``EXACT`` units of the last place.
    """
    wanted = min(wanted, size)
    rng = np.random.default_rng(seed)
    locked, values, norms_of = np.zeros((size, 0)), np.zeros(0), np.zeros(0)
    basis = _orthonormal(rng.normal(size=(size, min(size, 2 * wanted))))
    image = product(basis)
    for _ in range(OUTER):
        theta, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        residual = image - basis * theta
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        # in the whole space there is nothing left to add: what remains is the rounding of the products
        whole = basis.shape[1] + locked.shape[1] >= size
        exact = norms <= EXACT * np.finfo(float).eps * np.abs(np.append(values, theta)).max()
        done = min(wanted - len(values), len(theta) if whole else int(np.argmin(np.append(exact, False))))
        locked, values, norms_of = np.hstack((locked, basis[:, :done])), np.append(values, theta[:done]), np.append(norms_of, norms[:done])
        if len(values) == wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order], norms_of[order]
        basis, image, theta, residual, exact = basis[:, done:], image[:, done:], theta[done:], residual[:, done:], exact[done:]
        open_ = np.flatnonzero(~exact)[: wanted - len(values)]
        new = corrections(product, basis[:, open_], theta[open_], residual[:, open_], locked)
        if basis.shape[1] + len(open_) > WIDEST:
            basis, image = basis[:, : 3 * wanted], image[:, : 3 * wanted]
        new = _orthonormal(new, locked, basis)
        if not new.shape[1]:
            new = _orthonormal(rng.normal(size=(size, wanted)), locked, basis)
        basis, image = np.hstack((basis, new)), np.hstack((image, product(new)))
    raise ArithmeticError(f"{len(values)} of {wanted} components reached double precision in {OUTER} steps")


def integer_blocks(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Usable vectors as integers, in stored blocks: (size, n, sums, ids, width, x); ``x`` holds n * size integers of ``width`` bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            edges = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.slice(edges[0], edges[-1] - edges[0])
            entries = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            edges = edges - edges[0]
            broken = np.concatenate(([0], np.cumsum(~np.isfinite(entries) | (np.asarray(values.is_null())))))
            lengths = np.diff(edges)
            usable = np.asarray(lists.is_valid()) & (broken[edges[1:]] == broken[edges[:-1]]) & (lengths > 0)
            for size in np.unique(lengths[usable]):
                rows = np.flatnonzero(usable & (lengths == size))
                step = max(1, BLOCK_BYTES // (8 * int(size)))
                for a in range(0, len(rows), step):
                    some = rows[a : a + step]
                    with np.errstate(over="ignore"):
                        scaled = np.floor(SCALE * entries[edges[some][:, None] + np.arange(size)])
                    x = np.clip(scaled, -float(LARGEST), float(LARGEST)).astype(np.int64) + SHIFT
                    narrow = bool((np.abs(x) < 1 << 31).all())
                    sums = x.sum(axis=0) if narrow else x.astype(object).sum(axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([size], pa.int32()),
                            pa.array([len(some)], pa.int64()),
                            pa.array([[int(s) for s in sums]], pa.list_(pa.decimal128(38, 0))),
                            pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids.take(pa.array(some))),
                            pa.array([4 if narrow else 8], pa.int32()),
                            pa.array([x.astype(np.int32 if narrow else np.int64).tobytes()], pa.binary()),
                        ],
                        names=["size", "n", "sums", "ids", "width", "x"],
                    )

    vectors = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    return stored(vectors.mapInArrow(run, f"size int, n long, sums array<decimal(38,0)>, ids array<{kind}>, width int, x binary"), "vectors")


@dataclass
class Whitening:
    """Counts, exact sums, and the components of the centred vectors; ``vectors`` has a component in each column."""

    size: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers less their mean, in doubles: the whole part of the mean goes first, so little is rounded."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - np.array(whole, dtype=np.int64)).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None] | np.ndarray:
        """Sum over dimensions of (n x - S)^2, exact; None where a long cannot hold it."""
        low, high = ([int(v) for v in side] for side in (x.min(axis=0), x.max(axis=0)))
        reach = max(abs(self.n * v - s) for side in (low, high) for v, s in zip(side, self.sums, strict=True))
        if reach * reach * self.size < 1 << 63 and max(map(abs, (*low, *high))) * self.n < 1 << 63 > max(map(abs, self.sums)):
            d = self.n * x - np.array(self.sums, dtype=np.int64)
            return (d * d).sum(axis=1)
        out = []
        for row in x.tolist():
            total = sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True))
            out.append(total if total < 1 << 63 else None)
        return out


def _integers(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for k in range(batch.num_rows):
        width = batch.column("width")[k].as_py()
        raw = batch.column("x").slice(k, 1)[0].as_buffer()
        yield k, np.frombuffer(raw, dtype=np.int32 if width == 4 else np.int64).reshape(-1, size).astype(np.int64)


def _summed(blocks: DataFrame, size: int, shape: tuple[int, int], add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``add`` of every block, summed in each task and then, in the order of tasks, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for _, x in _integers(batch, size):
                total += add(x)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()])], names=["task", "total"])

    partial = blocks.select("width", "x").mapInArrow(run, "task int, total binary")
    tasks, each = blocks.rdd.getNumPartitions(), 8 * shape[0] * shape[1]
    if tasks * each > MOST_BYTES:
        lots = max(1, MOST_BYTES // each)

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, task = np.zeros(shape), 0
            for batch in batches:
                for k in range(batch.num_rows):
                    total, task = total + np.frombuffer(batch.column("total")[k].as_buffer()).reshape(shape), batch.column("task")[k].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total.tobytes()])], names=["task", "total"])

        partial = partial.repartition(lots, "task").mapInArrow(fold, "task int, total binary")
    rows = sorted(partial.collect(), key=lambda r: (r["task"], bytes(r["total"])))
    return np.sum([np.frombuffer(bytes(r["total"])).reshape(shape) for r in rows], axis=0) if rows else np.zeros(shape)


def fit(blocks: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of the covariance (divisor n) of all vectors of the commonest length; None without vectors.

    Of lengths that are equally common the greater one counts. Components without variance are left out, so equal vectors have none.
    """
    lengths = blocks.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if lengths is None:
        return None
    size, n = lengths["size"], lengths["n"]
    blocks = blocks.where(F.col("size") == size)
    by_place = blocks.select(F.posexplode("sums").alias("place", "s")).groupBy("place").agg(F.sum("s").alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(by_place, key=lambda r: r["place"])]
    found = Whitening(size, n, sums, np.zeros(0), np.zeros((size, 0)), np.zeros(0), 0.0, 0.0)

    def product(w: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            y = found.centred(x)
            return y.T @ (y @ w)

        return _summed(blocks, size, w.shape, add) / n

    found.trace = float(_summed(blocks, size, (1, 1), lambda x: np.square(found.centred(x)).sum().reshape(1, 1))[0, 0]) / n
    if found.trace == 0:
        return found
    values, vectors, residuals = jacobi_davidson(product, size, components)
    kept = values > size * np.finfo(float).eps * values[0]
    found.values, found.vectors, found.residuals = values[kept], vectors[:, kept], residuals[kept]
    scaled, many = found.vectors / np.sqrt(found.values), int(kept.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        z = found.centred(x) @ scaled
        return np.vstack((z.T @ z, z.sum(axis=0)))

    total = _summed(blocks, size, (many + 1, many), moments) / n
    found.identity_error = float(np.abs(total[:many] - np.outer(total[many], total[many]) - np.eye(many)).max())
    return found


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Rows whose vector is null, empty, or holds a null or non-finite entry go, and so do those of another length than the commonest.
    Components are numbered from 1 by falling eigenvalue; there are as many as ``components``, as dimensions, or as directions
    with variance, whichever are fewest, so a single row or equal rows give no rows. ``deviation`` is null where a long cannot hold it.
    Repeated rows and null ids are rows like others; other columns are ignored, and an empty table gives an empty one.
    """
    kind = df.schema[id_col].dataType.simpleString()
    blocks = integer_blocks(df, id_col, vector_col)
    model = fit(blocks, components)
    columns = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], columns)
    scaled, share, many = model.vectors / np.sqrt(model.values), model.values / model.trace, len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in _integers(batch, model.size):
                rows = len(x)
                place = pa.array(np.repeat(np.arange(rows), many))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids").slice(k, 1).flatten().take(place),
                        pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * many, model.n)),
                        pa.array(model.deviations(x), pa.int64()).take(place),
                        pa.array((model.centred(x) @ scaled).ravel()),
                        pa.array(np.tile(share, rows)),
                        pa.array(np.full(rows * many, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.where(F.col("size") == model.size).select("ids", "width", "x").mapInArrow(run, columns)
