"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

Each entry c becomes the integer x = floor(1024 * c) + 100000. The covariance V of the x-vectors is never formed: all that
is asked of the data is V times a few directions, a pass in which every task multiplies its own centred rows and
the sums of the tasks are added by a shuffle on the entry's number. The driver holds the search space alone, whose
size is the vectors' width times BASIS. Outer steps take Ritz pairs of that space (Rayleigh-Ritz), lock those
whose residual is down to rounding, and extend it by projected correction equations, which a few steps of MINRES solve
for all wanted pairs in lockstep: a pass serves a step of all of them. The loop ends when every wanted pair is locked
and no Ritz value that is left lies above them.

Rows are centred before they are multiplied: the whole part of the mean is subtracted in integers, the rest in doubles.

Defined cases: rows with a null vector, or null or non-finite entries in it, are dropped; a shorter vector counts as
ending in zeros (c = 0); an empty table, or one of empty vectors, gives no rows; a null or repeated vec_id is a row like
others; of V's eigenvalues that are zero to rounding the components are given with ``whitened`` null and ``explained`` 0,
as dividing by them has no meaning, and they don't count in ``identity_error``; ``deviation`` is null where it
doesn't fit a long; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedscope.llm.common import materialise, slices
from feedscope.llm.vectors import floored, widened

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Spare directions of the first search space, its most columns, steps of the inner solver, and outer steps at most.
SPARE, BASIS, INNER, ROUNDS = 4, 48, 6, 300
#: Vectors of a packed row.
PACK = 2048


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, PACK):
        fine, x = floored(b.column("embedding"), SCALE)
        if len(x):
            ids = b.column("vec_id").filter(pa.array(fine))
            yield pa.record_batch([pa.array([len(x)], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["n", "width", "ids", "x"])


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list | None, np.ndarray]]:
    """(ids, x - OFFSET) of each packed row."""
    for b in batches:
        for k in range(b.num_rows):
            x = np.frombuffer(b.column("x")[k].as_py(), np.int64).reshape(b.column("n")[k].as_py(), -1)
            yield b.column("ids")[k].as_py() if "ids" in b.schema.names else None, widened(x, width)


def _summed(packed: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over packed rows of ``of(x - OFFSET)``, entry by entry; what reaches the driver has the size of one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, width):
            part = of(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(np.asarray(total).ravel())], names=["at", "v"])

    parts = packed.select("n", "width", "x").mapInArrow(work, f"at int, v {kind}")
    got = parts.groupBy("at").agg(F.sum("v").alias("v")).toArrow().sort_by("at")
    return got["v"].to_numpy()


def _orthogonal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The columns made orthonormal to each other and to the columns of ``against``; those that vanish are left out."""
    out: list[np.ndarray] = []
    for v in t.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            for a in (*against, np.array(out).T if out else None):
                if a is not None and a.shape[1]:
                    v = v - a @ (a.T @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        else:
            out.append(v)
    return np.array(out).T if out else np.empty((len(t), 0))


def _corrections(times: Callable, fixed: np.ndarray, values: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """Approximate solutions t of P (V - value I) P t = -residual by MINRES, all columns in lockstep; P leaves out ``fixed``."""

    def project(v: np.ndarray) -> np.ndarray:
        return v - fixed @ (fixed.T @ v)

    def safe(v: np.ndarray) -> np.ndarray:
        return np.where(v > 0, v, 1.0)

    b = project(-residuals)
    beta = np.linalg.norm(b, axis=0)
    v_old, v = np.zeros_like(b), b / safe(beta)
    d_old, d, t = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    c_old = c = np.ones_like(beta)
    s_old = s = np.zeros_like(beta)
    eta, between, alive = beta.copy(), np.zeros_like(beta), beta > 0
    for _ in range(INNER):
        if not alive.any():
            break
        w = project(times(v) - values * v)
        alpha = (v * w).sum(axis=0)
        w = project(w - alpha * v - between * v_old)
        after = np.linalg.norm(w, axis=0)
        # the new column of the tridiagonal matrix under the two rotations before it, then its own rotation
        r3, r2, r1 = s_old * between, c * c_old * between + s * alpha, c * alpha - s * c_old * between
        size = np.hypot(r1, after)
        c_old, s_old, c, s = c, s, r1 / safe(size), after / safe(size)
        step = (v - r3 * d_old - r2 * d) / safe(size)
        use = alive & (size > 0)
        d_old, d = d, step
        t = t + np.where(use, c * eta, 0.0) * step
        eta = -s * eta
        v_old, v, between = v, w / safe(after), after
        alive = use & (after > 1e-12 * np.abs(values))
    return project(t)


def leading(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as columns) of the ``wanted`` largest eigenpairs of the symmetric V behind ``times``."""
    wanted = min(wanted, width)
    locked, values = np.empty((width, 0)), np.empty(0)
    w = _orthogonal(np.random.default_rng(12).standard_normal((width, min(width, wanted + SPARE))))
    vw = times(w)
    best, idle = np.inf, 0
    for _ in range(ROUNDS):
        small = w.T @ vw
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, vu = w @ y, vw @ y
        r = vu - u * theta
        r = r - locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        top = max([*values, theta[0]]) if len(theta) else 0.0
        limit = 8 * np.sqrt(width) * np.finfo(float).eps * top
        # no progress in several rounds, and residuals near rounding: what is left is the rounding of the sums
        best, idle = (size[0], 0) if size[0] < best else (best, idle + 1)
        done = 0
        while done < len(theta) and (size[done] <= limit or idle > 4 and size[done] <= 1e3 * limit):
            done += 1
        full = len(values) + len(theta) == width  # the space is all there is: its Ritz pairs are exact to rounding
        done = len(theta) if full and size.max(initial=0.0) <= 1e3 * limit else done
        if done:
            locked, values = np.hstack([locked, u[:, :done]]), np.append(values, theta[:done])
            u, vu, theta, r, size, best, idle = u[:, done:], vu[:, done:], theta[done:], r[:, done:], size[done:], np.inf, 0
        if len(values) >= wanted and not (len(theta) and theta[0] > np.sort(values)[-wanted]):
            break
        goals = min(len(theta), max(1, wanted - len(values)))
        if w.shape[1] > BASIS - goals:  # begin again with the best of the space
            u, vu = u[:, : wanted + SPARE], vu[:, : wanted + SPARE]
        more = _corrections(times, np.hstack([locked, u[:, :goals]]), theta[:goals], r[:, :goals]) if goals else np.empty((width, 0))
        new = _orthogonal(more, locked, u)
        if not new.shape[1]:
            new = _orthogonal(np.random.default_rng(len(values) + w.shape[1]).standard_normal((width, 2)), locked, u)
        if not new.shape[1]:  # nothing is left to add: the products are taken afresh
            w = _orthogonal(u, locked)
            vw = times(w)
            continue
        w, vw = np.hstack([u, new]), np.hstack([vu, times(new)])
    else:
        raise RuntimeError("the eigenvectors didn't converge")
    order = np.argsort(-values, kind="stable")[:wanted]
    q = _orthogonal(locked[:, order])
    small = q.T @ times(q)  # a last Rayleigh-Ritz step over what was locked at different times
    theta, y = np.linalg.eigh((small + small.T) / 2)
    return theta[::-1], (q @ y)[:, ::-1]


@dataclass(frozen=True)
class Whitener:
    """Integer sums and count of the fit list, its leading eigenpairs and the trace of its covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def positive(self) -> np.ndarray:
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values[0], 0.0) if len(self.values) else self.values > 0

    @property
    def gain(self) -> np.ndarray:
        """A centred row times this is whitened; columns of zeros where the eigenvalue is none."""
        return np.where(self.positive, self.components / np.sqrt(np.where(self.positive, self.values, 1.0)), 0.0)


def _centre(n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """x - S / n of integer rows: the whole part in integers, then the rest."""
    whole = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([(int(s) - n * int(w)) / n for s, w in zip(sums, whole, strict=True)])
    return lambda x: (x - whole).astype(np.float64) - rest


def pack(embeddings: DataFrame) -> DataFrame:
    """The rows that take part, in rows of PACK vectors, written once: every pass of the solver reads them."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return materialise(rows.mapInArrow(_packed, "n int, width int, ids array<long>, x binary"), "vectors")


def fit(packed: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of the packed rows, None if there are none."""
    n, width = packed.agg(F.sum("n"), F.max("width")).first()
    if not n or not width:
        return None
    sums = _summed(packed, width, lambda x: x.sum(axis=0), "long")
    centre = _centre(n, sums)
    trace = float(_summed(packed, width, lambda x: np.array([(centre(x) ** 2).sum()]))[0]) / n

    def times(w: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ w)

        return _summed(packed, width, part).reshape(w.shape) / n

    values, vectors = leading(times, width, components)
    found = Whitener(n, sums, values, vectors, trace, 0.0)
    gain, k = found.gain, len(values)
    mean = _summed(packed, width, lambda x: (centre(x) @ gain).sum(axis=0)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        z = centre(x) @ gain - mean
        return z.T @ z

    cov = _summed(packed, width, spread).reshape(k, k) / n
    good = found.positive
    error = np.abs(cov - np.eye(k))[np.ix_(good, good)].max(initial=0.0)
    return Whitener(n, sums, values, vectors, trace, float(error))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2; n x - S doesn't depend on the offset."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if most * most * max(1, x.shape[1]) < 2**63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in exact]


def whiten(packed: DataFrame, model: Whitener) -> DataFrame:
    """A row for each packed vector and component."""
    shared, width = packed.sparkSession.sparkContext.broadcast(model), len(model.sums)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        centre, gain, k = _centre(m.n, m.sums), m.gain, len(m.values)
        explained = np.where(m.positive, m.values / (m.trace or 1.0), 0.0)
        for ids, x in _matrices(batches, width):
            z, rows = centre(x) @ gain, len(x)
            hollow = np.tile(~m.positive, rows)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m.n, np.int64)), pa.array(_deviations(x, m.n, m.sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                 pa.array(z.ravel(), mask=hollow), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, m.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return packed.select("n", "width", "ids", "x").mapInArrow(work, WHITENED)


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Fit on all rows that take part and whiten them."""
    packed = pack(embeddings)
    model = fit(packed, components)
    return whiten(packed, model) if model else embeddings.sparkSession.createDataFrame([], WHITENED)
