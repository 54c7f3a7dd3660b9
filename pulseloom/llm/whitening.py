"""Embedding whitening: exact covariance of distinct vectors, leading components by spectrum slicing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.common import table
from pulseloom.session import materialize

STEPS = 256  # an entry c becomes floor(STEPS * c)
COMPONENTS = 4
LONG = 1 << 63
SAFE = 1 << 62  # sums and differences below this stay in 64-bit integers
LIMBS, LIMB = 6, 32  # whole numbers of any size are added up in Spark as limbs of so many bits
EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """A fitted model. ``total`` are the sums of the n distinct vectors, ``vectors`` unit rows, by falling ``values``."""

    n: int
    total: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def base(self) -> tuple[list[int], np.ndarray]:
        """The mean as whole numbers and what is left of it."""
        whole = [s // self.n for s in self.total]
        return whole, np.array([(s - self.n * c) / self.n for s, c in zip(self.total, whole)])


# Whole-number vectors


def usable(vector: str) -> Column:
    """Not null, and every entry a finite number."""
    fine = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & fine


def whole_numbers(column: pa.Array, width: int = 0) -> np.ndarray:
    """floor(256 c) of clean vectors, one row each, held to the range of a long; shorter ones end in zeros."""
    at = column.offsets.to_numpy()
    size, flat = np.diff(at), column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.float64)
    f = np.floor(flat * STEPS)
    big = f >= LONG
    x = np.where(big, 0, np.maximum(f, -float(LONG))).astype(np.int64)
    x[big] = LONG - 1
    width = max(width, int(size.max(initial=0)))
    if (size == width).all():
        return x.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = x
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """One byte string per row: the bytes of an entry (the fewest that do), then the entries without trailing zeros."""
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(x)
    done = np.zeros(len(x), bool)
    for size in (1, 2, 4, 8):
        info = np.iinfo(f"i{size}")
        rows = np.flatnonzero(~done & (low >= info.min) & (high <= info.max))
        done[rows] = True
        raw, step = x[rows].astype(f"<i{size}").tobytes(), size * x.shape[1]
        for k, i in enumerate(rows.tolist()):
            out[i] = bytes([size]) + raw[k * step : (k + 1) * step].rstrip(b"\0")
    return out


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    rows = column.to_pylist()
    for size in (1, 2, 4, 8):
        own = [i for i, b in enumerate(rows) if b[0] == size]
        if own:
            raw = b"".join(rows[i][1:].ljust(size * width, b"\0") for i in own)
            out[own] = np.frombuffer(raw, f"<i{size}").reshape(len(own), width)
    return out


def distinct_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Every distinct whole-number vector once, as bytes (column b)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield pa.RecordBatch.from_arrays([pa.array(packed(whole_numbers(batch.column(0).slice(at, 2000))), pa.binary())], names=["b"])

    return df.filter(usable(vector)).select(vector).mapInArrow(run, "b binary").distinct()


# Exact sums


def limbs(values: list[int]) -> list[list[int]]:
    """Columns of limbs; the last one carries the sign."""
    mask = (1 << LIMB) - 1
    return [[(v >> (LIMB * k)) & mask if k < LIMBS - 1 else v >> (LIMB * k) for v in values] for k in range(LIMBS)]


def summed(vectors: DataFrame, width: int, part, size: int) -> list[int]:
    """``size`` whole numbers: what ``part`` makes of the rows of every task (integers of any size), added up.

    What a task sends and what the driver gets depends on the width of the vectors alone.
    """
    names = [f"l{k}" for k in range(LIMBS)]

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                own = part(unpacked(batch.column(0).slice(at, 4000), width)).astype(object)
                total = own if total is None else total + own
        if total is not None:
            for at in range(0, size, 10_000):
                values = [int(v) for v in total[at : at + 10_000]]
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(values)), pa.int64()), *[pa.array(x, pa.int64()) for x in limbs(values)]], names=["i", *names])

    rows = vectors.mapInArrow(run, "i long, " + ", ".join(f"{x} long" for x in names)).groupBy("i").agg(*[F.sum(x).alias(x) for x in names]).collect()
    out = [0] * size
    for r in rows:
        out[r["i"]] = sum(r[x] << (LIMB * k) for k, x in enumerate(names))
    return out


def column_sums(x: np.ndarray) -> np.ndarray:
    largest = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    return (x if largest * max(len(x), 1) < SAFE else x.astype(object)).sum(axis=0)


def products(x: np.ndarray, base: list[int]) -> np.ndarray:
    """Upper triangle of the products of centred columns, exact."""
    far = max([abs(int(x.min(initial=0))), abs(int(x.max(initial=0))), *map(abs, base)])
    y = x - np.array(base, np.int64) if 2 * far < SAFE else x.astype(object) - np.array(base, object)
    largest = max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0))))
    if largest**2 * max(len(y), 1) < 1 << 53:  # every partial sum is a whole number that a double holds
        y = y.astype(np.float64)
        return (y.T @ y)[np.triu_indices(y.shape[1])].astype(np.int64)
    y = y.astype(object)
    return (y.T @ y)[np.triu_indices(y.shape[1])]


# Leading eigenpairs of a symmetric matrix


def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: the positive part of D in LDLᵀ = a - shift I (Sylvester), with symmetric pivoting."""
    m = a - shift * np.eye(len(a))
    alpha, k, above = (1 + 17**0.5) / 8, 0, 0

    def swap(i: int, j: int) -> None:
        m[[i, j], k:] = m[[j, i], k:]
        m[k:, [i, j]] = m[k:, [j, i]]

    while k < len(m):
        below = np.abs(m[k + 1 :, k])
        most = below.max(initial=0.0)
        pair = False
        if most > 0 and abs(m[k, k]) < alpha * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(m[r, k:])
            row[r - k] = 0
            if abs(m[k, k]) * row.max() < alpha * most**2:
                if abs(m[r, r]) >= alpha * row.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    pair = True
        if pair:  # a block of two with one eigenvalue on either side of zero
            c = m[k + 2 :, k : k + 2]
            m[k + 2 :, k + 2 :] -= c @ np.linalg.solve(m[k : k + 2, k : k + 2], c.T)
            above, k = above + 1, k + 2
        else:
            d, c = m[k, k], m[k + 1 :, k]
            if d != 0:
                m[k + 1 :, k + 1 :] -= np.outer(c, c / d)
            above, k = above + int(d > 0), k + 1
    return above


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest positive eigenvalues, falling, and unit eigenvectors as rows; fewer where the rank is smaller.

    Bisection with inertia counts isolates each eigenvalue, Rayleigh quotient iteration polishes it, and counts on both
    sides of it certify its number. Eigenvalues that cannot be told apart get orthogonal vectors of their common space.
    """
    size = float(np.abs(a).sum(axis=1).max(initial=0.0))  # bounds every eigenvalue
    noise = 16 * EPS * size * max(len(a), 1) ** 0.5
    values: list[float] = []
    found = np.zeros((0, len(a)))
    known = {size * (1 + 4 * EPS): 0}  # counts at shifts

    def count(s: float) -> int:
        if s not in known:
            known[s] = count_above(a, s)
        return known[s]

    for number in range(1, k + 1):
        if count(noise) < number:
            break
        low = max((s for s, c in known.items() if c >= number))
        high = min((s for s, c in known.items() if c < number))
        start = np.cos(np.arange(1, len(a) + 1) * (number + 0.5))  # has a part in every direction
        while True:
            while high - low > noise and (count(high) < number - 1 or count(low) > number):
                middle = (low + high) / 2
                low, high = (middle, high) if count(middle) >= number else (low, middle)
            x, rho, close = _polished(a, start, (low + high) / 2, found, size)
            if (close and low < rho < high) or high - low <= noise:
                break
            middle = (low + high) / 2  # the iteration left its interval
            low, high = (middle, high) if count(middle) >= number else (low, middle)
        if not count(rho + noise) < number <= count(rho - noise):
            raise ArithmeticError(f"eigenvalue {number} could not be certified")
        values.append(rho)
        found = np.vstack([found, x * (1 if x[np.abs(x).argmax()] > 0 else -1)])
    return np.array(values), found


def _polished(a: np.ndarray, x: np.ndarray, shift: float, found: np.ndarray, size: float) -> tuple[np.ndarray, float, bool]:
    """Two steps of inverse iteration at ``shift``, then Rayleigh quotient iteration beside the vectors found before."""
    unit = np.eye(len(a))

    def step(x: np.ndarray, s: float) -> np.ndarray:
        for nudge in (0.0, EPS * size, 3 * EPS * size):
            try:
                y = np.linalg.solve(a - (s + nudge) * unit, x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and np.abs(y).max() > 0:
                y /= np.abs(y).max()
                y -= found.T @ (found @ y)
                y -= found.T @ (found @ y)
                return y / np.linalg.norm(y)
        return x

    x = x - found.T @ (found @ x)
    x = step(step(x / np.linalg.norm(x), shift), shift)
    best, best_off = x, np.inf
    for _ in range(12):
        rho = float(x @ a @ x)
        off = float(np.linalg.norm(a @ x - rho * x))
        if off >= best_off / 2:
            break
        best, best_off = x, off
        x = step(x, rho)
    if off < best_off:
        best, best_off = x, off
    return best, float(best @ a @ best), best_off <= 16 * EPS * size * len(a) ** 0.5


# The operator


def fit(df: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The leading components of the distinct whole-number vectors of ``df``; None without a usable vector.

    Sums are exact whole numbers, so nothing depends on the order of rows: column sums first, then products of columns
    centred at the whole part of their means. The driver holds the covariance, whose size is the square of the vectors'
    width and does not grow with the rows. Vectors that are null or hold null or non-finite entries are left out;
    vectors that differ in length are read as if they ended in zeros; components without variance are left out.
    """
    vectors = materialize(distinct_vectors(df, vector))
    size = F.octet_length("b") - 1
    per = F.conv(F.hex(F.substring("b", 1, 1)), 16, 10).cast("int")
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.ceil(size / per))).first()
    if not n:
        return None
    width = int(width)
    total = summed(vectors, width, column_sums, width)
    base = [s // n for s in total]
    upper = summed(vectors, width, lambda x: products(x, base), width * (width + 1) // 2)
    rest = [s - n * c for s, c in zip(total, base)]
    covariance = np.zeros((width, width))
    for value, i, j in zip(upper, *np.triu_indices(width)):
        covariance[i, j] = covariance[j, i] = (n * value - rest[i] * rest[j]) / n**2
    values, rows = leading(covariance, components)
    model = Whitening(n, total, rows, values, values / np.trace(covariance) if len(values) else values)
    model.identity_error = identity_error(vectors, model, width)
    return model


def identity_error(vectors: DataFrame, model: Whitening, width: int) -> float:
    """Largest entry by which the covariance of the whitened distinct vectors differs from the identity, as measured."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                w = projected(unpacked(batch.column(0).slice(at, 4000), width), model)
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int64()), pa.array(total.ravel())], names=["i", "s"])

    rows = vectors.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return max(abs(r["s"] / model.n - (r["i"] // k == r["i"] % k)) for r in rows)


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    whole, part = model.base()
    far = max([abs(int(x.min(initial=0))), abs(int(x.max(initial=0))), *map(abs, whole)])
    y = x - np.array(whole, np.int64) if 2 * far < SAFE else x.astype(object) - np.array(whole, object)
    return (y.astype(np.float64) - part) @ (model.vectors / np.sqrt(model.values)[:, None]).T


def deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """Sum of (n x - S)² of every row, null where it exceeds a long. Sums wrap around, so one that fits is exact."""
    n, total = model.n, np.array([s % (1 << 64) for s in model.total], np.uint64)
    y = x.view(np.uint64) * np.uint64(n % (1 << 64)) - total
    about = ((x.astype(np.float64) * n - np.array(model.total, np.float64)) ** 2).sum(axis=1)
    exact = (y * y).sum(axis=1, dtype=np.uint64).view(np.int64)
    fits = about < LONG * 0.999
    for i in np.flatnonzero((about >= LONG * 0.999) & (about <= LONG * 1.001)).tolist():
        value = sum((n * int(v) - s) ** 2 for v, s in zip(x[i], model.total))
        fits[i], exact[i] = value < LONG, value if value < LONG else 0
    return pa.array(exact, mask=~fits)


def whiten(df: DataFrame, model: Whitening | None, *, vector: str = "embedding") -> DataFrame:
    """The rows of ``df`` with a usable vector, all columns, and ``whitened`` (array, one entry per component) and ``deviation``.

    Nothing is shuffled. Rows whose vector is null or holds null or non-finite entries are dropped; without a model no
    row is left. Entries beyond the width of the model do not count. Equal vectors get equal results, and columns named
    ``whitened`` or ``deviation`` are replaced.
    """
    keep = df.filter(usable(vector) & F.lit(model is not None))
    rest = [c for c in df.columns if c.lower() not in ("whitened", "deviation")]
    keep = keep.select(*[F.col(f"`{c}`") for c in rest], F.col(vector).alias("_vector"))
    schema = T.StructType([*keep.schema.fields[:-1], T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        k, width = len(model.values), len(model.total)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = np.ascontiguousarray(whole_numbers(batch.column(batch.num_columns - 1), width)[:, :width])
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
                w = pa.ListArray.from_arrays(ends, pa.array(projected(x, model).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], w, deviations(x, model)], names=schema.names)

    return keep.mapInArrow(run, schema)


def op12_whitening(spark, sf_dir):
    """One row per usable vector and component, of the first four.

    Null and repeated vec_ids are kept as they are; an empty table, or one without variance, gives no rows. A deviation
    beyond a long is null.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    shares = [] if model is None else model.explained.tolist()
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at") + 1) if shares else F.lit(None).cast("double")
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("bigint").alias("n"), "deviation",
        "whitened", share.alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
