"""Embedding whitening through the exact characteristic polynomial of the integer scatter.

Entries are scaled and floored to integers, so the scatter n * sum(x x') - S S' of the distinct
vectors is an integer matrix, summed by Spark without rounding.  Its characteristic polynomial is
found modulo many primes, each by a Hessenberg reduction in a task of its own, and put together by
Chinese remaindering; a bound on the coefficients says how many primes prove it.  As all its roots
are real, the sign changes of its shifted coefficients count the roots beyond a point exactly: that
isolates each eigenvalue, and bisection refines it to far more digits than a double holds.  Inverse
iteration in high precision finds the null space of the matrix less an eigenvalue.  What reaches the
driver depends on the square of the dimension alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import land

#: Eigenvalues are refined to so many bits relative to their size; vectors are computed with so many decimal digits.
BITS, DIGITS = 128, 70
_LIMB = 32


def integers(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is not null and holds finite numbers only."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    return rows.where(v.isNotNull() & finite).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of a batch's vectors of each length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.asarray(column.offsets) - (column.offsets[0].as_py() if len(column) else 0)
    sizes = np.diff(ends)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, values[ends[at][:, None] + np.arange(d)].reshape(len(at), d)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact x'x as Python integers: doubles where every partial sum stays below 2^53, else in integers of any size."""
    top = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    if top * top * len(x) < 1 << 53:
        f = x.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    if len(x) > 1 and top < 1 << 24:
        return _products(x[: len(x) // 2]) + _products(x[len(x) // 2 :])
    return x.T.astype(object) @ x.astype(object)


def scatters(fit: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """{length: (n, S, n * sum(x x') - S S')} of the vectors in column x, exact.

    Each task sums its own rows; sums travel as 32-bit limbs, whose totals can't overflow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for d, _, x in _by_length(batch.column(0)):
                own = sums.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
                own[0] += len(x)
                own[1] = own[1] + x.astype(object).sum(0)
                own[2] = own[2] + _products(x)
        cells = []
        for d, (n, s, m) in sums.items():
            whole = [(-2, 0, n), *((-1, j, v) for j, v in enumerate(s)), *((i, j, m[i, j]) for i in range(d) for j in range(i, d))]
            for i, j, v in whole:
                v, limb = int(v), 0
                while not -(1 << _LIMB) < v < 1 << _LIMB:
                    cells.append((d, i, j, limb, v & ((1 << _LIMB) - 1)))
                    v, limb = v >> _LIMB, limb + 1
                cells.append((d, i, j, limb, v))
        names = ["d", "i", "j", "limb", "v"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*cells) if cells else [[]] * 5)], names)

    parts = fit.select("x").mapInArrow(run, "d long, i long, j long, limb long, v long").groupBy("d", "i", "j", "limb").agg(F.sum("v").alias("v"))
    found: dict[int, dict] = {}
    for r in parts.collect():  # some limbs for each pair of dimensions
        own = found.setdefault(r.d, {})
        own[r.i, r.j] = own.get((r.i, r.j), 0) + (r.v << (_LIMB * r.limb))
    out = {}
    for d, c in found.items():
        n, s = c[-2, 0], [c[-1, j] for j in range(d)]
        out[d] = n, s, [[n * c[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]
    return out


def primes(count: int, below: int = 1 << 31) -> list[int]:
    """The largest primes below 2^31 (so that products fit 64-bit integers), by strong tests that are exact there."""

    def prime(q: int) -> bool:
        s = ((q - 1) & -(q - 1)).bit_length() - 1
        for base in (2, 3, 5, 7):  # enough below 3.2 * 10^9
            x = pow(base, (q - 1) >> s, q)
            if x not in (1, q - 1) and all((x := x * x % q) != q - 1 for _ in range(s - 1)):
                return False
        return True

    found, q = [], below - 1
    while len(found) < count:
        if prime(q):
            found.append(q)
        q -= 2
    return found


def charpoly_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients modulo p of det(x - a), constant first, by reduction to Hessenberg form."""
    h, d = a % p, len(a)
    for j in range(d - 2):
        below = np.flatnonzero(h[j + 1 :, j])
        if not len(below):
            continue
        k = j + 1 + int(below[0])
        if k > j + 1:
            h[[j + 1, k]] = h[[k, j + 1]]
            h[:, [j + 1, k]] = h[:, [k, j + 1]]
        times = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2 :] = (h[j + 2 :] - times[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * times % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        new = np.roll(polys[k], 1)  # the leading place is still free
        new = (new - h[k, k] * polys[k] % p) % p
        run = 1
        for i in range(k - 1, -1, -1):
            run = run * int(h[i + 1, i]) % p
            if not run:
                break
            new = (new - int(h[i, k]) * run % p * polys[i] % p) % p
        polys[k + 1] = new
    return polys[d].tolist()


def charpoly(spark, a: list[list[int]]) -> list[int]:
    """Coefficients of det(x - a) of a positive semidefinite integer matrix, constant first; exact."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    # Symmetric functions of eigenvalues that are not negative are largest where all are equal.
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    moduli = primes((2 * bound).bit_length() // 30 + 1)
    shared = spark.sparkContext.broadcast(a)  # the square of the dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                c = charpoly_mod(np.array([[v % p for v in row] for row in shared.value], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([c], pa.list_(pa.int64()))], ["p", "c"])

    tasks = min(len(moduli), 4 * spark.sparkContext.defaultParallelism)
    todo = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(tasks)
    by = {r.p: r.c for r in todo.mapInArrow(run, "p long, c array<long>").collect()}  # as many rows as primes
    shared.destroy()
    product = math.prod(by)
    out = [0] * (d + 1)
    for p, c in by.items():
        rest = product // p
        unit = rest * pow(rest, -1, p)
        for k, v in enumerate(c):
            out[k] += v * unit
    out = [v % product for v in out]
    return [v - product if 2 * v > product else v for v in out]


def roots_beyond(poly: list[int], m: int, s: int) -> int:
    """How many roots exceed m / 2^s, for a polynomial all of whose roots are real: sign changes after the shift."""
    d = len(poly) - 1
    c = [v << (s * (d - k)) for k, v in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += m * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(poly: list[int], m: int, s: int) -> int:
    value = 0
    for k, v in enumerate(reversed(poly)):
        value = value * m + (v << (s * k))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int]]:
    """The largest positive roots with multiplicity, falling, each as (m, s) for m / 2^s, below the root by 2^-BITS of it at most."""
    zeros = next(k for k, v in enumerate(poly) if v)
    poly = poly[zeros:]
    top = sum(abs(v) for v in poly[-2:-1]) + 1  # the trace
    out = []
    for j in range(1, min(count, len(poly) - 1) + 1):
        low, high, s = 0, top, 0  # fewer than j roots beyond high, j or more beyond low
        beyond_low, beyond_high = len(poly) - 1, 0
        while (high - low) << BITS > high:
            if low + high & 1:
                low, high, s = 2 * low, 2 * high, s + 1
            middle = (low + high) // 2
            if beyond_low - beyond_high == 1:  # one root inside: the sign tells
                beyond = beyond_low if _sign(poly, middle, s) == (-1) ** beyond_low else beyond_high
            else:
                beyond = roots_beyond(poly, middle, s)
            if beyond >= j:
                low, beyond_low = middle, beyond
            else:
                high, beyond_high = middle, beyond
        out.append((low, s))
    return out


def null_vector(a: list[list[int]], root: tuple[int, int], others: list[list[Decimal]], seed: int) -> list[Decimal]:
    """Unit vector of the null space of a - root, orthogonal to ``others``, by inverse iteration."""
    d = len(a)
    with localcontext() as context:
        context.prec = DIGITS
        value = Decimal(root[0]) / (1 << root[1])
        lu = [[Decimal(v) - (value if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(a)]
        tiny = max(abs(v) for row in a for v in row) * Decimal(10) ** (8 - DIGITS)
        order = list(range(d))
        for k in range(d):
            p = max(range(k, d), key=lambda i: abs(lu[i][k]))
            lu[k], lu[p], order[k], order[p] = lu[p], lu[k], order[p], order[k]
            if abs(lu[k][k]) < tiny:
                lu[k][k] = tiny
            pivot = lu[k]
            for i in range(k + 1, d):
                row = lu[i]
                if row[k]:
                    f = row[k] = row[k] / pivot[k]
                    row[k + 1 :] = [x - f * y for x, y in zip(row[k + 1 :], pivot[k + 1 :])]

        def unit(v: list[Decimal]) -> list[Decimal]:
            for o in others:
                dot = sum(x * y for x, y in zip(v, o))
                v = [x - dot * y for x, y in zip(v, o)]
            size = sum(x * x for x in v).sqrt()
            return [x / size for x in v]

        v = unit([Decimal(1 + (seed * 7919 + i * 104729) % 1009) for i in range(d)])
        for _ in range(4):
            y = [v[i] for i in order]
            for i in range(d):
                y[i] -= sum(lu[i][k] * y[k] for k in range(i))
            for i in range(d - 1, -1, -1):
                y[i] = (y[i] - sum(lu[i][k] * y[k] for k in range(i + 1, d))) / lu[i][i]
            v = unit(y)
        return v


def model(spark, n: int, s: list[int], a: list[list[int]], components: int) -> dict:
    """n, S, unit eigenvectors (d x k), sqrt of n^2 times each eigenvalue, and each one's share of the trace."""
    trace = sum(a[i][i] for i in range(len(a)))
    if not trace:
        return {"n": n, "s": s, "vectors": np.zeros((len(a), 0)), "roots": np.zeros(0), "shares": []}
    common = math.gcd(*(v for row in a for v in row))
    small = [[v // common for v in row] for row in a]
    roots = largest_roots(charpoly(spark, small), components)
    vectors: list[list[Decimal]] = []
    for k, root in enumerate(roots):
        vectors.append(null_vector(small, root, vectors, k + 1))
    with localcontext() as context:
        context.prec = DIGITS
        values = [Decimal(m) / (1 << t) * common for m, t in roots]
        return {
            "n": n, "s": s, "vectors": np.array([[float(x) for x in v] for v in vectors]).T,
            "roots": np.array([float(v.sqrt()) for v in values]), "shares": [float(v / trace) for v in values],
        }


def projected(rows: DataFrame, models: dict[int, dict]) -> DataFrame:
    """(vec_id, d, deviation, whitened array<double>) of rows (vec_id, x)."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            deviation, whitened, length = np.zeros(m, object), np.zeros(m, object), np.zeros(m, np.int64)
            for d, at, x in _by_length(batch.column(1)):
                own = models[d]
                top = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * own["n"] + max(map(abs, own["s"]), default=0)
                exact = top * top * max(d, 1) < 1 << 63
                off = own["n"] * (x if exact else x.astype(object)) - np.array(own["s"], np.int64 if exact else object)
                deviation[at] = [v if -(1 << 63) <= v < 1 << 63 else None for v in (off * off).sum(1).tolist()] if d else 0
                length[at] = d
                for i, w in zip(at.tolist(), off.astype(float) @ own["vectors"] / own["roots"] if d else np.zeros((len(at), 0))):
                    whitened[i] = w
            columns = [batch.column(0), pa.array(length), pa.array(deviation.tolist(), pa.int64()), pa.array(whitened.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "d", "deviation", "whitened"])

    return rows.mapInArrow(run, f"vec_id {kind}, d long, deviation long, whitened array<double>")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row per vector and component.

    Vectors that are null or hold null or non-finite entries give no rows.  Every vector counts once
    in the fit, however often it occurs; repeated and null ids are rows like others, other columns
    are ignored.  Vectors of different lengths are fitted apart.  Components whose eigenvalue is
    zero can't be whitened and are left out, so equal vectors, a single one or none give no rows.
    Tied eigenvalues have some orthogonal basis of their space.  A deviation beyond 64 bits is null;
    a scaled entry beyond them is the nearest 64-bit integer.
    """
    spark = rows.sparkSession
    x = integers(rows, id_col, vector_col, scale)
    fit = land(x.select("x").distinct())
    models = {d: model(spark, *sums, components) for d, sums in scatters(fit).items()}
    white = projected(fit.select(F.lit(0).alias("vec_id"), "x"), models).where("size(whitened) > 0")
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    at = [F.get("whitened", F.lit(i)) for i in range(components)]
    sums = white.groupBy("d").agg(*[F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()  # one row for each length
    error = {r.d: max(abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < len(models[r.d]["shares"])) for r in sums}
    facts = [(d, k + 1, models[d]["n"], share, error[d]) for d in error for k, share in enumerate(models[d]["shares"])]
    schema = "d long, component int, n long, explained double, identity_error double"
    known = spark.createDataFrame(facts, schema)  # a few rows for each length
    each = projected(x, models).select("vec_id", "d", "deviation", F.posexplode("whitened").alias("k", "whitened")).withColumn("component", F.col("k") + 1)
    return each.join(F.broadcast(known), ["d", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
