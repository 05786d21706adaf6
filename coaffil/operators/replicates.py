"""Many count regressions at once: specifications, permutations, bootstraps, exclusions.

The frame is cut into blocks of rows, one row of Spark each, with a column of numbers per variable.
A round of the fit is one pass over the blocks: a task forms the draw of each replicate for its
block, as a function of the seed and the block alone, and adds up the normal equations of all
replicates by matrix products.  So no row is ever copied for a replicate, nothing is sorted for a
draw, and only sums by replicate reach the driver, whatever the number of rows.

A draw needs no look at other blocks: how many of a stratum's labels, or of a bootstrap's picks,
fall into a block follows from splitting the total down a binary tree of blocks, with a
hypergeometric or binomial variate at each node that every task draws alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import checkpointed
from .numbering import with_row_numbers
from .permuted import permuted_places

#: Rows of a block, and replicates that are worked on at a time.
LEAF, CHUNK = 1024, 64
#: A standard error or coefficient beyond these is a diverged fit.
FAR_SE, FAR_COEF = 1e3, 40.0


@dataclass
class Blocks:
    """Blocks of a frame: group, stratum, leaf and an array column for each of ``names``."""

    df: DataFrame
    names: list[str]
    xs: list[str]
    #: (group, stratum): rows and sum of the first covariate, the label.
    strata: dict[tuple[str, str], tuple[int, float]]
    #: group: rows and mean outcome.
    groups: dict[str, tuple[int, float]] = field(default_factory=dict)
    #: Whether a block's rows are known by their places, as draws need.
    ordered: bool = True


def blocks(frame: DataFrame, y: str, xs: list[str], order: list[str], group: str | None = None, stratum: str | None = None, extra: tuple[str, ...] = (), leaf: int = LEAF) -> Blocks:
    """Blocks of the rows without a null in y and xs, in the given order inside each group and stratum.

    ``order`` must settle the rows' order, else draws are not reproducible; an empty one makes blocks
    for fits without draws, with one shuffle less.  ``extra`` columns are
    numbers that a draw needs, or binary columns.  Groups and strata are few: their sizes reach the
    driver.
    """
    names = [y, *xs]
    kinds = dict(frame.dtypes)
    wide = [c for c in extra if kinds[c] == "binary"]
    rows = frame.select(
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g") if group else F.lit("all").alias("_g"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_s") if stratum else F.lit("").alias("_s"),
        *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)],
        *[F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(names)],
        *[F.col(c).alias(f"_e{k}") if c in wide else F.col(c).cast("double").alias(f"_e{k}") for k, c in enumerate(extra)],
    ).dropna(subset=[f"_v{k}" for k in range(len(names))])
    label = F.sum("_v1" if xs else F.lit(0.0)).alias("label")
    if order:
        numbered, _ = with_row_numbers(rows, "_g", "_s", *[f"_o{k}" for k in range(len(order))], name="_i")
        numbered = numbered.persist()
        sums = numbered.groupBy("_g", "_s").agg(F.count("*").alias("n"), F.sum("_v0").alias("y"), label, F.min("_i").alias("start")).collect()
    else:
        numbered = rows.withColumn("_i", F.monotonically_increasing_id()).persist()
        sums = numbered.groupBy("_g", "_s").agg(F.count("*").alias("n"), F.sum("_v0").alias("y"), label, F.lit(0).cast("long").alias("start")).collect()
    starts = frame.sparkSession.createDataFrame([(r._g, r._s, r.start, r.n) for r in sums], "_g string, _s string, _start long, _n long")
    cells = [*[f"_v{k}" for k in range(len(names))], *[f"_e{k}" for k in range(len(extra))]]
    at = F.floor((F.col("_i") - F.col("_start")) / leaf) if order else F.pmod(F.xxhash64("_i"), F.ceil(F.col("_n") / leaf))
    placed = numbered.join(F.broadcast(starts), ["_g", "_s"]).withColumn("_leaf", at.cast("int"))
    packed = placed.groupBy("_g", "_s", "_leaf").agg(F.array_sort(F.collect_list(F.struct("_i", *cells))).alias("r"))
    packed = packed.select("_g", "_s", "_leaf", *[F.col(f"r.{c}").alias(c) for c in cells])
    count = sum(-(-r.n // leaf) for r in sums)
    tasks = max(1, min(count, 2 * frame.sparkSession.sparkContext.defaultParallelism, 1 << 14) if count < 1 << 16 else count // 64)
    out = checkpointed(packed.repartitionByRange(tasks, "_g", "_s", "_leaf"))
    numbered.unpersist()
    groups: dict[str, tuple[int, float]] = {}
    for r in sums:
        n, total = groups.get(r._g, (0, 0.0))
        groups[r._g] = n + r.n, total + r.y
    return Blocks(out, [*names, *extra], xs, {(r._g, r._s): (r.n, r.label) for r in sums}, {g: (n, s / n) for g, (n, s) in groups.items()}, bool(order))


# --- draws ---------------------------------------------------------------------------------------


def _generator(*key) -> np.random.Generator:
    return np.random.default_rng([int(k) if not isinstance(k, str) else int.from_bytes(k.encode()[:64], "big") for k in key])


@lru_cache(maxsize=4096)
def node_totals(kind: str, seed: int, key: str, size: int, total: int | tuple[int, ...], reps: int, low: int, high: int, leaf: int) -> np.ndarray:
    """How many of ``total`` labels (kind "permute") or picks ("bootstrap") each replicate has in leaves low to high - 1.

    A tuple gives each replicate's own total.
    """
    leaves = -(-size // leaf)
    if (low, high) == (0, leaves):
        return np.full(reps, total, np.int64) if isinstance(total, int) else np.array(total, np.int64)
    # The parent node: halving from the root down.
    a, b = 0, leaves
    while True:
        middle = (a + b) // 2
        if (low, high) in ((a, middle), (middle, b)):
            break
        a, b = (a, middle) if high <= middle else (middle, b)
    above = node_totals(kind, seed, key, size, total, reps, a, b, leaf)
    rows = min(b * leaf, size) - a * leaf
    left = (middle - a) * leaf
    draw = _generator(seed, key, a, b)
    first = draw.hypergeometric(above, rows - above, left) if kind == "permute" else draw.binomial(above, left / rows)
    return first if low == a else above - first


@lru_cache(maxsize=24)
def leaf_draw(kind: str, seed: int, key: str, size: int, total: int | tuple[int, ...], reps: int, at: int, leaf: int) -> np.ndarray:
    """Label (bool) or number of picks of each row of a leaf in each replicate, rows x reps."""
    rows = min((at + 1) * leaf, size) - at * leaf
    inside = node_totals(kind, seed, key, size, total, reps, at, at + 1, leaf)
    draw = _generator(seed, key, at, at, 1)
    if kind == "bootstrap":
        return draw.multinomial(inside, np.full(rows, 1 / rows)).T.astype(np.float32)
    number = draw.random((reps, rows))
    cut = np.sort(number, axis=1)[np.arange(reps), np.minimum(inside, rows - 1)]
    label = number < np.where(inside < rows, cut, np.inf)[:, None]
    if (label.sum(1) != inside).any():  # equal numbers at a cut
        label = np.argsort(np.argsort(number, axis=1), axis=1) < inside[:, None]
    return label.T


@lru_cache(maxsize=8)
def dealt_totals(seed: int, counts: tuple[tuple[str, int, int], ...], reps: int) -> dict[str, tuple[int, ...]]:
    """Label counts of the strata (name, rows, labels) dealt to other strata in each replicate; no more than a stratum has rows."""
    order = np.argsort(_generator(seed, 77).random((reps, len(counts))), axis=1)
    labels = np.array([c for _, _, c in counts])[order]
    return {name: tuple(np.minimum(labels[:, k], size).tolist()) for k, (name, size, _) in enumerate(counts)}


@dataclass(frozen=True)
class Draws:
    """What differs between replicates.

    "observed": nothing; "permute": the label is dealt anew inside each stratum; "bootstrap": rows
    are drawn with replacement inside each stratum; "leave": replicate r leaves out the rows whose
    column ``extra`` is r; "without": column ``extra`` holds each row's outcome loss (32-bit
    integers by replicate) and a row whose loss is -1 is left out; "deal": the strata's
    label counts are dealt among the strata, then labels inside each; "shift": a row's label is its
    part ``extra`` that stays and the remainder of another row, ``rest`` being a broadcast of all
    remainders by row number (one group and stratum; whoever broadcasts them checks their size).
    """

    kind: str = "observed"
    reps: int = 1
    seed: int = 0
    extra: str = ""
    counts: tuple[tuple[str, int, int], ...] = ()
    rest: object = None

    def matrices(self, block: dict, group: str, stratum: str, at: int, size: int, total: float, leaf: int, chosen: np.ndarray):
        """Outcome, label and weight of the block's rows in the chosen replicates; each broadcasts to rows x replicates."""
        y, label, one = block["y"][:, None], block["label"][:, None], np.ones((1, 1))
        if self.kind == "permute":
            return y, leaf_draw("permute", self.seed, stratum, size, int(round(total)), self.reps, at, leaf)[:, chosen].astype(float), one
        if self.kind == "deal":
            totals = dealt_totals(self.seed, self.counts, self.reps)[stratum]
            return y, leaf_draw("permute", self.seed, stratum, size, totals, self.reps, at, leaf)[:, chosen].astype(float), one
        if self.kind == "shift":
            rest = self.rest.value
            return y, block[self.extra][:, None] + rest[permuted_places(at * leaf + np.arange(len(y)), size, self.seed, chosen)], one
        if self.kind == "bootstrap":
            return y, label, leaf_draw("bootstrap", self.seed, stratum, size, size, self.reps, at, leaf)[:, chosen].astype(float)
        if self.kind == "leave":
            return y, label, (block[self.extra][:, None] != chosen[None, :]).astype(float)
        if self.kind == "without":
            loss = np.frombuffer(b"".join(block[self.extra]), "<i4").reshape(len(y), self.reps)[:, chosen]
            return np.where(loss < 0, 0.0, y - loss), label, (loss >= 0).astype(float)
        return y, label, one


def label_sums(found: Blocks, draws: Draws, column: str, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Sum of ``column`` (one of the blocks' extras) over the rows that each replicate labels, by group."""
    names, strata = found.names, found.strata

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (g, s, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                cells = {k: batch.column(3 + names.index(n))[row].values.to_numpy(zero_copy_only=False) for k, n in (("y", names[0]), ("label", names[1]), (column, column))}
                label = draws.matrices(cells, g, s, at, *strata[g, s], leaf, np.arange(draws.reps))[1]
                yield pa.RecordBatch.from_arrays([pa.array([g] * draws.reps), pa.array(range(draws.reps), pa.int64()), pa.array((label * cells[column][:, None]).sum(0) * np.ones(draws.reps))], ["g", "rep", "s"])

    out = {g: np.zeros(draws.reps) for g in found.groups}
    for r in found.df.mapInArrow(run, "g string, rep long, s double").groupBy("g", "rep").agg(F.sum("s").alias("s")).collect():
        out[r.g][r.rep] = r.s
    return out


# --- special functions -----------------------------------------------------------------------------


def digamma_pair(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digamma and trigamma of positive numbers: raised above 8 by the recurrence, then the asymptotic series."""
    x = np.array(x, float)
    psi, tri = np.zeros_like(x), np.zeros_like(x)
    while (low := x < 8).any():
        r = 1 / x[low]
        psi[low] -= r
        tri[low] += r * r
        x[low] += 1
    r = 1 / x
    r2 = r * r
    psi += np.log(x) - r / 2 - r2 * (1 / 12 - r2 * (1 / 120 - r2 * (1 / 252 - r2 * (1 / 240 - r2 / 132))))
    tri += r * (1 + r / 2 + r2 * (1 / 6 - r2 * (1 / 30 - r2 * (1 / 42 - r2 * (1 / 30 - r2 * 5 / 66)))))
    return psi, tri


# --- fits ------------------------------------------------------------------------------------------


@dataclass
class Fits:
    """Fits by replicate of one group: coefficients (constant, label, covariates), their inverse information, dispersion, rows."""

    coef: np.ndarray
    inverse: np.ndarray
    alpha: np.ndarray
    n: np.ndarray
    converged: np.ndarray

    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.einsum("rii->ri", self.inverse), 0))


def fit(found: Blocks, draws: Draws = Draws(), alpha: float | dict | None = None, start: dict[str, np.ndarray] | None = None, rounds: int = 60, tolerance: float = 1e-8, leaf: int = LEAF) -> dict[str, Fits]:
    """NB2 fits with log link of every group and replicate by Fisher scoring; the first of xs is the label that draws change.

    ``alpha``: a number or one for each group; None estimates it by maximum likelihood, a Newton
    step of the profile in each round (outcomes rounded for it).  Replicates that have converged are
    left out of later rounds; those that don't converge, whose label is not identified (one arm) or
    that run off (no outcome in an arm) have ``converged`` false, and their numbers are not to be
    used.  A covariate that is constant or a combination of others does no harm.
    """
    spark, names, strata = found.df.sparkSession, found.names, found.strata
    if not found.ordered and draws.kind not in ("observed", "leave", "without"):
        raise ValueError("these draws need blocks with an order")
    xs = found.xs
    p, wanted = 1 + len(xs), alpha is None
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    pairs = [(i, j) for i in range(p - 1) for j in range(i, p - 1)]  # of constant and covariates, without the label
    q = len(upper) + p + 3
    state = {}
    for g, (n, mean) in found.groups.items():
        b = np.zeros((draws.reps, p))
        b[:, 0] = math.log(max(mean, 1e-3))
        if start is not None and g in start:
            b[:] = start[g]
        a = 1.0 if wanted else (alpha[g] if isinstance(alpha, dict) else alpha)
        state[g] = {"b": b, "t": np.full(draws.reps, 1 / a if a else np.inf), "on": np.ones(draws.reps, bool), "ok": np.zeros(draws.reps, bool), "inv": np.zeros((draws.reps, p, p)), "n": np.zeros(draws.reps), "dt": np.full(draws.reps, np.inf)}
    fixed = [0, *range(2, p)]  # places of constant and covariates among the coefficients

    def job(now: dict):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
                for row, (g, s, at) in enumerate(keys):
                    if g not in now:
                        continue
                    chosen, b, t = now[g]
                    block = {}
                    for k, name in enumerate(names):
                        cell = batch.column(3 + k)[row].values
                        value = cell.to_pylist() if pa.types.is_binary(cell.type) else cell.to_numpy(zero_copy_only=False)
                        block["y" if k == 0 else "label" if k == 1 and p > 1 else name] = value
                    m = len(block["y"])
                    x = np.column_stack([np.ones(m), *[block[n] for n in xs[1:]]])
                    block.setdefault("label", np.zeros(m))
                    xx = np.column_stack([x[:, i] * x[:, j] for i, j in pairs])
                    out = sums.setdefault(g, np.zeros((len(chosen), q)))
                    size, total = strata[g, s]
                    for c in range(0, len(chosen), CHUNK):
                        part = slice(c, c + CHUNK)
                        y, label, weight = draws.matrices(block, g, s, at, size, total, leaf, chosen[part])
                        shape = (m, len(chosen[part]))
                        eta = x @ b[part][:, fixed].T + (label * b[part, 1] if p > 1 else 0)
                        mu = np.exp(np.clip(eta, -30, 50))
                        u = 1 + mu / t[part]
                        w = weight * mu / u
                        r = weight * (y - mu) / u
                        own = np.zeros((shape[1], p, p))
                        for v, (i, j) in zip((xx.T @ w), pairs):
                            own[:, fixed[i], fixed[j]] = own[:, fixed[j], fixed[i]] = v
                        score = np.zeros((shape[1], p))
                        score[:, fixed] = (x.T @ r).T
                        if p > 1:
                            wl = w * label
                            cross = (x.T @ wl).T
                            own[:, fixed, 1] = own[:, 1, fixed] = cross
                            own[:, 1, 1] = (wl * label).sum(0)
                            score[:, 1] = (r * label).sum(0)
                        for k, (i, j) in enumerate(upper):
                            out[part, k] += own[:, i, j]
                        out[part, len(upper) : len(upper) + p] += score
                        out[part, q - 3] += np.broadcast_to(weight, shape).sum(0)
                        if wanted:
                            yr, tt = np.rint(y), t[part]
                            if yr.shape[1] == 1:  # outcomes that no draw changes: once for each value
                                value, back = np.unique(yr[:, 0], return_inverse=True)
                                psi, tri = (v[back] for v in digamma_pair(value[:, None] + tt))
                            else:
                                psi, tri = digamma_pair(np.broadcast_to(yr, shape) + tt)
                            psi0, tri0 = digamma_pair(tt)
                            out[part, q - 2] += (weight * (psi - psi0 + np.log(tt) + 1 - np.log(tt + mu) - (yr + tt) / (tt + mu))).sum(0)
                            out[part, q - 1] += (weight * (tri - tri0 + 1 / tt - 1 / (tt + mu) - (mu - yr) / (tt + mu) ** 2)).sum(0)
            for g, out in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(out)), pa.array(now[g][0], pa.int64()), *[pa.array(np.ascontiguousarray(out[:, k])) for k in range(q)]], ["g", "rep", *[f"s{k}" for k in range(q)]])

        return run

    schema = "g string, rep long, " + ", ".join(f"s{k} double" for k in range(q))
    for _ in range(rounds):
        now = {g: (np.flatnonzero(v["on"]), v["b"][v["on"]], v["t"][v["on"]]) for g, v in state.items() if v["on"].any()}
        if not now:
            break
        cells = found.df.mapInArrow(job(now), schema).groupBy("g", "rep").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(q)]).toPandas()  # one row a replicate
        for g, part in cells.groupby("g"):
            v, rep, s = state[g], part["rep"].to_numpy(), part[[f"s{k}" for k in range(q)]].to_numpy()
            _step(v, rep, s, p, upper, wanted, tolerance)
    return {g: Fits(v["b"], v["inv"], np.where(np.isinf(v["t"]), 0.0, 1 / v["t"]), v["n"], v["ok"]) for g, v in state.items()}


def _step(v: dict, rep: np.ndarray, s: np.ndarray, p: int, upper: list, wanted: bool, tolerance: float) -> None:
    """One scoring step of the replicates ``rep`` of a group from their sums."""
    info = np.zeros((len(rep), p, p))
    for k, (i, j) in enumerate(upper):
        info[:, i, j] = info[:, j, i] = s[:, k]
    score = s[:, len(upper) : len(upper) + p]
    v["n"][rep] = s[:, -3]
    scale = np.sqrt(np.maximum(np.einsum("rii->ri", info), 1e-300))
    scaled = info / scale[:, :, None] / scale[:, None, :]
    good = np.isfinite(scaled).all((1, 2))
    scaled[~good] = np.eye(p)
    # Covariates that are constant or collinear get the shortest coefficients; a label that is so has none.
    inverse = np.linalg.pinv(scaled, rcond=1e-10, hermitian=True)
    if p > 1:
        good &= np.abs(np.einsum("rj,rj->r", inverse[:, 1], scaled[:, :, 1]) - 1) < 1e-6
    v["on"][rep[~good]] = False
    rep, inverse, scale, score, s = rep[good], inverse[good], scale[good], score[good], s[good]
    if not len(rep):
        return
    inverse = inverse / scale[:, :, None] / scale[:, None, :]
    step = np.einsum("rij,rj->ri", inverse, score)
    step *= np.minimum(1, 5 / np.maximum(np.abs(step).max(1), 1e-300))[:, None]
    v["b"][rep] += step
    v["inv"][rep] = inverse
    still = np.abs(step).max(1) < tolerance
    if wanted:
        t = v["t"][rep]
        slope = s[:, -2] * t
        bend = s[:, -1] * t * t + slope
        move = np.clip(np.where(bend < 0, -slope / np.where(bend < 0, bend, -1), np.sign(slope)), -2, 2)
        new = np.clip(t * np.exp(move), 1e-7, 1e7)
        still &= (np.abs(np.log(new / t)) < 1e-8) | (np.abs(np.log(new)) > 16)
        v["t"][rep] = new
    far = (np.sqrt(np.einsum("rii->ri", inverse)) > FAR_SE).any(1) | (np.abs(v["b"][rep]) > FAR_COEF).any(1)
    v["ok"][rep[still & ~far]] = True
    v["on"][rep[still | far]] = False
